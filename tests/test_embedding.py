"""Embeddings by fold: no leak, one row for each id, the same by any number of tasks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.config import EmbeddingConfig
from eventide.operators import embedding

CONFIG = EmbeddingConfig(width=6, folds=4, epochs=30, tasks=1)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(160, 3))
    y = (x[:, 0] - x[:, 1] * x[:, 2] > 0).astype(int)
    made = [(f"r{i}", v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [("none", None, 1), ("unlabelled", [0.0, 0.0, 1.0], None)]
    return spark.createDataFrame(made, "row_id string, features array<double>, label int").withColumn("fold", embedding.fold_of("row_id", 4)).repartition(4)


def vectors(found):
    return {r["row_id"]: np.array(r["embedding"]) for r in found.collect()}


def test_rows_are_embedded_by_networks_that_have_not_seen_them(rows):
    """Other labels in one fold change the embeddings of all folds but this one."""
    own = vectors(embedding.FoldedEmbedder(CONFIG).fit(rows).embed_train(rows))
    other_labels = rows.withColumn("label", F.when(F.col("fold") == 2, 1 - F.col("label")).otherwise(F.col("label")))
    other = vectors(embedding.FoldedEmbedder(CONFIG).fit(other_labels).embed_train(rows))
    folds = {r["row_id"]: r["fold"] for r in rows.collect()}
    assert set(own) == set(other) == set(folds) - {"none"} and len(set(folds.values())) == 4
    for i, v in own.items():
        assert np.array_equal(v, other[i]) == (folds[i] == 2)


def test_the_number_of_tasks_changes_nothing(rows):
    one, many = (embedding.FoldedEmbedder(replace(CONFIG, tasks=t)).fit(rows) for t in (1, 3))
    assert sorted(one.networks) == [-1, 0, 1, 2, 3]
    assert all(np.allclose(a, b) for k in one.networks for a, b in zip(one.networks[k], many.networks[k]))
    seen, other = vectors(one.embed_train(rows)), vectors(one.embed(rows))
    assert set(seen) == set(other) and not np.allclose(seen["r0"], other["r0"])


def test_slopes():
    r = np.random.default_rng(1)
    net, x, y = embedding.Network.initial(3, CONFIG, 0), r.normal(size=(9, 3)), r.integers(0, 2, 9)

    def loss(n):
        z = n.embed(x) @ n.out + n.bias[0]
        return (np.logaddexp(0, z) - y * z).sum()

    slope = net.slopes(x, y)
    for part in range(4):
        for at in np.ndindex(net[part].shape):
            up, down = (embedding.Network(*(p.copy() for p in net)) for _ in range(2))
            up[part][at] += 1e-6
            down[part][at] -= 1e-6
            assert slope[part][at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-5)


def test_fit_learns_and_needs_rows(spark, rows):
    net = embedding.FoldedEmbedder(replace(CONFIG, epochs=300)).fit(rows).networks[-1]
    own = [r for r in rows.collect() if r["label"] is not None and r["features"]]
    guess = net.embed(np.array([r["features"] for r in own])) @ net.out + net.bias[0] > 0
    assert np.mean(guess == np.array([r["label"] == 1 for r in own])) > 0.9
    with pytest.raises(RuntimeError):
        embedding.FoldedEmbedder(CONFIG).fit(rows.limit(0))
