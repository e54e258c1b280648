"""Thresholds, metrics, trees, concept vectors and the autoencoder against hand-made values and numpy."""

import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.config import AutoencoderConfig, CohortConfig, TreeConfig
from eventide.operators import autoencoder, concepts, order, separators, trees
from eventide.plans import pipeline
from eventide.sources import events as sources
from eventide.sources import sinks

from . import brute_trees


def acts(spark, *units):
    return spark.createDataFrame([(i, [float(u[i]) for u in units]) for i in range(len(units[0]))], "row_id long, activation array<double>")


def test_threshold_and_strict_binarisation(spark):
    rows = acts(spark, [1, 2, 3, 4, 0, 0], [2.5] * 6)
    limits = concepts.thresholds(rows, 4)
    assert {r["idx"]: r["threshold"] for r in limits.collect()} == {0: 2.5, 1: 2.5}
    assert sorted((r["row_id"], r["y"]) for r in concepts.binarise(rows, limits).where("idx = 0").collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 0), (5, 0)]
    assert concepts.binarise(rows, limits).where("idx = 1 and y = 1").count() == 0


def test_support(spark):
    rows = acts(spark, [1] * 49 + [0], [1] * 50)
    assert [r["idx"] for r in concepts.thresholds(rows, 50).collect()] == [1]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, y, g) for y, g in zip((1, 1, 0, 0, 1), (1, 0, 0, 1, 1))] + [(1, 0, 0)], "idx int, y int, guess int")
    found = {r["idx"]: (round(r["accuracy"], 6), round(r["recall"], 6), round(r["f1"], 6)) for r in concepts.binary_metrics(rows).collect()}
    assert found == {0: (0.6, 0.666667, 0.666667), 1: (1.0, 0.0, 0.0)}


def test_autoencoder_by_hand(spark):
    w = autoencoder.Weights(np.array([[1.0, 0], [0, 1], [1, 1]]), np.zeros(3), np.zeros(2))
    rows = spark.createDataFrame([(1, [1.0, -2.0]), (2, None)], "row_id long, embedding array<double>")
    coded = autoencoder.transform(rows, w)
    found = {r["row_id"]: (r["h"], r["xhat"]) for r in coded.collect()}
    assert found == {1: ([1.0, 0.0, 0.0], [1.0, 0.0]), 2: (None, None)}
    one = coded.where("row_id = 1")
    assert concepts.loss_terms(one, 2, 0.5).first()["loss"] == pytest.approx(2.5)
    report = concepts.reconstruction_report(one).first()
    assert report["mean_zeros"] == 2 and report["mean_cosine"] == pytest.approx(0.447214, abs=1e-6) and report["loss_percent"] == pytest.approx(55.27864, abs=1e-5)


def test_autoencoder_slopes():
    r = np.random.default_rng(0)
    x, w = r.normal(size=(7, 4)), autoencoder.Weights(r.normal(size=(6, 4)), r.normal(size=6), r.normal(size=4))
    _, slope = autoencoder.slopes(x, w, 0.1)
    for part in range(3):
        for at in np.ndindex(w[part].shape):
            up, down = (autoencoder.Weights(*(p.copy() for p in w)) for _ in range(2))
            up[part][at] += 1e-6
            down[part][at] -= 1e-6
            assert slope[part][at] == pytest.approx((autoencoder.slopes(x, up, 0.1)[0] - autoencoder.slopes(x, down, 0.1)[0]) / 2e-6, abs=1e-4)


def _waves(spark, n=40):
    return spark.createDataFrame([([float(np.sin(i * j)) for j in range(1, 5)],) for i in range(n)] + [(None,)], "embedding array<double>")


def test_slopes_of_many_rows_take_a_block_of_memory():
    r = np.random.default_rng(1)
    x, w = r.normal(size=(20_011, 8)), autoencoder.Weights(r.normal(size=(12, 8)), r.normal(size=12), r.normal(size=8))
    tracemalloc.start()
    loss, slope = autoencoder.slopes(x, w, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 4
    h = w.encode(x)
    off = w.decode(h) - x
    d = (2 * off / 8 @ w.w.T + 0.1) * (h > 0)
    assert loss == pytest.approx((off**2).sum() / 8 + 0.1 * h.sum(), rel=1e-12)
    assert all(np.allclose(p, q, rtol=1e-10) for p, q in zip(slope, (d.T @ x + h.T @ (2 * off / 8), d.sum(axis=0), (2 * off / 8).sum(axis=0))))
    loss, slope = autoencoder.slopes(x[:0], w, 0.1)
    assert loss == 0 and not any(p.any() for p in slope)


def test_training_by_one_task_or_several_is_the_same(spark):
    runs = [autoencoder.train(_waves(spark), AutoencoderConfig(epochs=12, tasks=tasks, keep_every=5)) for tasks in (1, 4, 8)]
    for weights, losses in runs[1:]:
        assert losses == pytest.approx(runs[0][1]) and np.allclose(weights.w, runs[0][0].w)
    assert len(runs[0][1]) == 12 and runs[0][1][-1] < runs[0][1][0]
    with pytest.raises(RuntimeError):
        autoencoder.train(_waves(spark).limit(0), AutoencoderConfig(epochs=1))


def test_training_is_full_batch_adam(spark):
    """Against steps written out here."""
    config = AutoencoderConfig(epochs=3, tasks=2)
    x = np.array([r[0] for r in _waves(spark).collect() if r[0]])
    at = autoencoder.initial(4, config)
    m, v = ([np.zeros_like(p) for p in at] for _ in range(2))
    for t in range(1, 4):
        slope = autoencoder.slopes(x, at, config.alpha)[1]
        m, v = [0.9 * a + 0.1 * s for a, s in zip(m, slope)], [0.999 * a + 0.001 * s * s for a, s in zip(v, slope)]
        at = autoencoder.Weights(*(p - config.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8) for p, a, b in zip(at, m, v)))
    found = autoencoder.train(_waves(spark), config)[0]
    assert all(np.allclose(a, b) for a, b in zip(found, at))


def test_vectors_of_floats_are_worked_on_in_single_precision(spark, monkeypatch):
    r = np.random.default_rng(2)
    x, w = r.normal(size=(1500, 8)).astype(np.float32), autoencoder.Weights(r.normal(size=(12, 8)), r.normal(size=12), r.normal(size=8))
    loss, slope = autoencoder.slopes(x.astype(np.float64), w, 0.1)
    kinds, product = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: kinds.extend((a.dtype, b.dtype, out.dtype)) or product(a, b, out=out))
    single = autoencoder.slopes(x, w, 0.1)
    assert len(kinds) == 18 and set(kinds) == {np.dtype(np.float32)}  # three products of two blocks
    assert single[0] == pytest.approx(loss, rel=1e-6) and all(p.dtype == np.float64 and np.allclose(p, q, rtol=1e-4, atol=1e-3) for p, q in zip(single[1], slope))
    monkeypatch.undo()
    floats = _waves(spark).select(F.col("embedding").cast("array<float>").alias("embedding"))
    runs = [autoencoder.train(rows, AutoencoderConfig(epochs=12)) for rows in (_waves(spark), floats)]
    assert runs[1][1] == pytest.approx(runs[0][1], rel=1e-5) and np.allclose(runs[1][0].w, runs[0][0].w, atol=1e-5)


def test_equal_vectors_are_held_once_and_count_as_often_as_they_occur(spark):
    rows = _waves(spark).crossJoin(spark.range(3)).select("embedding").union(_waves(spark, 7))
    assert sorted(r["times"] for r in autoencoder.vectors(rows).collect()) == [3] * 33 + [4] * 7
    x, times = np.array([r[0] for r in _waves(spark).collect() if r[0]]), np.where(np.arange(40) < 7, 4, 3)
    config = AutoencoderConfig(epochs=9, tasks=2, keep_every=5)
    adam, losses = autoencoder.Adam(autoencoder.initial(4, config), config), []
    for _ in range(9):
        loss, slope = autoencoder.slopes(np.repeat(x, times, axis=0), adam.at, config.alpha)
        once = autoencoder.slopes(x, adam.at, config.alpha, times)
        assert once[0] == pytest.approx(loss) and all(np.allclose(p, q) for p, q in zip(once[1], slope))
        losses.append(loss)
        adam.move(slope)
    found = autoencoder.train(rows, config)
    assert found[1] == pytest.approx(losses) and all(np.allclose(p, q) for p, q in zip(found[0], adam.at))


def test_training_goes_on_from_kept_weights(spark, tmp_path):
    whole = autoencoder.train(_waves(spark), AutoencoderConfig(epochs=9))
    first = autoencoder.train(_waves(spark), AutoencoderConfig(epochs=6, keep_every=3), str(tmp_path))
    more = autoencoder.train(_waves(spark), AutoencoderConfig(epochs=9, keep_every=3, tasks=2), str(tmp_path))
    assert more[1][:6] == first[1] and more[1] == pytest.approx(whole[1]) and np.allclose(more[0].w, whole[0].w)
    import shutil

    shutil.rmtree(next(tmp_path.iterdir()) / "9")  # the run broke off before its last part was written
    assert autoencoder.train(_waves(spark), AutoencoderConfig(epochs=9, keep_every=3), str(tmp_path))[1] == pytest.approx(whole[1])
    other = autoencoder.train(_waves(spark), AutoencoderConfig(epochs=9, keep_every=3, rate=1e-2), str(tmp_path))
    assert other[1][-1] != pytest.approx(whole[1][-1])


def test_scores(spark):
    cavs = spark.createDataFrame([(3, [1.0, 2.0, -1.0])], "idx int, cav array<double>")
    gradient = spark.createDataFrame([([0.5, -1.0, 2.0],)], "gradient array<double>")
    assert concepts.concept_scores(cavs, gradient).first()["score"] == -3.5


def test_logistic_coefficients_are_newtons(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3))
    y = (x @ [1.0, -2, 0.5] + r.normal(size=200) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "features array<double>, y int")
    model = concepts.logistic(rows, 500)
    theta, full = np.zeros(4), np.hstack([x, np.ones((200, 1))])
    penalty = np.diag([1.0, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ theta))
        theta -= np.linalg.solve(full.T @ (full * (p * (1 - p))[:, None]) + penalty, full.T @ (p - y) + penalty @ theta)
    assert np.allclose(model.coefficients.toArray(), theta[:3], atol=1e-4)


def test_trees_explain_a_unit(spark):
    rows = spark.createDataFrame([(i, [float(i % 10), float(i % 3)]) for i in range(300)], "row_id long, features array<double>")
    marks = rows.select("row_id", F.lit(4).alias("idx"), (F.col("features")[0] > 5).cast("int").alias("y"))
    metrics, models = concepts.unit_trees(rows, marks, rows, marks, TreeConfig(max_depths=(2,), min_rows=5, folds=2))
    assert metrics.first()["kept"] and metrics.first()["f1"] == 1.0
    graph = sinks.tree_graph(models[4].toDebugString, ["tens", "threes"])
    assert graph.startswith("digraph") and "tens" in graph and "->" in graph


def test_test_targets_are_not_broadcast(spark):
    """Their files are small, their rows aren't; repeated, unknown and unmatched ones count as in a join by row and unit."""
    rows = spark.createDataFrame([(i, [float(i % 10), float(i % 3)]) for i in range(300)] + [(7, [9.0, 0.0])], "row_id long, features array<double>")
    marks = spark.createDataFrame([(i, u, None if i % 50 == 0 else int(i % 10 > 3 + u)) for i in range(320) for u in (1, 2)] + [(3, 1, 1), (4, 9, 1)], "row_id long, idx int, y int")
    test = lambda limit: trees.UnitTree([0, -1, -1], [limit, 0.0, 0.0], [1, -1, -1], [2, -1, -1], [0, 0, 1])
    found = concepts.guess_metrics(rows, marks, {1: test(4.0), 2: test(6.0)})
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    guesses = rows.select("row_id", F.explode(F.array(*[F.struct(F.lit(u).alias("idx"), (F.col("features")[0] > limit).cast("int").alias("guess")) for u, limit in ((1, 4.0), (2, 6.0))])).alias("g")).select("row_id", "g.*")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, concepts.binary_metrics(guesses.join(marks, ["row_id", "idx"])).collect()))


def test_trees_are_grown_best_split_first():
    """By hand: three blocks of rows, two leaves more than the first split; a bound on leaves keeps the better one."""
    x = np.repeat(np.arange(12.0), 10)[:, None]
    y = np.repeat([0, 0, 0, 1, 1, 1, 0, 0, 0, 0, 0, 0], 10)
    every = np.arange(120)
    settings = {"balanced": False, "impurity": "gini", "max_depth": 5, "min_rows": 5}
    data = brute_trees.Binned.of(x)
    tree = brute_trees.grow(data, every, y, max_leaves=8, **settings)
    assert (tree.predict(x) == y).all() and sum(f < 0 for f in tree.feature) == 3
    assert sum(f < 0 for f in brute_trees.grow(data, every, y, max_leaves=2, **settings).feature) == 2
    assert brute_trees.grow(data, every, y, max_leaves=8, **(settings | {"min_rows": 61})).feature == [-1]
    assert brute_trees.grow(data, every, y, max_leaves=8, **(settings | {"max_depth": 1})).feature[1:] == [-1, -1]


def test_trees_find_the_best_split_of_all():
    """The first split of many small tables against trying all limits of all features."""
    r = np.random.default_rng(6)
    for _ in range(30):
        x, y = r.integers(0, 6, (60, 4)).astype(float), r.integers(0, 2, 60)
        for balanced in (True, False):
            for impurity in ("gini", "entropy"):
                w = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (1 - y).sum())) if balanced else np.ones(60)

                def cost(own):
                    total, p = w[own].sum(), w[own][y[own] == 1].sum() / w[own].sum()
                    return total * (2 * p * (1 - p) if impurity == "gini" else -sum(q * np.log2(q) for q in (p, 1 - p) if q))

                found = {(f, v): cost(x[:, f] <= v) + cost(x[:, f] > v) for f in range(4) for v in range(6) if min((x[:, f] <= v).sum(), (x[:, f] > v).sum()) >= 5}
                tree = brute_trees.grow(brute_trees.Binned.of(x), np.arange(60), y, balanced, impurity, 1, 5, 8)
                assert tree.feature[0] < 0 or found[tree.feature[0], tree.limit[0]] == pytest.approx(min(found.values()))


def _tables(spark, x, ys):
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "row_id long, features array<double>").repartition(5)
    marks = spark.createDataFrame([(i, u, int(c)) for u, y in ys.items() for i, c in enumerate(y)], "row_id long, idx int, y int")
    return rows, marks, marks.select("idx").distinct()


def folds_of(y, folds):
    """Either class dealt out in turn, in the order of a hash."""
    out = np.zeros(len(y), np.int64)
    for label in (0, 1):
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in np.flatnonzero(y == label))
        out[[i for _, i in own]] = np.arange(len(own)) % folds
    return out


def test_trees_of_all_units_are_those_grown_on_one_machine(spark):
    """500 rows, counts beside more values than bins, the whole grid."""
    r = np.random.default_rng(8)
    x = np.hstack([r.integers(0, 5, (500, 6)), r.normal(size=(500, 4))])
    ys = {3: (x[:, 0] + x[:, 7] > 2).astype(int), 7: (x[:, 1] * x[:, 8] + r.normal(size=500) > 0.5).astype(int), 9: (r.random(500) < 0.3).astype(int)}
    rows, marks, units = _tables(spark, x, ys)
    config = TreeConfig(min_rows=20)
    found = {t["idx"]: t for t in concepts.fit_trees(rows, marks, units, config).collect()}
    assert sorted(found) == [3, 7, 9]
    for u, y in ys.items():
        tree, chosen, score = brute_trees.search(x, y, config.grid(), folds_of(y, config.folds))
        t = found[u]
        assert trees.UnitTree(t["feature"], t["limit"], t["left"], t["right"], t["value"]) == tree
        assert (t["depth"], t["impurity"], t["balanced"]) == (chosen["max_depth"], chosen["impurity"], chosen["balanced"]) and t["cv_f1"] == pytest.approx(score)
        at = tree.feature.index(-1)
        assert t["n"][0] == 500 and t["positive"][0] == y.sum() and t["gain"][0] > 0 and t["gain"][at] == 0 and t["place"][:3] == ["", "L", "R"]


def test_trees_of_odd_tables(spark):
    """Missing features count as the greatest; rows without features or targets play no part; a unit of one class is a leaf."""
    rows = spark.createDataFrame([(i, [None if i % 7 == 0 else float(i), float("nan")]) for i in range(100)] + [(500, None), (501, [1.0, 2.0])], "row_id long, features array<double>")
    marks = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(100)] + [(i, 2, 1) for i in range(40)] + [(900, 1, 1)], "row_id long, idx int, y int")
    units = marks.select("idx").distinct()
    found = {t["idx"]: t for t in concepts.fit_trees(rows, marks, units, TreeConfig(min_rows=5, max_depths=(2,), folds=2)).collect()}
    assert found[2]["feature"] == [-1] and found[2]["value"] == [1] and found[2]["n"] == [40]
    assert found[1]["feature"][0] == 0 and found[1]["n"][0] == 100 and found[1]["cv_f1"] > 0.8
    assert concepts.fit_trees(rows, marks, units.limit(0), TreeConfig()).count() == 0
    assert concepts.fit_trees(rows.limit(0), marks, units, TreeConfig()).count() == 0


def test_order_statistics(spark):
    r = np.random.default_rng(4)
    values = {k: [*r.integers(0, 9, n).astype(float), *r.normal(size=n)] for k, n in ((1, 40), (2, 333), (3, 1))}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [(1, None), (4, None)], "k int, v double").repartition(7)
    found = {m["k"]: (m["n"], m["median"]) for m in order.medians(rows, "k", "v").collect()}
    assert found == {k: (len(vs), pytest.approx(np.median(vs))) for k, vs in values.items()}
    cuts = {c["k"]: c["limits"] for c in order.quantile_limits(rows, "k", "v", 64).collect()}
    for k, vs in values.items():
        u = np.unique(vs)
        assert cuts[k] == (u if len(u) <= 64 else np.unique(np.quantile(vs, np.arange(1, 64) / 64, method="lower"))).tolist()


def test_trees_are_kept_and_not_fitted_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 10), float(i % 3)]) for i in range(300)], "row_id long, features array<double>")
    marks = rows.select("row_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"), (F.col("features")[0] > 5).cast("int").alias("y"))
    config, path = TreeConfig(max_depths=(2,), min_rows=5, folds=2), str(tmp_path / "trees")
    one = marks.where("idx = 1")
    concepts.unit_trees(rows, one, rows, one, config, path)
    metrics, models = concepts.unit_trees(rows, marks, rows, marks, config, path)
    assert sorted(models) == [1, 2] and metrics.count() == 2
    flipped = marks.withColumn("y", 1 - F.col("y"))
    assert concepts.unit_trees(rows, flipped, rows, flipped, config, path)[1] == models
    assert concepts.unit_trees(rows, flipped, rows, flipped, TreeConfig(max_depths=(3,), min_rows=5, folds=2), path)[1] != models


def test_separators_are_newtons(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 3))
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "row_id long, embedding array<double>")
    marks = rows.select("row_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx")).join(rows, "row_id").select("row_id", "idx", (F.when(F.col("idx") == 0, F.col("embedding")[0]).otherwise(F.col("embedding")[1] - F.col("embedding")[2]) > 0.2).cast("int").alias("y"))
    found = concepts.separators_of(rows, marks)
    assert all(abs(s["slope"]) < 1e-6 for s in concepts.separator_slopes(rows, marks, found).collect())
    single = concepts.logistic(rows.join(marks.where("idx = 1"), "row_id"), 500, "embedding")
    assert np.allclose(found.where("idx = 1").first()["cav"], single.coefficients.toArray(), atol=1e-3)


def test_separators_of_any_number_of_rows_have_no_slope(spark):
    """12 000 rows, more partitions than are added up at once; a unit with a target for every other row only."""
    r = np.random.default_rng(3)
    x = r.normal(size=(12_000, 5))
    y = (x @ [1.0, -2, 0.5, 0, 3] + r.normal(size=12_000) > 0).astype(int)
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(20_000, None)], "row_id long, embedding array<double>").repartition(40)
    marks = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)] + [(i, 2, int(1 - y[i])) for i in range(0, 12_000, 2)] + [(30_000, 1, 1), (20_000, 1, 0)], "row_id long, idx int, y int")
    found = {s["idx"]: np.array([*s["cav"], s["intercept"]]) for s in concepts.separators_of(rows, marks).collect()}
    for unit, own, of in ((1, x, y), (2, x[::2], 1 - y[::2])):
        full, theta = np.hstack([own, np.ones((len(own), 1))]), found[unit]
        slope = full.T @ (1 / (1 + np.exp(-full @ theta)) - of) + np.array([*theta[:-1], 0.0])
        assert np.abs(slope).max() < 1e-7
    assert concepts.separators_of(rows, marks.limit(0)).count() == 0


def test_newton_halves_a_step_that_goes_too_far():
    """One separable direction of great scale: the whole step from zero overshoots."""
    x, y = np.array([[-40.0, 1], [-39, 1], [1, 1], [60, 1]]), np.array([0.0, 1, 0, 1])
    theta, at, size, seen = np.zeros(2), None, 1.0, 0
    tried = theta
    for _ in range(200):
        now = separators.At.of(separators.sums(x, y, tried), tried)
        if at is None or now.loss < at.loss:
            theta, at, size = tried, now, 1.0
        else:
            size, seen = size / 2, seen + 1
        if at.slope < 1e-9 or size < 1e-6:
            break
        tried = theta - size * at.step
    assert at.slope < 1e-6


def test_whole_run(spark, small):
    config = CohortConfig(cap_positive=60, cap_negative=60, top_k=15)
    made = pipeline.prepare(sources.order_events(spark, small), config, None)
    train, test = pipeline.model_inputs(made, config)
    coded, coded_test, weights, losses = pipeline.represent(train, test, autoencoder.ProjectionEmbedder(15, 12), AutoencoderConfig(epochs=30))
    assert losses[-1] < losses[0] and weights.w.shape == (18, 12)
    coded, coded_test = coded.cache(), coded_test.cache()
    metrics, scores = pipeline.explain(coded, coded_test, (train, test), TreeConfig(max_depths=(2,), impurities=("gini",), min_rows=3, least_f1=0.0), support=10)
    assert metrics.count() > 0 and scores.count() == metrics.where("kept").count()


def test_sinks(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for mark, n in (("a", 1), ("a", 1), ("b", 2)):
        assert sinks.read_or_compute(spark, str(tmp_path), "t", mark, compute).count() == 3
        assert len(calls) == n
    sinks.append_report(str(tmp_path / "deep" / "r.txt"), {"loss": 1.5})
    assert "loss: 1.5" in (tmp_path / "deep" / "r.txt").read_text()
    sinks.save_weights(spark, {"w": [[1, 2], [3, 4]], "b": [[5]]}, str(tmp_path / "w"))
    assert sinks.load_weights(spark, str(tmp_path / "w")) == {"w": [[1.0, 2.0], [3.0, 4.0]], "b": [[5.0]]}
    assert CohortConfig().fingerprint() != CohortConfig(top_k=1).fingerprint()
