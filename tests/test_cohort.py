"""Rules of the cohort engine on hand-made rows, golden counts, and properties of a whole run."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.config import BoostingConfig, CohortConfig
from eventide.operators import boosting, cohort, matrix, preprocess, selection
from eventide.plans import pipeline
from eventide.sources import events as sources

DAY = dt.datetime(2000, 1, 1)
LOG = "patient_id string, year int, event string, date timestamp_ntz"


def log(spark, rows):
    return spark.createDataFrame([(p, y, e, DAY if d else None) for p, y, e, d in rows], LOG)


def table(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_terminal_is_found_anywhere_in_any_case(spark):
    rows = spark.createDataFrame([(x,) for x in ("death", "DEATH x", None, "unDeAthly", "X")], "event string")
    assert [r[0] for r in rows.select(sources.is_terminal("(?i)DEATH")).collect()] == [True, True, False, True, False]


def test_canonical_events(spark):
    rows = spark.createDataFrame([(7, dt.datetime(2001, 5, 6), "A", 1), (8, dt.datetime(2002, 1, 1), None, 2)], "patient_id int, date timestamp_ntz, event string, year int")
    assert table(sources.canonical_events(rows)) == [("7", dt.datetime(2001, 5, 6), 2001, "A"), ("8", dt.datetime(2002, 1, 1), 2002, None)]
    for bad in ((None, DAY, "A"), (1, None, "A")):
        broken = spark.createDataFrame([bad], "patient_id int, date timestamp_ntz, event string")
        with pytest.raises(Exception, match="null"):
            sources.canonical_events(broken).collect()


def test_pivot_counts_dates(spark):
    rows = log(spark, [("a", 1, "X", 1), ("a", 1, "X", 0), ("a", 2, "Y", 1), ("b", 1, "X", 0), ("b", 1, "DEATH", 1), ("b", 3, "other", 1), ("b", 4, None, 1)])
    wide = matrix.align(matrix.pivot_counts(rows, ["X", "Y", "DEATH"]), ["X", "Y", "Z", "DEATH"])
    assert wide.columns == ["patient_id", "year", "X", "Y", "Z", "DEATH"]
    assert table(wide) == [("a", 1, 1, 0, 0, 0), ("a", 2, 0, 1, 0, 0), ("b", 1, 0, 0, 0, 1)]


def test_pivot_keeps_a_row_without_dates(spark):
    wide = matrix.pivot_counts(log(spark, [("a", 1, "X", 1), ("c", 1, "Z", 0)]), ["X", "Z"])
    assert table(wide) == [("a", 1, 1, 0), ("c", 1, 0, 0)]


def test_repeated_events_count_in_the_matrix_alone(spark):
    rows = log(spark, [("a", 1, "X", 1), ("a", 1, "X", 1)])
    assert table(matrix.long_counts(rows)) == [("a", 1, "X", 2)]
    assert table(cohort.availability(rows, "(?i)DEATH"), "n_rows") == [(1,)]
    assert table(selection.event_frequency(rows, CohortConfig())) == [("X", 1)]


def test_presence_option(spark):
    rows = log(spark, [("a", 1, "X", 1), ("a", 2, "Y", 1)])
    assert table(matrix.pivot_counts(rows, ["X"], rows)) == [("a", 1, 1), ("a", 2, 0)]


def test_trim_keeps_the_terminal_period(spark):
    rows = spark.createDataFrame([("p1", y, int(y in (2000, 2002))) for y in range(1999, 2003)] + [("p2", 2001, 0), ("p2", 2003, 0)], "patient_id string, year int, DEATH long")
    assert table(matrix.trim_after_terminal(rows), "patient_id", "year") == [("p1", 1999), ("p1", 2000), ("p2", 2001), ("p2", 2003)]


@pytest.mark.parametrize(
    ("years", "train"),
    [([1990, *range(1997, 2007), 2010], [*range(1997, 2007)]), ([*range(1995, 2002)], [1995, 1996, 1997])],
)
def test_split_periods(spark, years, train):
    rows = spark.createDataFrame([(y,) for y in years], "year int")
    assert cohort.train_test_periods(rows, CohortConfig().forced_periods) == (train, [y for y in years if y not in train])


def test_a_single_period_cannot_be_split(spark):
    with pytest.raises(RuntimeError):
        cohort.train_test_periods(spark.createDataFrame([(2024,)], "year int"), CohortConfig().forced_periods)


def available(spark, pos, neg):
    """Entities whose shuffled order is that of the given row counts."""
    ids = spark.range(200).select(F.col("id").cast("string").alias("patient_id"))
    order = [[r["patient_id"] for r in cohort.in_hash_order(ids, cohort.shuffle_key(s)).orderBy("rn").collect()] for s in (42, 43)]
    rows = [(p, n, True) for p, n in zip(order[0], pos)]
    taken = {r[0] for r in rows}
    rows += [(p, n, False) for p, n in zip([p for p in order[1] if p not in taken], neg)]
    return spark.createDataFrame(rows, "patient_id string, n_rows long, is_pos boolean")


def test_balanced_selection_and_fallback(spark):
    rows = available(spark, [3, 4, 5], [2, 2, 9, 1])
    sums = lambda df: {r["is_pos"]: (r["n"], r["rows"]) for r in df.groupBy("is_pos").agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows")).collect()}
    assert sums(cohort.select_balanced(rows, 8, 8)) == {True: (2, 7), False: (2, 4)}
    assert sums(cohort.select_balanced(rows, 2, 8)) == {True: (3, 12), False: (3, 13)}
    with pytest.raises(RuntimeError):
        cohort.select_balanced(rows.where("not is_pos"), 8, 8)


def test_hash_order_is_that_of_a_sort(spark):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("patient_id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    found = cohort.in_hash_order(ids, cohort.shuffle_key(1), ("g",), "v").withColumn("key", cohort.shuffle_key(1)).collect()
    for g in range(3):
        own = sorted((r for r in found if r["g"] == g), key=lambda r: (r["key"], r["patient_id"]))
        assert [r["rn"] for r in own] == list(range(1, 1001)) and {r["total"] for r in own} == {1000}
        total = 0
        for r in own:
            total += r["v"]
            assert r["cum"] == total


def test_a_late_terminal_event_leaves_an_entity_negative(spark):
    rows = log(spark, [("a", 1, "X", 1), ("a", 3, "DEATH", 1)])
    assert table(cohort.availability(cohort.within(rows, years=[1, 2]), "(?i)DEATH"), "is_pos") == [(False,)]


@pytest.mark.parametrize(
    ("sf", "cap", "want"),
    [("sf0.001", 20, (135, 15, 133, 8, 15, 20, 31, 8, 40, 5)), ("sf0.01", 200, (1350, 150, 1332, 87, 145, 200, 288, 87, 312, 34))],
)
def test_golden_run(spark, sf, cap, want):
    config = CohortConfig(cap_positive=cap, cap_negative=cap, max_rows=10_000, top_k=20)
    log_ = sources.order_events(spark, f"/root/testdata/{sf}").cache()
    made = pipeline.prepare(log_, config, None)
    split = cohort.split_entities(log_)
    train_ids = split.where(~F.col("is_test"))
    own = cohort.availability(cohort.within(log_, train_ids, made.train_years), config.entity_terminal)
    chosen = {r["is_pos"]: (r["n"], r["rows"]) for r in made.selected.groupBy("is_pos").agg(F.count("*").alias("n"), F.sum("n_rows").alias("rows")).collect()}
    train, test = made.train_rows.cache(), made.test_rows.cache()
    found = (train_ids.count(), split.where("is_test").count(), own.count(), chosen[True][0], chosen[True][1], chosen[False][1], train.count(), train.where("DEATH > 0").count(), test.count(), test.where("DEATH > 0").count())
    assert found == want and chosen[True][0] == chosen[False][0]
    assert train.join(test, "patient_id").count() == 0 and not set(made.train_years) & set(made.test_years)
    assert train.columns == test.columns == ["patient_id", "year", *made.features, "DEATH"]
    longer = pipeline.prepare(log_, CohortConfig(cap_positive=cap, cap_negative=cap, top_k=20, keep_presence=True), None)
    assert longer.train_rows.count() >= train.count()
    log_.unpersist()


def counted(spark, rows):
    """An event log with so many events of each name for each entity."""
    made = spark.createDataFrame([(p, e, n) for p, counts in rows.items() for e, n in counts.items() if n], "patient_id string, event string, n int")
    return made.select("patient_id", F.lit(2000).alias("year"), "event", F.explode(F.sequence(F.lit(1), "n"))).select("patient_id", F.lit("2000-01-01").cast("timestamp_ntz").alias("date"), "year", "event")


def brute_boost(x, y, config):
    """(round, place, feature, limit, gain, rows) of every split, by trying every limit of every feature in every leaf."""
    n, pos = len(y), y.sum()
    w, score, out = np.where(y == 1, (n - pos) / pos, 1.0), np.full(n, np.log(pos / (n - pos))), []
    for turn in range(config.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)

        def best(own):
            found = []
            for f in range(x.shape[1]):
                for v in np.unique(x[:, f])[:-1]:
                    low, high = own & (x[:, f] <= v), own & (x[:, f] > v)
                    if min(low.sum(), high.sum()) >= config.min_rows:
                        found.append((round(sum(g[s].sum() ** 2 / h[s].sum() for s in (low, high)) - g[own].sum() ** 2 / h[own].sum(), 9), -f, -v))
            top = max(found, default=(0, 0, 0))
            return top if top[0] > 0 else None

        leaves = {"": np.ones(n, bool)}
        offers = {"": best(leaves[""])}
        while len(leaves) < config.leaves and any(offers.values()):
            place = max((k for k in offers if offers[k]), key=lambda k: offers[k][0])
            gain, f, v = offers.pop(place)
            own = leaves.pop(place)
            out.append((turn, place, -f, -v, gain, int(own.sum())))
            for side, part in (("L", own & (x[:, -f] <= -v)), ("R", own & (x[:, -f] > -v))):
                leaves[place + side], offers[place + side] = part, best(part)
        for own in leaves.values():
            score[own] -= config.step_size * g[own].sum() / h[own].sum()
    return out


def test_boosted_splits_against_every_limit(spark):
    r = np.random.default_rng(11)
    x = np.minimum(r.poisson(0.7, (300, 8)), 4)
    y = (x[:, 0] + 2 * x[:, 1] * (x[:, 2] == 0) - x[:, 3] + r.normal(size=300) > 1).astype(int)
    x[:, 7] = 1  # so that every entity has a row
    names = [f"e{i}" for i in range(8)]
    log_ = counted(spark, {str(i): dict(zip(names, map(int, v))) | {"DEATH": int(d), "other": 1} for i, (v, d) in enumerate(zip(x, y))})
    config = BoostingConfig(rounds=4, leaves=6, min_rows=10)
    want = brute_boost(x, y, config)
    assert len(want) == 20
    for tasks in (1, 3):
        found = {(s["round"], s["place"]): (s["event"], s["limit"], s["gain"], s["n"]) for s in boosting.boosted_splits(log_, names, "DEATH", replace(config, tasks=tasks)).collect()}
        assert set(found) == {(t, p) for t, p, *_ in want}
        for t, p, f, v, gain, n in want:
            assert found[t, p][:2] == (names[f], v) and found[t, p][2] == pytest.approx(gain, abs=1e-6) and found[t, p][3] == n


def test_gain_ranking(spark):
    log_ = counted(spark, {str(i): {"good": i % 2, "noise": i % 3, "DEATH": i % 2} for i in range(120)})
    found = {r["event"]: r["gain"] for r in selection.gain_ranking(log_, ["good", "noise", "never"], "DEATH", BoostingConfig(rounds=3)).collect()}
    assert found["good"] > found["noise"] and found["never"] == 0
    with pytest.raises(RuntimeError):
        selection.gain_ranking(log_.where("event <> 'DEATH'"), ["good"], "DEATH", BoostingConfig(rounds=1))
    alone = log_.where("event = 'DEATH'")
    assert [r["gain"] for r in selection.gain_ranking(alone, ["good"], "DEATH", BoostingConfig(rounds=1)).collect()] == [0.0]


def test_the_plan_of_sparse_rows_does_not_grow_with_the_candidates(spark):
    log_ = counted(spark, {"a": {"x": 1, "DEATH": 1}})
    sizes = {len(boosting.sparse_rows(log_, spark.createDataFrame([(f"e{i}", i) for i in range(n)], "event string, code int"), "DEATH").columns) for n in (1, 500)}
    assert sizes == {5}
    rows = boosting.sparse_rows(log_, spark.createDataFrame([("x", 0), ("y", 1)], "event string, code int"), "DEATH").collect()
    assert [(r["codes"], r["counts"], r["label"]) for r in rows] == [([0], [1], 1)]


def test_wide_tables(spark):
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, None)], "a int, gone int, o int")
    out = preprocess.with_outcome(rows, "o", ("gone", "never_there"))
    assert out.columns == ["a", "outcome"] and table(out) == [(1, 1)]
    filled = preprocess.impute_median(spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (10.0, float("nan"))], "x double, none double"), ["x", "none"])
    assert filled.columns == ["x"] and table(filled) == [(1.0,), (3.0,), (3.0,), (10.0,)]
    scaled = preprocess.standardise(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double"), ["x", "c"])
    assert [(round(a, 6), b) for a, b in table(scaled)] == [(-1.224745, 0.0), (0.0, 0.0), (1.224745, 0.0)]
    fit = preprocess.impute_median(spark.createDataFrame([(None,)], "x double"), ["x"], spark.createDataFrame([(4.0,)], "x double"))
    assert table(fit) == [(4.0,)]


def test_empty_log(spark):
    rows = log(spark, [])
    assert cohort.availability(rows, "(?i)DEATH").count() == 0
    assert matrix.pivot_counts(rows, ["X"]).columns == ["patient_id", "year", "X"]
    assert cohort.split_entities(rows).count() == 0
