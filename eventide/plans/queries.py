"""The registered queries: each operator on the canonical views, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AutoencoderConfig, BoostingConfig, CohortConfig, EmbeddingConfig, TreeConfig
from ..functions.arrays import affine, relu
from ..operators import autoencoder, boosting, cohort, concepts, matrix, preprocess, selection
from ..operators.embedding import FoldedEmbedder
from ..sources import events as sources
from ..sources import sinks
from ..sources.arrowfiles import read_runs
from ..sources.scratch import materialize, scratch_path
from ..streaming import events as streams
from . import pipeline

#: Caps and features that bind on the small tables too.
CONFIG = CohortConfig(cap_positive=200, cap_negative=200, max_rows=400, candidates=40, top_k=20)
CANDIDATES = CohortConfig().candidates
PATTERN, TERMINAL = CONFIG.entity_terminal, CONFIG.row_terminal
UNITS, WIDTH, ALPHA = 6, 64, 5e-4
#: Fixed weights that SQL can write down too.
WEIGHTS = autoencoder.Weights(np.array([[((i * 31 + j * 17) % 13 - 6) / 10 for j in range(WIDTH)] for i in range(UNITS)]), np.array([(i % 3 - 1) / 10 for i in range(UNITS)]), np.array([(j % 5 - 2) / 10 for j in range(WIDTH)]))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(column: str | F.Column, name: str | None = None) -> F.Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6).alias(name or column)


def joined(column: str) -> F.Column:
    return F.concat_ws(",", F.col(column).cast("array<string>")).alias(column)


def _train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int], DataFrame]:
    """The event log, written once as in :func:`pipeline.prepare`; the train periods; the train entities."""
    log = materialize(sources.order_events(spark, sf_dir), "log")
    train, _ = cohort.train_test_periods(log, CONFIG.forced_periods)
    return log, train, cohort.split_entities(log, CONFIG.seed, CONFIG.test_percent).where(~F.col("is_test")).select("patient_id")


def _availability(log: DataFrame, train: list[int], entities: DataFrame) -> DataFrame:
    """Of train entities: their histories, one row each, meet the split, not their events."""
    return cohort.availability(cohort.within(log, years=train), PATTERN).join(entities, "patient_id", "left_semi")


def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _availability(*_train(spark, sf_dir))


def _selected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected entities are written, so that Spark knows how few they are and leaves the log where it is."""
    log, train, entities = _train(spark, sf_dir)
    chosen = cohort.select_balanced(_availability(log, train, entities), CONFIG.cap_positive, CONFIG.cap_negative, CONFIG.seed)
    return cohort.within(log, materialize(chosen.select("patient_id"), "chosen"), train)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "embedding", "label")


def _long(rows: DataFrame, names: list[str]) -> DataFrame:
    """Wide rows as (patient_id, year, event, n), zeros included: columns that don't depend on the data."""
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("event"), F.col(f"`{v}`").alias("n")) for v in names]))
    return rows.select("patient_id", "year", cells.alias("cell")).select("patient_id", "year", "cell.event", "cell.n")


@query
def scan_canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.order_events(spark, sf_dir)


@query
def scan_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.user_events(spark, sf_dir)


@query
def terminal_regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sources.order_events(spark, sf_dir)
    return log.where(sources.is_terminal(PATTERN)).select("patient_id", "year").distinct()


@query
def first_terminal_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.first_terminal(sources.order_events(spark, sf_dir), PATTERN)


@query
def presence_years_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.presence(sources.order_events(spark, sf_dir)).select("patient_id", joined("years"), F.size("years").cast("long").alias("n_years"))


@query
def period_split_forced_or_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.split_periods(sources.order_events(spark, sf_dir), CONFIG.forced_periods)


@query
def period_split_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.split_periods(sources.user_events(spark, sf_dir), CONFIG.forced_periods)


@query
def anti_join_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sources.order_events(spark, sf_dir)
    train = cohort.split_periods(log, CONFIG.forced_periods).where("is_train").select("year")
    return log.select("year").distinct().join(train, "year", "left_anti")


@query
def entity_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.split_entities(sources.order_events(spark, sf_dir), CONFIG.seed, CONFIG.test_percent)


@query
def membership_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, train, entities = _train(spark, sf_dir)
    top = selection.most_frequent(cohort.within(log, entities, train), CONFIG, CONFIG.top_k)
    return cohort.within(log, entities, train, top)


@query
def availability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _available(spark, sf_dir).select("patient_id", "n_rows", joined("years"), "is_pos")


@query
def running_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.running_rows(_available(spark, sf_dir), CONFIG.seed).select("patient_id", "is_pos", "n_rows", "rn", "cum")


@query
def balanced_cap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.select_balanced(_available(spark, sf_dir), CONFIG.cap_positive, CONFIG.cap_negative, CONFIG.seed).select("patient_id", "is_pos", "n_rows", "rn", "cum")


@query
def uncapped_fallback_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.select_balanced(_available(spark, sf_dir), 0, 0, CONFIG.seed).select("patient_id", "is_pos", "n_rows", "rn", "cum")


@query
def event_frequency_topm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.most_frequent(_selected_events(spark, sf_dir), CONFIG, CONFIG.candidates)


@query
def vocab_union_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = selection.most_frequent(_selected_events(spark, sf_dir), CONFIG, CONFIG.top_k).select("event")
    return top.union(spark.range(1).select(F.lit(TERMINAL).alias("event"))).distinct()


@query
def long_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.long_counts(sources.order_events(spark, sf_dir))


@query
def pivot_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["click", "error", "purchase", "signup", "view", TERMINAL]
    wide = matrix.pivot_counts(sources.user_events(spark, sf_dir), values)
    return wide.select("patient_id", "year", *[F.col(v).alias(f"n_{v.lower()}") for v in values])


@query
def pivot_align_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that has only some of the wanted events."""
    log = sources.user_events(spark, sf_dir).where("event = 'click'")
    values = ["click", "never_seen", TERMINAL]
    return matrix.align(matrix.pivot_counts(log, ["click"]), values).select("patient_id", "year", *[F.col(v).alias(f"n_{v.lower()}") for v in values])


@query
def presence_preserved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sources.user_events(spark, sf_dir)
    return matrix.pivot_counts(log, ["error"], log).select("patient_id", "year", F.col("error").alias("n_error"))


@query
def trim_post_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.trim_long(matrix.long_counts(sources.user_events(spark, sf_dir)), TERMINAL)


@query
def train_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.prepare(sources.order_events(spark, sf_dir), CONFIG, None)
    return _long(made.train_rows, selection.with_terminal(made.features, TERMINAL))


@query
def test_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pipeline.prepare(sources.order_events(spark, sf_dir), CONFIG, None)
    return _long(made.test_rows, selection.with_terminal(made.features, TERMINAL))


@query
def row_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix.pivot_counts(sources.order_events(spark, sf_dir), [TERMINAL], sources.order_events(spark, sf_dir))
    return matrix.labelled(rows, TERMINAL).select("patient_id", "year", "label")


@query
def class_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.class_ratio(row_label(spark, sf_dir)).select("n_pos", "n_neg", rounded("ratio"))


@query
def row_cap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.order_events(spark, sf_dir).select("patient_id", "year").distinct()
    return cohort.cap_rows(rows, CONFIG.max_rows, CONFIG.seed)


@query
def array_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["click", "error", "purchase", "signup", "view"]
    rows = matrix.pivot_counts(sources.user_events(spark, sf_dir), [*values, TERMINAL])
    own = matrix.feature_arrays(rows, values, TERMINAL)
    return own.select("patient_id", "year", F.concat_ws(",", F.col("features").cast("array<int>").cast("array<string>")).alias("features"), "label")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, parts and customers give no nulls: a wide table with some, an outcome among its columns."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_orderkey").alias("row_id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_returnflag") != "N", (F.col("l_returnflag") == "R").cast("int")).alias("returned"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("price"),
        F.lit(1.0).alias("constant"),
        F.col("l_shipdate").alias("shipped"),
    )


@query
def wide_outcome_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.with_outcome(_wide(spark, sf_dir), "returned", ("shipped", "not_there"))


@query
def outcome_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and outcome taken apart, each counted."""
    features, outcome = preprocess.split_outcome(preprocess.with_outcome(_wide(spark, sf_dir), "returned", ("shipped",)))
    found = outcome.groupBy("outcome").agg(F.count("*").alias("n")).crossJoin(features.agg(F.count("*").alias("n_rows"), F.count("price").alias("n_prices")))
    return found.withColumn("columns", F.lit(",".join(features.columns)))


@query
def normalised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays with gaps, imputed and standardised position by position."""
    own = _wide(spark, sf_dir).select("row_id", "line", F.array(F.col("quantity").cast("double"), F.col("price").cast("double")).alias("features"))
    return preprocess.normalised(own).select("row_id", "line", *[rounded(F.col("features")[i], n) for i, n in enumerate(("quantity", "price"))])


@query
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preprocess.impute_median(_wide(spark, sf_dir).drop("shipped"), ["quantity", "price"])
    return rows.select("row_id", "line", rounded("quantity"), rounded("price"))


@query
def standardise_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preprocess.standardise(_wide(spark, sf_dir).drop("shipped"), ["quantity", "price", "constant"])
    return rows.select("row_id", "line", rounded("quantity"), rounded("price"), rounded("constant"))


@query
def unit_positive_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.thresholds(_embeddings(spark, sf_dir), 240, column="embedding").select("idx", "n_positive", rounded("threshold"))


@query
def binarise_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return concepts.binarise(rows, concepts.thresholds(rows, 240, column="embedding"), column="embedding")


@query
def useful_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    marks = concepts.binarise(rows, concepts.thresholds(rows, 50, column="embedding"), column="embedding")
    return concepts.useful_units(marks.where("row_id % 2 = 0"), marks.where("row_id % 2 = 1"))


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units above their threshold as guesses of the upper half of the labels; 0.35 as the gate on f1."""
    rows = _embeddings(spark, sf_dir)
    marks = concepts.binarise(rows, concepts.thresholds(rows, 50, column="embedding"), column="embedding").withColumnRenamed("y", "guess")
    own = marks.join(rows.select("row_id", (F.col("label") >= 5).cast("int").alias("y")), "row_id")
    return concepts.binary_metrics(own).where("f1 >= 0.35").select("idx", "n", rounded("accuracy"), rounded("recall"), rounded("f1"))


@query
def affine_relu_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = autoencoder.transform(_embeddings(spark, sf_dir), WEIGHTS)
    return coded.select("row_id", F.posexplode("h").alias("idx", "h")).select("row_id", "idx", rounded("h"))


@query
def affine_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = autoencoder.transform(_embeddings(spark, sf_dir), WEIGHTS)
    return coded.select("row_id", F.posexplode("xhat").alias("pos", "xhat")).select("row_id", "pos", rounded("xhat"))


@query
def affine_in_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoder as an expression of the plan, without Python."""
    code = relu(affine(F.col("embedding"), WEIGHTS.w.tolist(), WEIGHTS.b_e.tolist()))
    return _embeddings(spark, sf_dir).select("row_id", F.posexplode(code).alias("idx", "h")).select("row_id", "idx", rounded("h"))


@query
def row_cosine_and_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = concepts.reconstruction_report(autoencoder.transform(_embeddings(spark, sf_dir), WEIGHTS))
    return found.select(rounded("mean_cosine"), rounded("loss_percent"), rounded("mean_zeros"))


@query
def sae_loss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = concepts.loss_terms(autoencoder.transform(_embeddings(spark, sf_dir), WEIGHTS), WIDTH, ALPHA)
    return found.select(rounded("reconstruction"), rounded("sparsity"), rounded("loss"))


@query
def concept_dot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first embeddings' means by label as concepts, the mean of all as the gradient."""
    cells = concepts.by_unit(_embeddings(spark, sf_dir).select("row_id", F.struct("label").alias("k"), "embedding"), column="embedding")
    cells = cells.join(_embeddings(spark, sf_dir).select("row_id", "label"), "row_id")
    means = cells.groupBy("label", "idx").agg(F.avg(F.col("act").cast("double")).alias("m"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("idx", "m"))), lambda x: x["m"])
    cavs = means.groupBy(F.col("label").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct(means["idx"], "m"))), lambda x: x["m"]).alias("cav"))
    gradient = cells.groupBy("idx").agg(F.avg(F.col("act").cast("double")).alias("m")).agg(vector.alias("gradient"))
    return concepts.concept_scores(cavs, gradient).select("idx", rounded("score"))


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """The table's files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if _is_folder(spark, path) else f"{path}*")


@query
def stream_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the table's files, run until all are read; each batch replaces the table of counts."""
    named = sources.canonical_events(_stream(spark, f"{sf_dir}/events.parquet"), entity="user_id", date="ts", event="event_type")
    out, counts = scratch_path(spark, "stream"), streams.bucket_counts(named)
    running = counts.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark, "stream-state")).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).select(F.date_format("bucket_start", "yyyy-MM-dd").alias("day"), "event", "n")


@query
def stream_first_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first terminal event by keyed state with timers, of those that the watermark has passed."""
    log = _stream(spark, f"{sf_dir}/events.parquet").where("event_type = 'error' and value > 150").withColumn("event", F.lit(TERMINAL))
    found = streams.first_terminal(sources.canonical_events(log, entity="user_id", date="ts"), PATTERN)
    out, before = scratch_path(spark, "stream"), spark.conf.get(streams.STATE_STORE[0], None)
    spark.conf.set(*streams.STATE_STORE)
    try:
        running = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.unset(streams.STATE_STORE[0]) if before is None else spark.conf.set(streams.STATE_STORE[0], before)
    return spark.read.schema(found.schema).parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query
def cached_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed and written by the first call, read by the second, which must not compute."""
    root = scratch_path(spark, "cached")
    sinks.read_or_compute(spark, root, "counts", "a", lambda: matrix.long_counts(sources.user_events(spark, sf_dir)))
    return sinks.read_or_compute(spark, root, "counts", "a", lambda: spark.range(0).toDF("never"))


@query
def weights_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' mean embeddings, and the fixed biases, as weights that are saved and loaded."""
    cells = _embeddings(spark, sf_dir).select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    means = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells")).orderBy("label").collect()  # a row for each label
    path = scratch_path(spark, "weights")
    sinks.save_weights(spark, {"means": [[c["v"] for c in r["cells"]] for r in means], "b_e": [WEIGHTS.b_e.tolist()], "b_d": [WEIGHTS.b_d.tolist()]}, path)
    found = sinks.load_weights(spark, path)
    return spark.createDataFrame([(name, i, j, round(x, 6)) for name, rows in found.items() for i, row in enumerate(rows) for j, x in enumerate(row)], "name string, row int, pos int, value double")


@query
def appended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the units appended by two runs, one of which is repeated, and read again."""
    path, rows = scratch_path(spark, "metrics"), binary_metrics(spark, sf_dir)
    for run in ("first", "second", "first"):
        sinks.append_metrics(rows, path, run)
    return read_runs(spark, rows.schema, path).drop("run")


@query
def feather_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as Feather by its tasks and read back by others."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(4, "o_orderkey")
    return sources.read_feather(spark, *sources.write_feather(rows, scratch_path(spark, "feather")))


@query
def feather_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a Feather table, the others unread; large orders by status."""
    paths = sources.write_feather(spark.read.parquet(f"{sf_dir}/orders.parquet"), scratch_path(spark, "feather"))
    rows = sources.read_feather(spark, *paths, columns=["o_orderstatus", "o_totalprice"])
    return rows.where("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _concept_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    coded = materialize(autoencoder.transform(_embeddings(spark, sf_dir), WEIGHTS), "coded")
    return coded, materialize(concepts.binarise(coded, concepts.thresholds(coded, 50, column="h"), column="h"), "marks")


@query
def concept_vector_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the slopes at the separators' solutions: nothing, as a solution is where they vanish."""
    coded, marks = _concept_inputs(spark, sf_dir)
    own = coded.select("row_id", F.col("x").alias("embedding"))
    return concepts.separator_slopes(own, marks, concepts.separators_of(own, marks)).select("idx", "pos", (F.abs("slope") < 1e-4).alias("vanishes"))


@query
def boosted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of the first boosted tree, with three leaves."""
    made = materialize(_selected_events(spark, sf_dir), "selected")
    values = [r["event"] for r in selection.most_frequent(made, CONFIG, CONFIG.candidates).collect()]
    found = boosting.boosted_splits(made, values, TERMINAL, BoostingConfig(rounds=1, leaves=3))
    return found.select("round", "place", "event", "limit", rounded("gain"), "n")


@query
def separator_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separators among the embeddings' first two dimensions; position 2 is the intercept."""
    coded, marks = _concept_inputs(spark, sf_dir)
    found = concepts.separators_of(coded.select("row_id", F.slice("x", 1, 2).alias("embedding")), marks)
    return found.select("idx", F.posexplode(F.concat("cav", F.array("intercept"))).alias("pos", "coefficient")).select("idx", "pos", rounded("coefficient"))


@query
def unit_tree_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test of each unit's tree of two levels, with the rows that reach it and its gain."""
    coded, marks = _concept_inputs(spark, sf_dir)
    config = TreeConfig(max_depths=(2,), balanced=(False,), impurities=("gini",), max_leaves=4)
    found = concepts.fit_trees(coded.select("row_id", F.col("x").alias("features")), marks, marks.select("idx").distinct(), config)
    return concepts.tree_splits(found).select("idx", "place", "feature", rounded("limit"), "n", "positive", rounded("gain"))


# Models: no SQL can say what they learn; tests hold them against properties and brute force.


@query
def gbt_gain_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = materialize(_selected_events(spark, sf_dir), "selected")
    values = [r["event"] for r in selection.most_frequent(made, CONFIG, CANDIDATES).collect()]
    return selection.gain_ranking(made, values, TERMINAL, BoostingConfig()).orderBy(F.desc("gain"), F.asc("event")).limit(CONFIG.top_k)


@query
def gain_matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default path: features ranked by gain among as many candidates as production runs have."""
    made = pipeline.prepare(sources.order_events(spark, sf_dir), replace(CONFIG, candidates=CANDIDATES))
    return _long(made.train_rows, selection.with_terminal(made.features, TERMINAL))


@query
def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier of the normalised training rows says of them."""
    train, _ = pipeline.model_inputs(pipeline.prepare(sources.order_events(spark, sf_dir), CONFIG, None), CONFIG)
    return concepts.LogisticClassifier().fit_predict(train, train)


@query
def folded_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each training row's embedding by the network of ten that hasn't seen it."""
    train, _ = pipeline.model_inputs(pipeline.prepare(sources.order_events(spark, sf_dir), CONFIG, None), CONFIG)
    return FoldedEmbedder().fit(train).embed_train(train)


@query
def explained_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: cohort, embeddings, sparse codes, trees, concept vectors, scores."""
    train, test = pipeline.model_inputs(pipeline.prepare(sources.order_events(spark, sf_dir), CONFIG, None), CONFIG)
    coded, coded_test, _, _ = pipeline.represent(train, test, FoldedEmbedder(EmbeddingConfig(width=48)), AutoencoderConfig(epochs=1000))
    coded, coded_test = materialize(coded, "coded"), materialize(coded_test, "coded")
    metrics, scores = pipeline.explain(coded, coded_test, (train, test), TreeConfig())
    return metrics.join(scores, "idx", "left")


@query
def sae_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, losses = autoencoder.train(_embeddings(spark, sf_dir), AutoencoderConfig())
    return spark.createDataFrame(list(enumerate(losses)), "epoch int, loss double")


@query
def unit_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, marks = _concept_inputs(spark, sf_dir)
    rows = coded.select("row_id", F.col("x").alias("features"))
    train, test = "row_id % 5 <> 0", "row_id % 5 = 0"  # an 80 to 20 split of rows
    return concepts.unit_trees(rows.where(train), marks.where(train), rows.where(test), marks.where(test), TreeConfig())[0]


@query
def concept_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, marks = _concept_inputs(spark, sf_dir)
    return concepts.concept_vectors(coded.select("row_id", F.col("x").alias("embedding")), marks)


@query
def surrogate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    return concepts.surrogate_gradient(rows.select("row_id", "embedding"), rows.select("row_id", (F.col("label") >= 5).cast("int").alias("y")))
