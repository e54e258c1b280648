"""The whole run: cohort and matrices, representation, explanation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AutoencoderConfig, BoostingConfig, CohortConfig, TreeConfig
from ..operators import autoencoder, cohort, concepts, matrix, preprocess, selection
from ..operators.embedding import FoldedEmbedder
from ..sources.scratch import materialize
from ..sources.sinks import read_or_compute


@dataclass(frozen=True)
class Prepared:
    """What :func:`prepare` returns; rows are wide: patient_id, year, a column of counts for each feature, the terminal."""

    train_rows: DataFrame
    test_rows: DataFrame
    features: list[str]
    train_years: list[int]
    test_years: list[int]
    selected: DataFrame

    def arrays(self, config: CohortConfig) -> tuple[DataFrame, DataFrame]:
        """Train and test rows as (row_id, patient_id, year, features, label)."""
        return tuple(matrix.feature_arrays(rows, self.features, config.row_terminal) for rows in (self.train_rows, self.test_rows))


#: Candidates are ranked by gain unless the caller says None.
GAIN = BoostingConfig()


def prepare(events: DataFrame, config: CohortConfig, boosting: BoostingConfig | None = GAIN) -> Prepared:
    """Train rows of a balanced, capped cohort up to the terminal event, and all test rows, from a canonical event log.

    Train is train entities in train periods, test is test entities in test periods. A terminal event in a test period
    leaves an entity negative. Features come from untrimmed rows of the selected entities; test rows are neither trimmed
    nor capped. The candidates are ranked by gain, with None by frequency.

    The log is written once to the shared folder, as is its split: all that follows reads these, whatever ``events`` are.
    """
    events = materialize(events, "log")
    train_years, test_years = cohort.train_test_periods(events, config.forced_periods)
    split = materialize(cohort.split_entities(events, config.seed, config.test_percent), "split")
    train_events = cohort.within(events, split.where(~F.col("is_test")), train_years)
    selected = cohort.select_balanced(cohort.availability(train_events, config.entity_terminal), config.cap_positive, config.cap_negative, config.seed)
    own = materialize(cohort.within(events, selected, train_years), "selected")
    features = selection.top_events(own, config, boosting)
    values = selection.with_terminal(features, config.row_terminal)
    present = (lambda e: e.select("patient_id", "year").distinct()) if config.keep_presence else (lambda e: None)
    test_events = cohort.within(events, split.where("is_test"), test_years)
    train_rows = matrix.trim_after_terminal(matrix.pivot_counts(own, values, present(own)), config.row_terminal)
    return Prepared(
        matrix.align(cohort.cap_rows(train_rows, config.max_rows, config.seed), values),
        matrix.align(matrix.pivot_counts(test_events, values, present(test_events)), values),
        features, train_years, test_years, selected,
    )


def model_inputs(made: Prepared, config: CohortConfig) -> tuple[DataFrame, DataFrame]:
    """Train and test arrays as models take them: imputed and standardised, each by its own rows, and written."""
    return tuple(materialize(preprocess.normalised(materialize(rows, "arrays")), "normalised") for rows in made.arrays(config))


def represent(train: DataFrame, test: DataFrame, embedder: autoencoder.Embedder | FoldedEmbedder, config: AutoencoderConfig, cache: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame, autoencoder.Weights, list[float]]:
    """Train and test as (row_id, x, h, xhat) by an autoencoder fitted to the train embeddings, its weights and losses.

    An embedder that is fitted to labels is fitted to ``train``, whose rows it then embeds fold by fold. With ``cache``
    (folder, fingerprint of model and inputs) embeddings are read from there if they are there.
    """

    def made(name: str, rows: DataFrame) -> DataFrame:
        if not isinstance(embedder, FoldedEmbedder):
            return embedder.embed(rows)
        if not embedder.networks:
            embedder.fit(train)
        return embedder.embed_train(rows) if name == "train" else embedder.embed(rows)

    def embedded(name: str, rows: DataFrame) -> DataFrame:
        return made(name, rows) if cache is None else read_or_compute(rows.sparkSession, cache[0], f"{name}_embeddings", cache[1], lambda: made(name, rows))

    own = embedded("train", train)
    weights, losses = autoencoder.train(own, config)
    return autoencoder.transform(own, weights), autoencoder.transform(embedded("test", test), weights), weights, losses


def explain(
    train: DataFrame, test: DataFrame, features: tuple[DataFrame, DataFrame], trees: TreeConfig, support: int = 50, classifier: concepts.Classifier | None = None, cache: tuple[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tree metrics and concept scores of the kept units, from (row_id, x, h, xhat) and (row_id, features, label).

    The concepts' scores are along the gradient of a linear stand-in for what ``classifier`` predicts on the training rows.
    With ``cache`` (folder, fingerprint of inputs) trees and predictions are read from there if they are there.
    """
    limits = concepts.thresholds(train, support, column="h")
    targets, test_targets = (materialize(concepts.binarise(rows, limits, column="h"), "targets") for rows in (train, test))
    metrics, _ = concepts.unit_trees(features[0], targets, features[1], test_targets, trees, f"{cache[0]}/trees/{cache[1]}" if cache else None)
    metrics = materialize(metrics, "metrics")
    kept = [r["idx"] for r in metrics.where("kept").orderBy("idx").collect()]
    embeddings = train.select("row_id", F.col("x").alias("embedding"))
    cavs = concepts.concept_vectors(embeddings, targets, kept)

    def guessed() -> DataFrame:
        return (classifier or concepts.LogisticClassifier()).fit_predict(features[0], features[0])

    found = guessed() if cache is None else read_or_compute(train.sparkSession, cache[0], "predictions", cache[1], guessed)
    predictions = found.select("row_id", F.col("prediction").alias("y"))
    if predictions.select("y").distinct().count() < 2:
        return metrics, cavs.select("idx", F.lit(0.0).alias("score"))
    return metrics, concepts.concept_scores(cavs, concepts.surrogate_gradient(embeddings, predictions))


def wide_table(table: DataFrame, outcome: str, drops: tuple[str, ...] = ()) -> DataFrame:
    """A wide table with its outcome last, medians for what is missing, all features standardised."""
    own = preprocess.with_outcome(table, outcome, drops)
    names = [c for c in own.columns if c != "outcome"]
    filled = preprocess.impute_median(own, names)
    names = [c for c in filled.columns if c != "outcome"]
    return preprocess.standardise(filled, names)
