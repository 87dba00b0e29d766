"""Pooled training of the direction model with Spark ML, scoring, and the saved model with its metadata."""

import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microbook.functions.scalars import probs_to_score
from microbook.operators import metrics as Q
from microbook.operators.sampling import balanced_undersample, best_horizon, time_split
from microbook.plans.matrix import assemble_dataset
from microbook.schema import CLASSES, FEATURE_NAMES, HORIZONS, KEYS, SCHEMA_VERSION, SEQ
from microbook.session import materialise
from microbook.sources.tables import run_metadata, write_metrics

PROBS = ("p_down", "p_stable", "p_up")
# Counterparts of the published settings: 63 leaves -> depth 6, 0.85 row sample, 500 rows per leaf, 0.05 step, up to 300 rounds
# with early stopping. The forest is the quick default and has its own leaf size.
FOREST = {"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 20, "subsamplingRate": 0.85}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "minInstancesPerNode": 500, "stepSize": 0.05, "subsamplingRate": 0.85}
_LOADERS = {"forest": RandomForestClassificationModel, "logistic": LogisticRegressionModel, "boosted": GBTClassificationModel}


@dataclass
class DirectionModel:
    """Fitted classifier(s) that add p_down, p_stable and p_up to a feature matrix.

    `boosted` holds one binary model per class, because gradient-boosted trees in Spark ML are binary; their
    probabilities are normalised to sum to 1.
    """

    algorithm: str
    parts: list = field(default_factory=list)
    k: int = 0

    def transform(self, matrix: DataFrame) -> DataFrame:
        assembled = _assembler().transform(matrix)
        if self.algorithm != "boosted":
            scored = self.parts[0].transform(assembled).withColumn("_p", vector_to_array("probability"))
            cells = {name: F.col("_p")[c] for c, name in enumerate(PROBS)}
            return scored.withColumns(cells).drop("_p", "features", "probability", "rawPrediction", "prediction")
        for c, part in enumerate(self.parts):
            hit = part.transform(assembled).withColumn(f"_p{c}", vector_to_array("probability")[1])
            assembled = hit.drop("probability", "rawPrediction", "prediction")
        total = F.col("_p0") + F.col("_p1") + F.col("_p2")
        return assembled.withColumns({name: F.col(f"_p{c}") / total for c, name in enumerate(PROBS)}).drop("_p0", "_p1", "_p2", "features")

    def score(self, matrix: DataFrame) -> DataFrame:
        """P(up) - P(down) per row."""
        return self.transform(matrix).withColumn("score", probs_to_score())

    def importances(self, spark: SparkSession) -> DataFrame:
        """Impurity importance of each feature (mean over parts); absolute coefficients for the logistic model."""
        if self.algorithm == "logistic":
            values = abs(self.parts[0].coefficientMatrix.toArray()).mean(axis=0)
        else:
            values = sum(part.featureImportances.toArray() for part in self.parts) / len(self.parts)
        return spark.createDataFrame([(n, float(v)) for n, v in zip(FEATURE_NAMES, values)], "feature string, importance double")


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features")


def fit_model(train: DataFrame, algorithm: str = "forest", *, seed: int = 42, k: int = 0, validation: str | None = None, **params) -> DirectionModel:
    """Fit on rows with the feature columns and `label`. `validation` names a boolean column for early stopping (boosted)."""
    rows = _assembler().transform(train).withColumn("label", F.col("label").cast("double"))
    common = {"featuresCol": "features", "labelCol": "label"}
    if algorithm == "forest":
        parts = [RandomForestClassifier(seed=seed, **common, **{**FOREST, **params}).fit(rows)]
    elif algorithm == "logistic":
        parts = [LogisticRegression(family="multinomial", **common, **{"regParam": 0.01, **params}).fit(rows)]
    elif algorithm == "boosted":
        options = {**BOOSTED, **params, **({"validationIndicatorCol": validation} if validation else {})}
        parts = [
            GBTClassifier(seed=seed, **common, **options).fit(rows.withColumn("label", (F.col("label") == c).cast("double")))
            for c in CLASSES
        ]
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return DirectionModel(algorithm, parts, k)


def split_dataset(matrix: DataFrame, k: int, frac: float = 0.7) -> DataFrame:
    """Labelled rows for horizon `k` with `is_train`; the last rows of each symbol and day validate."""
    return time_split(assemble_dataset(matrix, k), frac)


@dataclass
class TrainingRun:
    model: DirectionModel
    scored: DataFrame
    metrics: DataFrame
    train_shares: dict[int, float]


def train(
    matrix: DataFrame,
    k: int,
    *,
    algorithm: str = "forest",
    samples_per_class: int = 5_000,
    seed: int = 42,
    **params,
) -> TrainingRun:
    """Fit on a balanced sample of the pooled training rows, validate on all later rows.

    `matrix` comes from `build_feature_matrix(..., horizons=(k, ...))`. The sample has up to `samples_per_class` rows of each
    class, so the fit does not grow with the data; scoring and metrics run over everything. Boosting stops early on a sample of the
    same size of the later rows.
    """
    rows = split_dataset(matrix, k)
    chosen = [*KEYS, SEQ, *FEATURE_NAMES, "label"]
    sample = materialise(balanced_undersample(rows.where("is_train"), samples_per_class, seed).select(*chosen), f"sample{k}")
    fitted, stop = sample, {}
    if algorithm == "boosted":
        later = balanced_undersample(rows.where("NOT is_train"), samples_per_class, seed).select(*chosen)
        fitted = sample.withColumn("is_later", F.lit(False)).unionByName(later.withColumn("is_later", F.lit(True)))
        fitted, stop = materialise(fitted, f"stopping{k}"), {"validation": "is_later"}
    model = fit_model(fitted, algorithm, seed=seed, k=k, **stop, **params)
    held_out = model.transform(rows.where("NOT is_train"))
    scored = materialise(held_out.select(*KEYS, SEQ, "label", *PROBS), f"scored{k}")
    quality = Q.log_loss(scored).join(Q.auc_up_vs_down(scored), "symbol", "left").withColumn("k", F.lit(k))
    shares = {r["label"]: r["share"] for r in Q.class_share(sample).where(F.col("symbol") == Q.POOLED).collect()}
    return TrainingRun(model, scored, quality, shares)


def train_grid(matrix: DataFrame, horizons: Sequence[int] = HORIZONS, **options) -> tuple[dict[int, TrainingRun], int]:
    """One run per horizon and the horizon with the smallest pooled log loss. Pass a stored matrix: each run reads it."""
    runs = {k: train(matrix, k, **options) for k in horizons}
    losses = None
    for run in runs.values():
        pooled = run.metrics.where(F.col("symbol") == Q.POOLED).select("k", "logloss")
        losses = pooled if losses is None else losses.unionByName(pooled)
    return runs, best_horizon(losses).first()["k"]


def evaluate(scored: DataFrame) -> dict[str, DataFrame]:
    """Calibration tables of a scored set, per symbol and pooled."""
    return {
        "brier": Q.brier(scored),
        "brier_per_class": Q.brier_per_class(scored),
        "reliability": Q.reliability_bins(scored),
        "confusion": Q.confusion_matrix(scored),
    }


def evaluation_report(scored: DataFrame) -> DataFrame:
    """All tables of `evaluate` as one: report, symbol, class, bin, measure, value (class and bin are NULL where a table has none)."""
    measures = {
        "brier": ["brier"], "brier_per_class": ["brier"], "reliability": ["n", "mean_pred", "frac_pos"], "confusion": [f"pred_{c}" for c in CLASSES],
    }
    parts = []
    for name, table in evaluate(scored).items():
        group = F.col("label") if name == "confusion" else F.col("class") if "class" in table.columns else F.lit(None)
        place = F.col("bin") if "bin" in table.columns else F.lit(None)
        cells = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures[name]]
        parts.append(table.select(
            F.lit(name).alias("report"), "symbol", group.cast("int").alias("class"), place.cast("bigint").alias("bin"), F.inline(F.array(*cells))
        ))
    return reduce(DataFrame.unionByName, parts)


# --- persistence --------------------------------------------------------------------------------------------------


def save_model(run: TrainingRun, path: str, spark: SparkSession, params: dict | None = None) -> None:
    for number, part in enumerate(run.model.parts):
        part.write().overwrite().save(os.path.join(path, f"part{number}"))
    described = run_metadata(spark, k=run.model.k, params={"algorithm": run.model.algorithm, **(params or {})}, shares=run.train_shares)
    write_metrics(described, os.path.join(path, "metadata"))


def load_model(path: str, spark: SparkSession) -> DirectionModel:
    """Load a saved model; fails when the metadata or a part is missing or the feature contract differs."""
    schema = "schema_version int, features array<string>, k int, params map<string,string>"
    meta = spark.read.schema(schema).json(os.path.join(path, "metadata")).first()
    if meta is None or meta["schema_version"] != SCHEMA_VERSION or tuple(meta["features"]) != FEATURE_NAMES:
        raise ValueError("model was saved for another feature contract")
    algorithm = meta["params"]["algorithm"]
    count = len(CLASSES) if algorithm == "boosted" else 1
    parts = [_LOADERS[algorithm].load(os.path.join(path, f"part{n}")) for n in range(count)]
    return DirectionModel(algorithm, parts, meta["k"])


def score_with_onnx(matrix: DataFrame, model_bytes: bytes) -> DataFrame:
    """Class probabilities from an ONNX classifier file: one session per Python worker, Arrow batches in and out."""
    import numpy as np
    import pandas as pd

    shared = matrix.sparkSession.sparkContext.broadcast(model_bytes)
    output = matrix.select(*KEYS, SEQ).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        session = onnxruntime.InferenceSession(shared.value, options, providers=["CPUExecutionProvider"])
        source = session.get_inputs()[0].name
        for batch in batches:
            probabilities = session.run(None, {source: batch[list(FEATURE_NAMES)].to_numpy(dtype=np.float32)})[-1]
            values = np.asarray(probabilities, dtype=float).reshape(len(batch), len(CLASSES))
            yield pd.concat([batch[[*KEYS, SEQ]].reset_index(drop=True), pd.DataFrame(values, columns=list(PROBS))], axis=1)

    columns = output + "".join(f", {p} double" for p in PROBS)
    return matrix.select(*KEYS, SEQ, *FEATURE_NAMES).mapInPandas(run, columns)
