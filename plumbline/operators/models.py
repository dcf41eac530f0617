"""The final model as an MLlib pipeline: fitted once on everything, saved, loaded, applied."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import prior_correction


def with_vector(df: DataFrame, source: str | Sequence[str], out: str = "raw") -> DataFrame:
    """Feature vector from one array column or from a named feature list."""
    if isinstance(source, str):
        return df.withColumn(out, array_to_vector(F.col(source).cast("array<double>")))
    return VectorAssembler(inputCols=list(source), outputCol=out, handleInvalid="error").transform(df)


def _scaled(classifier) -> Pipeline:
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scale, classifier])


def regularisation(c: float, n: int) -> float:
    """Penalty per row that equals an inverse strength ``c`` on a summed loss."""
    return 1.0 / (c * n)


def logistic(n: int, c: float = 1.0, l1_ratio: float = 0.0, max_iter: int = 200) -> Pipeline:
    """L2 logistic regression; ``l1_ratio`` above 0 makes it an elastic net."""
    return _scaled(LogisticRegression(
        regParam=regularisation(c, n), elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter
    ))


def probability(scored: DataFrame, out: str = "score") -> DataFrame:
    junk = {"features", "rawPrediction", "probability", "prediction"} | {c for c in scored.columns if c.startswith("_")}
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*junk)


def persist_if_passed(df: DataFrame, gates: DataFrame, factory: Callable[[int], Pipeline], features: Sequence[str], estimator: str, path: str, required: Sequence[str] = ("A", "B")) -> bool:
    """Fit on everything and save model and metadata when the required gates pass."""
    passed = {r["gate"]: r["passed"] for r in gates.select("gate", "passed").collect()}
    if not all(passed.get(g) for g in required):
        return False
    n = df.count()
    model = factory(n).fit(with_vector(df, features))
    model.write().save(f"{path}/model")
    prevalence = df.agg(F.avg("label")).first()[0]
    meta = df.sparkSession.createDataFrame(
        [(estimator, list(features), n, float(prevalence))], "estimator string, features array<string>, n_rows bigint, pi_train double"
    )
    meta.write.parquet(f"{path}/metadata")
    return True


def batch_score(df: DataFrame, path: str, pi_real: float = 0.015) -> DataFrame:
    """Saved model on new rows: feature list checked, prior moved to ``pi_real``."""
    meta = df.sparkSession.read.parquet(f"{path}/metadata").first()
    absent = [f for f in meta["features"] if f not in df.columns]
    if absent:
        raise ValueError(f"rows lack model features {absent}")
    model = PipelineModel.load(f"{path}/model")
    scored = probability(model.transform(with_vector(df, meta["features"])).drop("raw"))
    return scored.withColumn("corrected", prior_correction(F.col("score"), meta["pi_train"], pi_real))
