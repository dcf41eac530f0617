"""Two corpora under one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..schema import HARMONISED, validate_schema

SHARED_TASK = "read_passage"


def _conform(df: DataFrame) -> DataFrame:
    return validate_schema(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HARMONISED.fields]), HARMONISED)


def first_corpus(meta: DataFrame, corpus: str, language: str, positive: str, keep: list[str], severity_prefix: str) -> DataFrame:
    """Pseudonymised recordings with unpublished scores left NULL."""
    case = F.col("group") == positive
    null = F.lit(None)
    return _conform(meta.where(F.col("group").isin(*keep)).select(
        F.lit(corpus).alias("corpus"),
        F.concat(F.lit(corpus.upper() + "_"), F.col("subject_id").cast("string")).alias("subject_id"),
        F.when(case, "PD").otherwise("HC").alias("group"), case.cast("int").alias("label"),
        F.when(F.col("task") == "read_text", SHARED_TASK).otherwise(F.col("task")).alias("task"),
        "task_rep", F.lit(language).alias("language"), "age", "sex",
        null.alias("severity_hy"), null.alias("severity_u2"), null.alias("severity_u3"),
        N.severity_bin(F.col("folder_path"), severity_prefix).alias("severity_bin"), "folder_path", "path",
    ))


def second_corpus(files: DataFrame, corpus: str, language: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)`` from ``path`` rows; age and sex are unpublished and stay NULL."""
    flagged = N.decode_second(files.select("path", F.element_at(F.split("path", "/"), -1).alias("name")), "name")
    tasks = {SHARED_TASK: ("ReadText", "readtext"), "spontaneous_dialogue": ("SpontaneousDialogue", "spontaneous")}
    null = F.lit(None)
    rows = _conform(flagged.where("matched").select(
        F.lit(corpus).alias("corpus"), "subject_id", "group", "label",
        N.task_from_ancestors(F.col("path"), tasks).alias("task"), F.lit(1).alias("task_rep"), F.lit(language).alias("language"),
        null.alias("age"), null.alias("sex"), "severity_hy", "severity_u2", "severity_u3", null.alias("severity_bin"),
        F.array_join(N.parent_parts(F.col("path")), "/").alias("folder_path"), "path",
    ))
    return rows, flagged.where("NOT matched").select("path")


def harmonise(first: DataFrame, second: DataFrame, task: str = SHARED_TASK) -> DataFrame:
    """Both corpora, the shared task only."""
    return first.where(F.col("task") == task).unionByName(second.where(F.col("task") == task))
