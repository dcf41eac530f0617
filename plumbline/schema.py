"""Fixed schemas and the checks that make an operator fail loudly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


RECORDING = _struct(
    recording_id=T.LongType(), subject_id=T.LongType(), corpus=T.IntegerType(),
    group=T.StringType(), label=T.IntegerType(), task=T.StringType(),
    folder_path=T.StringType(), folder_name=T.StringType(), session_date=T.StringType(),
    batch=T.IntegerType(), sex=T.StringType(), age=T.DoubleType(), header=T.DoubleType(),
)

HARMONISED = _struct(
    corpus=T.StringType(), subject_id=T.StringType(), group=T.StringType(),
    label=T.IntegerType(), task=T.StringType(), task_rep=T.IntegerType(),
    language=T.StringType(), age=T.DoubleType(), sex=T.StringType(),
    severity_hy=T.DoubleType(), severity_u2=T.DoubleType(), severity_u3=T.DoubleType(),
    severity_bin=T.StringType(), folder_path=T.StringType(), path=T.StringType(),
)

FOLD_ASSIGNMENT = _struct(
    recording_id=T.LongType(), arm=T.StringType(), repeat=T.IntegerType(), fold=T.LongType(),
)

SCORE = _struct(
    recording_id=T.LongType(), subject_id=T.LongType(), label=T.IntegerType(),
    arm=T.StringType(), repeat=T.IntegerType(), score=T.DoubleType(),
)

METRIC = _struct(
    control=T.StringType(), auroc=T.DoubleType(), ci_lo=T.DoubleType(),
    ci_hi=T.DoubleType(), n=T.LongType(),
)


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return ``df`` cut to ``expected`` or raise on a missing or mistyped column."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: expected {f.dataType.simpleString()}, "
        f"found {have[f.name].simpleString() if f.name in have else 'nothing'}"
        for f in expected.fields
        if have.get(f.name) != f.dataType
    ]
    if problems:
        raise ValueError("schema mismatch: " + "; ".join(problems))
    return df.select(*expected.names)


def require_empty(df: DataFrame, what: str) -> None:
    """Raise with a short preview when ``df`` has rows."""
    preview = df.limit(10).collect()
    if preview:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in preview))
