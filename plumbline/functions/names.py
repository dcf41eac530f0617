"""Column expressions that decode schema-encoded names, keys, paths and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name patterns, task codes, constants and the columns to redact.
FIRST_PATTERN = r"(?i)^([A-Z]+)(\d+)([A-Za-z_ ]+?)(\d{2})([MF])(\d+)\.+wav$"
SECOND_PATTERN = r"(?i)^ID(\d+)_?(hc|pd)_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)\.wav$"
TASK_LABELS = {
    "B": "read_text",
    "D": "ddk",
    "VA": "vowel_a",
    "VE": "vowel_e",
    "VI": "vowel_i",
    "VO": "vowel_o",
    "VU": "vowel_u",
    "PR": "words",
    "FB": "phrases",
}
REFERENCE_YEAR = 2017
IDENTIFYING = [
    "subject_key", "strict_key", "code_signature", "folder_name", "folder_path", "path",
    "session_stamp", "session_date", "birth_year_raw", "birth_year",
]
IDENTIFYING_HARMONISED = ["path", "folder_path"]


def code_signature(code: Column) -> Column:
    """Lower-case letters of a scrambled code, sorted."""
    letters = F.regexp_replace(F.lower(code), "[^a-z]", "")
    return F.array_join(F.array_sort(F.split(letters, "")), "")


def person_key(signature: Column, year: Column, sex: Column) -> Column:
    return F.format_string("%s|%02d|%s", signature, year, sex)


def session_date(stamp: Column) -> Column:
    """The stamp without its trailing ``hhmm``."""
    n = F.length(stamp)
    return F.when(n > 4, F.left(stamp, n - 4)).otherwise(stamp)


def recording_year(date: Column) -> Column:
    long_form = F.substring(date, 5, 4).try_cast("int")
    short_form = F.substring(date, 5, 2).try_cast("int") + 2000
    return F.when(F.length(date) == 8, long_form).otherwise(short_form)


def session_day(date: Column) -> Column:
    """``ddmmyy`` or ``ddmmyyyy`` as a real date, NULL when it is neither."""
    year = recording_year(date)
    iso = F.format_string("%04d-%s-%s", year, F.substring(date, 3, 2), F.substring(date, 1, 2))
    return F.when(year.isNotNull(), iso.try_cast("date"))


def age_from_birth_year(two_digit_year: Column) -> Column:
    return F.lit(REFERENCE_YEAR) - (F.lit(1900) + two_digit_year)


def task_label(code: Column) -> Column:
    pairs = [F.lit(x) for kv in TASK_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(code)), F.lower(code))


def _match(df: DataFrame, name: str, pattern: str, groups: int) -> DataFrame:
    """Add ``matched`` and ``_parts``: one match that lists all groups."""
    listed = "\n".join(f"${i + 1}" for i in range(groups))
    col = F.col(name)
    ok = col.rlike(pattern)
    return df.withColumn("matched", ok).withColumn(
        "_parts", F.when(F.col("matched"), F.split(F.regexp_replace(col, pattern, listed), "\n"))
    )


def decode_first(df: DataFrame, name: str) -> DataFrame:
    """Fields of the six-part name; all NULL and ``matched`` false when it does not match."""
    part = F.col("_parts")
    return _match(df, name, FIRST_PATTERN, 6).select(
        *df.columns, "matched", F.upper(part[0]).alias("task_base"), part[1].try_cast("int").alias("task_rep"),
        part[2].alias("code"), part[3].try_cast("int").alias("birth_year_raw"), F.upper(part[4]).alias("sex"),
        part[5].alias("session_stamp"),
    )


def decode_second(df: DataFrame, name: str) -> DataFrame:
    part = F.col("_parts")
    group = F.upper(part[1])
    return _match(df, name, SECOND_PATTERN, 5).select(
        *df.columns, "matched",
        F.when(F.col("matched"), F.format_string("KCL_ID%02d", part[0].try_cast("bigint"))).alias("subject_id"),
        group.alias("group"), (group == "PD").cast("int").alias("label"),
        part[2].try_cast("double").alias("severity_hy"), part[3].try_cast("double").alias("severity_u2"),
        part[4].try_cast("double").alias("severity_u3"),
    )


def parent_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def severity_bin(folder: Column, prefix: str) -> Column:
    parts = F.split(folder, "/")
    return F.when((F.size(parts) > 2) & parts[0].startswith(prefix), parts[1])


def task_from_ancestors(path: Column, rules: dict[str, tuple[str, str]], default: str = "unknown") -> Column:
    """First rule whose directory is an ancestor: exact name, or lower-case name."""
    parents = parent_parts(path)
    lowered = F.transform(parents, F.lower)
    out = None
    for task, (exact, lower) in rules.items():
        hit = F.array_contains(parents, exact) | F.array_contains(lowered, lower)
        out = F.when(hit, task) if out is None else out.when(hit, task)
    return out.otherwise(default)


def directory_token(value: Column) -> Column:
    """Keep the enclosing directories, replace the leaf by a stable token."""
    token = F.concat(F.lit("dir-"), F.left(F.sha2(value, 256), F.lit(6)))
    return F.concat_ws("/", parent_parts(value), token)


def ci_text(point: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", point, lo, hi)


def rms_db(mean_square: Column) -> Column:
    return F.lit(20.0) * F.log10(F.sqrt(mean_square) + F.lit(1e-12))
