"""Deciding which rows belong to one participant, and hiding who that is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..schema import require_empty
from ..session import materialise
from .ordering import dense_position, dense_rank


def parse_names(files: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """``(parsed, rejected)`` from one parse of a name column."""
    flagged = N.decode_first(files, name)
    parsed = (
        flagged.where("matched").drop("matched")
        .withColumn("code_signature", N.code_signature(F.col("code")))
        .withColumn("session_date", N.session_date(F.col("session_stamp")))
        .withColumn("task", N.task_label(F.col("task_base")))
        .withColumn("recording_year", N.recording_year(F.col("session_date")))
    )
    return parsed, flagged.where("NOT matched").select(*files.columns)


def majority_vote(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest.

    Two counting steps, so no aggregator holds all values of a large key.
    """
    votes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def resolve_birth_year(parsed: DataFrame) -> DataFrame:
    """Add the year agreed on within a folder, the typo flag, the age and the keys."""
    keys = ["folder_path", "code_signature", "sex"]
    voted = majority_vote(parsed, keys, "birth_year_raw", "birth_year")
    sig, sex = F.col("code_signature"), F.col("sex")
    return parsed.join(voted, keys, "left").select(
        "*",
        (F.col("birth_year_raw") != F.col("birth_year")).alias("birth_year_typo"),
        N.age_from_birth_year(F.col("birth_year")).alias("age"),
        N.person_key(sig, F.col("birth_year_raw"), sex).alias("strict_key"),
        N.person_key(sig, F.col("birth_year"), sex).alias("subject_key"),
    )


def pseudonyms(df: DataFrame, group: str, key: str) -> DataFrame:
    """``group, key, subject_id``: keys numbered in the order of their hash.

    The hash is a uniform order, so its leading digits split even one huge group.
    """
    keys = df.select(group, key).distinct().withColumn("_sha", F.sha2(F.col(key), 256))
    # 32 leading bits, folded below the prime that position ranges assume
    keys = keys.withColumn("_u", F.conv(F.substring("_sha", 1, 7), 16, 10).cast("bigint") * 16)
    ranked = dense_position(keys, [group], ["_u", "_sha"], "_i", hashed=True)
    return ranked.select(group, key, F.format_string("%s%02d", F.col(group), F.col("_i")).alias("subject_id"))


def session_index(df: DataFrame, subject: str, session: str, chronological: bool = False) -> DataFrame:
    """Dense rank of the session date within a participant, joined back to the rows.

    The default orders the date text as it stands; ``chronological`` turns
    ``ddmmyy`` and ``ddmmyyyy`` into dates first. A row without a date keeps no index.
    """
    by = "_day" if chronological else session
    rows = df.withColumn("_day", N.session_day(F.col(session))) if chronological else df
    ranks = dense_rank(rows.where(F.col(by).isNotNull()), [subject], by, "session_index")
    ranks = ranks.select(F.col(subject).alias("_subject"), F.col(by).alias("_by"), "session_index")
    same = F.col(subject).eqNullSafe(F.col("_subject")) & (F.col(by) == F.col("_by"))
    return rows.join(ranks, same, "left").drop("_day", "_subject", "_by")


def build_metadata(files: DataFrame, root_depth: int, groups: dict[str, str], positive: str) -> DataFrame:
    """From ``path`` rows to the pseudonymised recording table.

    ``root_depth`` is the number of path parts before the group folder. Names that
    do not parse stop the build with a preview.
    """
    parts = F.split("path", "/")
    mapping = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    located = files.select(
        "path",
        F.element_at(parts, -1).alias("name"),
        F.element_at(parts, -2).alias("folder_name"),
        F.array_join(F.slice(parts, root_depth + 1, F.size(parts) - root_depth - 1), "/").alias("folder_path"),
        F.try_element_at(mapping, F.get(parts, F.lit(root_depth))).alias("group"),
    ).where(F.col("group").isNotNull())
    parsed, rejected = parse_names(located)
    require_empty(rejected.select("path"), "names that do not match the schema")
    # The keys are voted on, then numbered, then joined back: parsed and voted once.
    meta = materialise(resolve_birth_year(parsed).withColumn("label", (F.col("group") == positive).cast("int")))
    meta = meta.join(pseudonyms(meta, "group", "subject_key"), ["group", "subject_key"])
    return session_index(meta, "subject_id", "session_date")


# -- audits -----------------------------------------------------------------------


def rival_keys(df: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("recordings"), *[F.countDistinct(k).alias(f"by_{k}") for k in keys]
    )


def key_collisions(meta: DataFrame) -> DataFrame:
    """Long report of three kinds: split people, merged people, birth-year typos."""
    split = meta.groupBy(F.col("subject_key").alias("key")).agg(F.countDistinct("folder_path").alias("n"))
    merged = meta.groupBy(F.col("folder_name").alias("key")).agg(F.countDistinct("subject_key").alias("n"))
    typos = meta.where("birth_year_typo").select(
        F.concat_ws("|", "folder_name", F.col("recording_id").cast("string")).alias("key"),
        F.col("birth_year_raw").cast("bigint").alias("n"),
    )
    return (
        split.where("n > 1").withColumn("report", F.lit("one_person_many_folders"))
        .unionByName(merged.where("n > 1").withColumn("report", F.lit("one_folder_name_many_people")))
        .unionByName(typos.withColumn("report", F.lit("birth_year_typo")))
    )


def collapsed_keys(df: DataFrame, key: str, folder: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.countDistinct(folder).alias("folders"), F.count(F.lit(1)).alias("recordings")
    ).orderBy(F.desc("recordings"), key)


def in_several(df: DataFrame, subject: str, value: str) -> DataFrame:
    """Subjects that carry more than one value, by comparing the extremes."""
    return df.groupBy(subject).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo <> _hi").select(subject)


def anonymise(df: DataFrame, columns: Sequence[str] = ("folder_path", "folder_name")) -> DataFrame:
    return df.withColumns({c: N.directory_token(F.col(c)) for c in columns if c in df.columns})


def redact(df: DataFrame, columns: Sequence[str] = tuple(N.IDENTIFYING)) -> DataFrame:
    return df.drop(*columns)
