"""Sources and sinks (s01-s08) and scalar expressions (p01-p14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import names as N
from ...operators import calibrate
from ...sources import files, tables
from ..registry import query
from ..views import FEATURES, FT, REC, feature_table, line_features, r6, recordings, s6, table

# -- derived names -------------------------------------------------------------

#: Six-part file names built from orders and customers; one in 13 is malformed.
NAMES = REC + """,
names AS (
  SELECT recording_id, subject_id, "group", folder_path, folder_name,
    CASE WHEN recording_id % 13 = 0 THEN 'not-a-corpus-file-' || recording_id::VARCHAR || '.wav'
    ELSE (CASE task WHEN '1-URGENT' THEN 'B' WHEN '2-HIGH' THEN 'VA' WHEN '3-MEDIUM' THEN 'PR'
                    WHEN '4-NOT SPECIFIED' THEN 'fb' ELSE 'ZQ' END)
      || (1 + recording_id % 12)::VARCHAR
      || (CASE WHEN recording_id % 3 = 0 THEN lower(c) ELSE c END)
      || lpad((CASE WHEN recording_id % 17 = 0 THEN (subject_id + 1) % 100 ELSE subject_id % 100 END)::VARCHAR, 2, '0')
      || sex || substr(session_date, 9, 2) || substr(session_date, 6, 2)
      || (CASE WHEN recording_id % 7 = 0 THEN substr(session_date, 3, 2) ELSE substr(session_date, 1, 4) END)
      || '1104' || (CASE WHEN recording_id % 11 = 0 THEN '..wav' ELSE '.WAV' END) END AS name
  FROM (SELECT *, CASE subject_id % 4 WHEN 0 THEN 'VLIAT OP' WHEN 1 THEN 'ubguot_t' WHEN 2 THEN 'APGANRET' ELSE 'TARGNAPE' END AS c FROM rec)
)"""


def names(spark, sf):
    rid, sid, date = F.col("recording_id"), F.col("subject_id"), F.col("session_date")
    code = (
        F.when(sid % 4 == 0, "VLIAT OP").when(sid % 4 == 1, "ubguot_t")
        .when(sid % 4 == 2, "APGANRET").otherwise("TARGNAPE")
    )
    letters = (
        F.when(F.col("task") == "1-URGENT", "B").when(F.col("task") == "2-HIGH", "VA")
        .when(F.col("task") == "3-MEDIUM", "PR").when(F.col("task") == "4-NOT SPECIFIED", "fb")
        .otherwise("ZQ")
    )
    year = F.when(rid % 17 == 0, (sid + 1) % 100).otherwise(sid % 100)
    name = F.concat(
        letters, (rid % 12 + 1).cast("string"),
        F.when(rid % 3 == 0, F.lower(code)).otherwise(code),
        F.format_string("%02d", year), F.col("sex"),
        F.substring(date, 9, 2), F.substring(date, 6, 2),
        F.when(rid % 7 == 0, F.substring(date, 3, 2)).otherwise(F.substring(date, 1, 4)),
        F.lit("1104"), F.when(rid % 11 == 0, "..wav").otherwise(".WAV"),
    )
    bad = F.concat(F.lit("not-a-corpus-file-"), rid.cast("string"), F.lit(".wav"))
    return recordings(spark, sf).select(
        "recording_id", "subject_id", "group", "folder_path", "folder_name",
        F.when(rid % 13 == 0, bad).otherwise(name).alias("name"),
    )


PARSED = NAMES + f""",
parsed AS (
  SELECT recording_id, subject_id, "group", folder_path, folder_name, name,
    upper(regexp_extract(name, '{N.FIRST_PATTERN}', 1)) AS task_base,
    regexp_extract(name, '{N.FIRST_PATTERN}', 2)::INTEGER AS task_rep,
    regexp_extract(name, '{N.FIRST_PATTERN}', 3) AS code,
    regexp_extract(name, '{N.FIRST_PATTERN}', 4)::INTEGER AS birth_year_raw,
    upper(regexp_extract(name, '{N.FIRST_PATTERN}', 5)) AS sex,
    regexp_extract(name, '{N.FIRST_PATTERN}', 6) AS session_stamp
  FROM names WHERE regexp_matches(name, '{N.FIRST_PATTERN}')
),
parsed2 AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(lower(code), ''), lambda x: regexp_matches(x, '^[a-z]$'))), '') AS code_signature,
    CASE WHEN length(session_stamp) > 4 THEN left(session_stamp, length(session_stamp) - 4) ELSE session_stamp END AS session_date
  FROM parsed
)"""


def parsed(spark, sf):
    return N.decode_first(names(spark, sf), "name").where("matched").drop("matched").withColumn("code_signature", N.code_signature(F.col("code"))).withColumn(
        "session_date", N.session_date(F.col("session_stamp"))
    )


NAMES2 = """
names2 AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 19 = 0 THEN 'invalid_' || c_custkey::VARCHAR || '.wav'
    ELSE 'ID' || c_custkey::VARCHAR || (CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '_' END)
      || (CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'pd' ELSE 'HC' END)
      || '_' || (c_custkey % 5)::VARCHAR || '_' || (c_custkey % 4)::VARCHAR || '.5_' || (c_custkey % 3)::VARCHAR || '.wav' END AS name
  FROM customer)"""


def names2(spark, sf):
    k = F.col("c_custkey")
    good = F.concat(
        F.lit("ID"), k.cast("string"), F.when(k % 5 == 0, "").otherwise("_"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "pd").otherwise("HC"),
        F.lit("_"), (k % 5).cast("string"), F.lit("_"), (k % 4).cast("string"), F.lit(".5_"),
        (k % 3).cast("string"), F.lit(".wav"),
    )
    bad = F.concat(F.lit("invalid_"), k.cast("string"), F.lit(".wav"))
    return table(spark, sf, "customer").select("c_custkey", F.when(k % 19 == 0, bad).otherwise(good).alias("name"))


# -- sources and sinks -----------------------------------------------------------


def wav_files(spark, sf):
    """Each embedding as a 16-bit WAV file below a folder per group, every thirteenth broken; the root."""

    def little_endian(value, width):
        digits = F.lpad(F.hex(value), width * 2, "0")
        pairs = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]
        return F.concat(*pairs)

    n_bytes = F.size("embedding").cast("bigint") * 2
    rate = F.when(F.col("vec_id") % 3 == 0, 44100).otherwise(16000).cast("bigint")
    text = lambda s: F.lit(s.encode().hex())
    data = F.array_join(
        F.transform("embedding", lambda x: little_endian(F.pmod(F.round(x * 20000).cast("bigint"), F.lit(65536)), 2)), ""
    )
    two = lambda n: little_endian(F.lit(n).cast("bigint"), 2)
    wav = F.concat(
        text("RIFF"), little_endian(n_bytes + 36, 4), text("WAVEfmt "), little_endian(F.lit(16).cast("bigint"), 4),
        two(1), two(1), little_endian(rate, 4), little_endian(rate * 2, 4), two(2), two(16),
        text("data"), little_endian(n_bytes, 4), data,
    )
    wav = F.when(F.col("vec_id") % 13 == 0, text("nonsense")).otherwise(wav)
    path = F.concat(F.when(F.col("label") < 5, "case").otherwise("control"), F.lit("/"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 2 == 0, ".wav").otherwise(".WAV"))
    root = tables.scratch_folder(spark, "audio")
    files.write_contents(table(spark, sf, "embeddings").select(path.alias("path"), F.unhex(wav).alias("content")), root)
    return root


LEAF = "(CASE WHEN label < 5 THEN 'case/' ELSE 'control/' END) || vec_id || (CASE WHEN vec_id % 2 = 0 THEN '.wav' ELSE '.WAV' END)"


def _below_root(path):
    return F.array_join(F.slice(F.split(path, "/"), -2, 2), "/")


@query("s01_file_listing", f"SELECT {LEAF} AS path, CASE WHEN vec_id % 13 = 0 THEN 8 ELSE 44 + 2 * len(embedding) END::BIGINT AS length FROM embeddings")
def s01(spark, sf):
    """The files written from a table, found again below the folders of both groups."""
    listing = files.list_files(spark, wav_files(spark, sf), ["case", "control"])
    return listing.select(_below_root("path").alias("path"), "length")


@query("s02_header_profile", f"""
SELECT vec_id, {LEAF} AS path, label, CASE WHEN vec_id % 13 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 44100 ELSE 16000 END::INTEGER AS samplerate,
  CASE WHEN vec_id % 13 <> 0 THEN 1 END::INTEGER AS channels, CASE WHEN vec_id % 13 <> 0 THEN 'PCM_16' END AS subtype, CASE WHEN vec_id % 13 <> 0 THEN len(embedding) END::BIGINT AS frames,
  CASE WHEN vec_id % 13 <> 0 THEN round(len(embedding) / (CASE WHEN vec_id % 3 = 0 THEN 44100.0::DOUBLE ELSE 16000.0::DOUBLE END), 9) END AS duration,
  CASE WHEN vec_id % 13 = 0 THEN 'not a RIFF/WAVE file' END AS error FROM embeddings""")
def s02(spark, sf):
    """Headers of the written files, joined back to the rows they were written from."""
    profile = files.header_profile(files.list_files(spark, wav_files(spark, sf)))
    rows = profile.withColumn("path", _below_root("path")).withColumn("duration", F.round("duration", 9))
    vec_id = F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint")
    source = table(spark, sf, "embeddings").select("vec_id", "label")
    return source.join(rows.withColumn("vec_id", vec_id), "vec_id").select(
        "vec_id", "path", "label", "samplerate", "channels", "subtype", "frames", "duration", "error"
    )


@query("s03_parquet_round_trip", f"""
WITH {REC} SELECT corpus, task, count(*) AS n, {s6('sum(header)')} AS total FROM rec GROUP BY corpus, task""")
def s03(spark, sf):
    path = tables.scratch_folder(spark, "recordings")
    back = tables.write_parquet(recordings(spark, sf).select("recording_id", "header", "corpus", "task"), path, ["corpus", "task"])
    return back.groupBy("corpus", "task").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("header")).alias("total"))


@query("s04_csv_rounded", f"""
WITH {REC} SELECT task, batch, round(avg(header), 4) AS mean_header, count(*) AS n FROM rec GROUP BY task, batch""")
def s04(spark, sf):
    path = tables.scratch_folder(spark, "csv")
    agg = recordings(spark, sf).groupBy("task", "batch").agg(
        F.avg("header").alias("mean_header"), F.count(F.lit(1)).alias("n")
    )
    tables.write_csv_rounded(agg, path, 4)
    return spark.read.option("header", True).schema(agg.schema).csv(path)


@query("s05_feature_cache", f"""
WITH {FT} SELECT task, count(*) AS recordings, count(DISTINCT subject_id) AS participants, 5::BIGINT AS features FROM ft GROUP BY task""")
def s05(spark, sf):
    """First fill two tasks, then ask for all: the first two are not recomputed."""
    path = tables.scratch_folder(spark, "features")
    rec = recordings(spark, sf)
    compute = lambda rows: rows.join(line_features(spark, sf), "recording_id").select(
        "recording_id", "subject_id", "label", *FEATURES, "task"
    )
    tables.read_or_compute(spark, path, rec.where(F.col("task").isin("1-URGENT", "5-LOW")), ["task"], compute)
    cached = tables.read_or_compute(spark, path, rec, ["task"], compute)
    return tables.manifest(cached, ["task"], FEATURES)


@query("s06_feature_manifest", f"""
WITH {FT}, long AS (
  SELECT task, 'lines' AS feature_set, subject_id, 5::BIGINT AS features FROM ft
  UNION ALL SELECT task, 'header', subject_id, 1::BIGINT FROM ft)
SELECT task, feature_set, count(*) AS recordings, count(DISTINCT subject_id) AS participants, max(features) AS features
FROM long GROUP BY task, feature_set""")
def s06(spark, sf):
    ft = feature_table(spark, sf).select("task", "subject_id")
    lines = tables.manifest(ft.withColumn("feature_set", F.lit("lines")), ["task", "feature_set"], FEATURES)
    header = tables.manifest(ft.withColumn("feature_set", F.lit("header")), ["task", "feature_set"], ["header"])
    return lines.unionByName(header)


@query("s07_checksum_manifest", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def s07(spark, sf):
    return files.checksums(table(spark, sf, "documents"), "doc_id", "text")


@query("s08_reject_channel", f"""
WITH {NAMES} SELECT recording_id, name, regexp_matches(name, '{N.FIRST_PATTERN}') AS parsed FROM names""")
def s08(spark, sf):
    flagged = N.decode_first(names(spark, sf), "name").withColumnRenamed("matched", "parsed")
    good, bad = flagged.where("parsed"), flagged.where("NOT parsed")
    return good.unionByName(bad).select("recording_id", "name", "parsed")


# -- scalar expressions ------------------------------------------------------------


@query("p01_name_parse", f"""
WITH {PARSED} SELECT recording_id, task_base, task_rep, code, birth_year_raw, sex, session_stamp FROM parsed""")
def p01(spark, sf):
    return parsed(spark, sf).select("recording_id", "task_base", "task_rep", "code", "birth_year_raw", "sex", "session_stamp")


@query("p02_second_name_parse", f"""
WITH {NAMES2}, p AS (SELECT name, regexp_extract(name, '{N.SECOND_PATTERN}', ['id','g','hy','u2','u3']) AS f
  FROM names2 WHERE regexp_matches(name, '{N.SECOND_PATTERN}'))
SELECT name, 'KCL_ID' || (CASE WHEN length(f.id) < 2 THEN '0' || f.id ELSE f.id END) AS subject_id, upper(f.g) AS "group",
  (upper(f.g) = 'PD')::INTEGER AS label, f.hy::DOUBLE AS severity_hy, f.u2::DOUBLE AS severity_u2, f.u3::DOUBLE AS severity_u3
FROM p""")
def p02(spark, sf):
    return N.decode_second(names2(spark, sf).select("name"), "name").where("matched").drop("matched")


@query("p03_code_signature", f"""
WITH {PARSED} SELECT recording_id, code, code_signature FROM parsed2""")
def p03(spark, sf):
    return parsed(spark, sf).select("recording_id", "code", "code_signature")


@query("p04_person_keys", f"""
WITH {PARSED} SELECT recording_id, code_signature || '|' || lpad(birth_year_raw::VARCHAR, 2, '0') || '|' || sex AS strict_key FROM parsed2""")
def p04(spark, sf):
    return parsed(spark, sf).select(
        "recording_id", N.person_key(F.col("code_signature"), F.col("birth_year_raw"), F.col("sex")).alias("strict_key")
    )


@query("p05_session_date", f"WITH {PARSED} SELECT recording_id, session_stamp, session_date FROM parsed2")
def p05(spark, sf):
    return parsed(spark, sf).select("recording_id", "session_stamp", "session_date")


@query("p06_year_and_age", f"""
WITH {PARSED} SELECT recording_id,
  CASE WHEN length(session_date) = 8 THEN substr(session_date, 5, 4)::INTEGER ELSE 2000 + substr(session_date, 5, 2)::INTEGER END AS recording_year,
  2017 - (1900 + birth_year_raw) AS age FROM parsed2""")
def p06(spark, sf):
    return parsed(spark, sf).select(
        "recording_id", N.recording_year(F.col("session_date")).alias("recording_year"),
        N.age_from_birth_year(F.col("birth_year_raw")).alias("age"),
    )


@query("p07_task_labels", f"""
WITH {PARSED} SELECT recording_id, task_base, CASE task_base WHEN 'B' THEN 'read_text' WHEN 'VA' THEN 'vowel_a'
  WHEN 'PR' THEN 'words' WHEN 'FB' THEN 'phrases' ELSE lower(task_base) END AS task FROM parsed""")
def p07(spark, sf):
    return parsed(spark, sf).select("recording_id", "task_base", N.task_label(F.col("task_base")).alias("task"))


@query("p08_path_parts", """
SELECT page_id, list_extract(p, -2) AS parent_name,
  array_to_string(p[4:len(p) - 1], '/') AS relative_parent,
  CASE WHEN len(p) > 4 AND starts_with(p[1], 'http') THEN p[4] END AS bin
FROM (SELECT page_id, string_split(url, '/') AS p FROM pages)""")
def p08(spark, sf):
    parts = F.split("url", "/")
    return table(spark, sf, "pages").select(
        "page_id", F.element_at(parts, -2).alias("parent_name"),
        F.array_join(F.slice(N.parent_parts(F.col("url")), F.lit(4), F.greatest(F.size(parts), F.lit(1))), "/").alias("relative_parent"),
        F.when((F.size(parts) > 4) & parts[0].startswith("http"), parts[3]).alias("bin"),
    )


@query("p09_task_from_ancestors", """
SELECT page_id, CASE WHEN list_contains(a, 'fr') OR list_contains(l, 'fr') THEN 'read_passage'
  WHEN list_contains(a, 'DE') OR list_contains(l, 'de') THEN 'spontaneous_dialogue' ELSE 'unknown' END AS task
FROM (SELECT page_id, p[1:len(p) - 1] AS a, list_transform(p[1:len(p) - 1], lambda x: lower(x)) AS l
      FROM (SELECT page_id, string_split(url, '/') AS p FROM pages))""")
def p09(spark, sf):
    rules = {"read_passage": ("fr", "fr"), "spontaneous_dialogue": ("DE", "de")}
    return table(spark, sf, "pages").select("page_id", N.task_from_ancestors(F.col("url"), rules).alias("task"))


@query("p10_directory_tokens", """
SELECT page_id, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], '/') || '/' ELSE '' END
  || 'dir-' || left(sha256(url), 6) AS token
FROM (SELECT page_id, url, string_split(url, '/') AS p FROM pages)""")
def p10(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.directory_token(F.col("url")).alias("token"))


@query("p11_redaction", f"""
WITH {REC} SELECT recording_id, subject_id, corpus, "group", label, task, batch, sex, age, header FROM rec""")
def p11(spark, sf):
    return recordings(spark, sf).drop(*N.IDENTIFYING)


@query("p12_label_encoding", f"""
WITH {REC} SELECT recording_id, CASE WHEN "group" = 'case' THEN 'PD' ELSE 'HC' END AS "group",
  ("group" = 'case')::INTEGER AS label, CASE WHEN task = '1-URGENT' THEN 'read_passage' ELSE task END AS task FROM rec""")
def p12(spark, sf):
    case = F.col("group") == "case"
    return recordings(spark, sf).select(
        "recording_id", F.when(case, "PD").otherwise("HC").alias("group"), case.cast("int").alias("label"),
        F.when(F.col("task") == "1-URGENT", "read_passage").otherwise(F.col("task")).alias("task"),
    )


@query("p13_ci_text", f"""
WITH {REC} SELECT corpus, printf('%.3f [%.3f, %.3f]', round(avg(header) / 1e5, 6), round(min(header) / 1e5, 6), round(max(header) / 1e5, 6)) AS text
FROM rec GROUP BY corpus""")
def p13(spark, sf):
    agg = recordings(spark, sf).groupBy("corpus").agg(
        *[F.round(f("header") / 1e5, 6).alias(n) for n, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]
    )
    return agg.select("corpus", N.ci_text(F.col("m"), F.col("lo"), F.col("hi")).alias("text"))


@query("p14_level_and_logit", f"""
SELECT user_id, {s6("20 * log10(sqrt(avg(value * value)) + 1e-12)")} AS db,
  {s6("ln(least(greatest(avg(value) / 500.0, 1e-12), 1 - 1e-12) / (1 - least(greatest(avg(value) / 500.0, 1e-12), 1 - 1e-12)))")} AS logit,
  {s6("1 / (1 + exp(-avg(value) / 500.0))")} AS sigmoid
FROM events GROUP BY user_id""")
def p14(spark, sf):
    agg = table(spark, sf, "events").groupBy("user_id").agg(
        F.avg(F.col("value") * F.col("value")).alias("ms"), (F.avg("value") / 500.0).alias("p")
    )
    return agg.select(
        "user_id", r6(N.rms_db(F.col("ms"))).alias("db"),
        r6(calibrate.logit(F.col("p"))).alias("logit"), r6(calibrate.sigmoid(F.col("p"))).alias("sigmoid"),
    )
