"""Filters, joins, aggregates, windows, top-k, sets and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.draws import draw_sql
from ...operators import cohort as C
from ...operators import identity as I
from ...operators import leaks
from ...operators import ordering as O
from ...operators import quality as Q
from ...operators import resample, signal, stats
from ...session import materialise
from ..registry import query
from ..views import FEATURES, FRAMES, FT, MATCHED_BATCH, REC, feature_table, frames, line_features, micros, r6, recordings, s6, table
from .sources_scalars import NAMES, NAMES2, PARSED, names2, parsed

TASKS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GROUPS = ["case", "control", "young"]
FULL = "\"group\" IN ('case','control')"

META = PARSED + """,
votes AS (SELECT folder_path, code_signature, sex, birth_year_raw, count(*) AS n FROM parsed2 GROUP BY ALL),
voted AS (SELECT folder_path, code_signature, sex, birth_year_raw AS birth_year FROM
  (SELECT *, row_number() OVER (PARTITION BY folder_path, code_signature, sex ORDER BY n DESC, birth_year_raw) AS rn FROM votes) WHERE rn = 1),
meta AS (SELECT p.*, birth_year, birth_year_raw <> birth_year AS birth_year_typo,
  p.code_signature || '|' || lpad(birth_year::VARCHAR, 2, '0') || '|' || p.sex AS subject_key
  FROM parsed2 p JOIN voted v ON p.folder_path = v.folder_path AND p.code_signature = v.code_signature AND p.sex = v.sex)"""


def meta(spark, sf):
    return I.resolve_birth_year(parsed(spark, sf))


def full(spark, sf):
    return recordings(spark, sf).where(F.col("group").isin("case", "control"))


# -- filters and cohorts ---------------------------------------------------------------


@query("f01_cohort_flags", f"""
WITH {REC} SELECT recording_id, {FULL} AS cohort_full, {FULL} AND batch = {MATCHED_BATCH} AS cohort_batch_matched FROM rec""")
def f01(spark, sf):
    rec = C.with_cohort_flags(recordings(spark, sf), ["case", "control"], MATCHED_BATCH)
    return rec.select("recording_id", "cohort_full", "cohort_batch_matched")


@query("f02_task_corpus_group", f"""
WITH {REC} SELECT recording_id, subject_id FROM rec WHERE task = '1-URGENT' AND corpus = 2 AND {FULL}""")
def f02(spark, sf):
    return full(spark, sf).where((F.col("task") == "1-URGENT") & (F.col("corpus") == 2)).select("recording_id", "subject_id")


@query("f03_prefix", f"""
WITH {REC} SELECT substr(folder_path, 1, 1) AS prefix, count(*) AS n FROM rec WHERE starts_with(folder_path, 'P/') GROUP BY 1""")
def f03(spark, sf):
    rec = recordings(spark, sf).where(F.col("folder_path").startswith("P/"))
    return rec.groupBy(F.substring("folder_path", 1, 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_one_batch_subjects", f"""
WITH {REC}, f AS (SELECT * FROM rec WHERE task = '2-HIGH')
SELECT recording_id, subject_id FROM f WHERE subject_id NOT IN
  (SELECT subject_id FROM f GROUP BY subject_id HAVING count(DISTINCT batch) > 1)""")
def f04(spark, sf):
    rows = recordings(spark, sf).where(F.col("task") == "2-HIGH")
    return C.exclude_in_several(rows, "subject_id", "batch").select("recording_id", "subject_id")


@query("f05_stratum", f"""
WITH {REC}, ids AS (SELECT subject_id FROM rec WHERE sex = 'F'
  UNION SELECT subject_id FROM rec GROUP BY subject_id HAVING avg(header) > 260000)
SELECT recording_id, subject_id FROM rec WHERE subject_id IN (SELECT subject_id FROM ids)""")
def f05(spark, sf):
    rec = recordings(spark, sf)
    return C.stratum(rec, "subject_id", F.col("sex") == "F", "header", 260000.0).select("recording_id", "subject_id")


@query("f06_minimum_evidence", """
WITH g AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, CASE WHEN n >= 3 AND q >= 60 THEN NULL ELSE 'too little evidence' END AS reason FROM g""")
def f06(spark, sf):
    rule = (F.count(F.lit(1)) >= 3) & (F.sum("l_quantity") >= 60)
    kept, rejected = C.minimum_evidence(table(spark, sf, "lineitem"), ["l_orderkey"], rule, "too little evidence")
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


# -- joins -----------------------------------------------------------------------------


@query("j01_resolved_value_back", f"WITH {META} SELECT recording_id, birth_year_raw, birth_year, birth_year_typo, subject_key FROM meta")
def j01(spark, sf):
    return meta(spark, sf).select("recording_id", "birth_year_raw", "birth_year", "birth_year_typo", "subject_key")


PERM_LABELS = f"""
subj AS (SELECT subject_id, max(label) AS label FROM rec GROUP BY subject_id),
ranked AS (SELECT subject_id, row_number() OVER (ORDER BY {draw_sql(11, 0, 'subject_id')}, subject_id) AS r FROM subj),
perm AS (SELECT subject_id, (r <= (SELECT sum(label) FROM subj))::INTEGER AS label_perm FROM ranked)"""


@query("j02_permuted_labels", f"""
WITH {REC}, {PERM_LABELS} SELECT recording_id, label, label_perm FROM rec JOIN perm USING (subject_id)""")
def j02(spark, sf):
    rec = recordings(spark, sf)
    subj = rec.groupBy("subject_id").agg(F.max("label").alias("label"))
    perm = resample.permuted_labels(subj, [], 1, seed=11).select("subject_id", "label_perm")
    return rec.join(perm, "subject_id", "left").select("recording_id", "label", "label_perm")


@query("j03_common_participants", f"""
WITH {REC}, a AS (SELECT task, subject_id, avg(header) AS s FROM rec WHERE batch <= 1997 GROUP BY ALL),
b AS (SELECT task, subject_id, avg(header) AS s FROM rec WHERE batch > 1997 GROUP BY ALL)
SELECT a.task, a.subject_id, {s6('a.s')} AS score_a, {s6('b.s')} AS score_b FROM a JOIN b ON a.task = b.task AND a.subject_id = b.subject_id""")
def j03(spark, sf):
    rec = recordings(spark, sf)
    side = lambda cond, n: rec.where(cond).groupBy("task", "subject_id").agg(r6(F.avg("header")).alias(n))
    return side(F.col("batch") <= 1997, "score_a").join(side(F.col("batch") > 1997, "score_b"), ["task", "subject_id"])


@query("j04_metadata_features", f"""
WITH {FT} SELECT recording_id, subject_id, label, f_lines, {s6('f_qty')} AS f_qty, {s6('f_price')} AS f_price FROM ft""")
def j04(spark, sf):
    return feature_table(spark, sf).select("recording_id", "subject_id", "label", "f_lines", r6("f_qty").alias("f_qty"), r6("f_price").alias("f_price"))


@query("j05_tier_combination", """
SELECT a.l_orderkey, a.a_lines, b.b_parts FROM
 (SELECT l_orderkey, count(*) AS a_lines FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a
 JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS b_parts FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) b USING (l_orderkey)""")
def j05(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("a_lines"))
    b = li.where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("b_parts"))
    return combine_tiers(a, b, "l_orderkey")


def combine_tiers(a, b, key):
    shared = set(a.columns) & set(b.columns) - {key}
    if shared:
        raise ValueError(f"tiers share columns {sorted(shared)}")
    return a.join(b, key)


@query("j06_semi_join", f"""
WITH {META} SELECT recording_id, subject_key FROM meta WHERE subject_key IN
  (SELECT subject_key FROM meta GROUP BY subject_key HAVING count(DISTINCT folder_path) > 1)""")
def j06(spark, sf):
    m = meta(spark, sf)
    split = m.groupBy("subject_key").agg(F.min("folder_path").alias("lo"), F.max("folder_path").alias("hi")).where("lo <> hi")
    return m.join(split, "subject_key", "left_semi").select("recording_id", "subject_key")


@query("j07_anti_join", f"""
WITH {REC} SELECT recording_id FROM rec WHERE recording_id NOT IN (SELECT l_orderkey FROM lineitem)""")
def j07(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recording_id"))
    return recordings(spark, sf).join(lines, "recording_id", "left_anti").select("recording_id")


@query("j08_token_map", """
WITH m AS (SELECT source, 'src' || lpad((row_number() OVER (ORDER BY sha256(source)))::VARCHAR, 2, '0') AS token FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, token FROM documents JOIN m USING (source)""")
def j08(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.lit("src").alias("g"))
    tokens = I.pseudonyms(docs, "g", "source").select("source", F.col("subject_id").alias("token"))
    return docs.join(tokens, "source").select("doc_id", "token")


# -- aggregates ------------------------------------------------------------------------


@query("a01_rival_key_census", f"""
WITH {META} SELECT "group", count(*) AS recordings, count(DISTINCT subject_key) AS by_subject_key,
  count(DISTINCT folder_path) AS by_folder_path, count(DISTINCT folder_name) AS by_folder_name FROM meta GROUP BY 1""")
def a01(spark, sf):
    return I.rival_keys(meta(spark, sf), ["group"], ["subject_key", "folder_path", "folder_name"])


@query("a02_majority_vote", """
WITH v AS (SELECT source, n_chars % 10 AS digit, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, digit, lang AS voted FROM (SELECT *, row_number() OVER (PARTITION BY source, digit ORDER BY n DESC, lang) AS rn FROM v) WHERE rn = 1""")
def a02(spark, sf):
    docs = table(spark, sf, "documents").select("source", (F.col("n_chars") % 10).alias("digit"), "lang")
    return I.majority_vote(docs, ["source", "digit"], "lang", "voted")


@query("a03_key_collisions", f"""
WITH {META}
SELECT 'one_person_many_folders' AS report, subject_key AS key, count(DISTINCT folder_path) AS n FROM meta GROUP BY 2 HAVING n > 1
UNION ALL SELECT 'one_folder_name_many_people', folder_name, count(DISTINCT subject_key) AS n FROM meta GROUP BY 2 HAVING n > 1
UNION ALL SELECT 'birth_year_typo', folder_name || '|' || recording_id::VARCHAR, birth_year_raw::BIGINT FROM meta WHERE birth_year_typo""")
def a03(spark, sf):
    return I.key_collisions(meta(spark, sf))


@query("a04_collapsed_keys", f"""
WITH {PARSED} SELECT code_signature, count(DISTINCT folder_name) AS folders, count(*) AS recordings FROM parsed2 WHERE "group" = 'young' GROUP BY 1""")
def a04(spark, sf):
    return I.collapsed_keys(parsed(spark, sf).where("group = 'young'"), "code_signature", "folder_name")


@query("a05_batch_confound", f"""
WITH {REC} SELECT batch, count(DISTINCT subject_id) FILTER ("group" = 'case') AS "case",
 count(DISTINCT subject_id) FILTER ("group" = 'control') AS control, count(DISTINCT subject_id) FILTER ("group" = 'young') AS young FROM rec GROUP BY batch""")
def a05(spark, sf):
    return C.pivot_distinct(recordings(spark, sf), ["batch"], "group", GROUPS, "subject_id")


@query("a06_format_counts", f"""WITH {REC} SELECT batch, task, sex, "group", count(*) AS n FROM rec GROUP BY ALL""")
def a06(spark, sf):
    return recordings(spark, sf).groupBy("batch", "task", "sex", "group").agg(F.count(F.lit(1)).alias("n"))


@query("a07_cohort_table", f"""
WITH {REC}, p AS (SELECT DISTINCT subject_id, "group", age, sex FROM rec),
a AS (SELECT "group", count(*) AS participants, {s6('avg(age)')} AS age_mean, {s6('stddev_samp(age)')} AS age_sd, min(age) AS age_min, max(age) AS age_max,
  count(*) FILTER (sex = 'M') AS male, {s6("100 * avg((sex = 'M')::INTEGER)")} AS pct_male FROM p GROUP BY 1),
b AS (SELECT "group", count(*) AS recordings, count(DISTINCT folder_path) AS directories FROM rec GROUP BY 1)
SELECT * FROM a JOIN b USING ("group")""")
def a07(spark, sf):
    t = C.cohort_table(recordings(spark, sf))
    return t.withColumns({c: r6(c) for c in ("age_mean", "age_sd", "pct_male")})


@query("a08_task_matrix", f"""
WITH {REC}, m AS (SELECT 'group' AS grain, "group" AS unit, task FROM rec UNION ALL SELECT 'subject', subject_id::VARCHAR, task FROM rec)
SELECT grain, unit, {', '.join(f"count(*) FILTER (task = '{t}') AS {chr(34)}{t}{chr(34)}" for t in TASKS)} FROM m GROUP BY grain, unit""")
def a08(spark, sf):
    rec = recordings(spark, sf)
    by_group = C.pivot_distinct(rec, ["group"], "task", TASKS).withColumnRenamed("group", "unit").withColumn("grain", F.lit("group"))
    by_subject = C.pivot_distinct(rec, ["subject_id"], "task", TASKS).withColumnRenamed("subject_id", "unit")
    by_subject = by_subject.withColumn("unit", F.col("unit").cast("string")).withColumn("grain", F.lit("subject"))
    return by_group.unionByName(by_subject)


@query("a09_completion_rate", f"""
WITH {REC} SELECT "group", {', '.join(s6(f"100.0 * count(DISTINCT subject_id) FILTER (task = '{t}') / count(DISTINCT subject_id)") + f' AS "{t}"' for t in TASKS)} FROM rec GROUP BY 1""")
def a09(spark, sf):
    out = C.completion_rate(recordings(spark, sf), TASKS)
    return out.select("group", *[r6(F.col(f"`{t}`")).alias(t) for t in TASKS])


@query("a10_repeats_histogram", f"""
WITH {REC}, p AS (SELECT "group", subject_id, count(*) AS readings, count(DISTINCT session_date) AS sessions FROM rec GROUP BY ALL)
SELECT "group", readings, sessions, count(*) AS participants FROM p GROUP BY ALL""")
def a10(spark, sf):
    return C.repeats_histogram(recordings(spark, sf))


@query("a11_repeat_agreement", f"""
WITH {REC}, r AS (SELECT "group", subject_id, header, row_number() OVER (PARTITION BY subject_id ORDER BY session_date, recording_id) AS rn FROM rec),
p AS (SELECT "group", subject_id, max(header) FILTER (rn = 1) AS a, max(header) FILTER (rn = 2) AS b FROM r WHERE rn <= 2 GROUP BY ALL)
SELECT "group", count(*) AS n, {s6('corr(a, b)')} AS r FROM p WHERE b IS NOT NULL GROUP BY 1""")
def a11(spark, sf):
    two = C.first_two(recordings(spark, sf), ["group", "subject_id"], ["session_date", "recording_id"], "header")
    return two.groupBy("group").agg(F.count(F.lit(1)).alias("n"), r6(stats.correlation(F.col("first"), F.col("second"))).alias("r"))


@query("a12_mean_sd", f"""WITH {REC} SELECT task, "group", {s6('avg(header)')} AS mean, {s6('stddev_samp(header)')} AS sd FROM rec GROUP BY ALL""")
def a12(spark, sf):
    return recordings(spark, sf).groupBy("task", "group").agg(r6(F.avg("header")).alias("mean"), r6(F.stddev_samp("header")).alias("sd"))


@query("a13_missingness", f"""
WITH {REC}, m AS (SELECT corpus, "group", subject_id, CASE WHEN subject_id % 10 <> 0 THEN age END AS age, CASE WHEN corpus <> 1 THEN sex END AS sex,
  CASE WHEN label = 1 THEN header END AS hy, f_qty AS updrs FROM rec LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS f_qty FROM lineitem GROUP BY 1) ON l_orderkey = recording_id)
SELECT corpus, "group", count(DISTINCT subject_id) AS participants, count(*) AS recordings, count(age) AS has_age, count(sex) AS has_sex, count(hy) AS has_hy, count(updrs) AS has_updrs FROM m GROUP BY ALL""")
def a13(spark, sf):
    rec = recordings(spark, sf).join(line_features(spark, sf).select("recording_id", F.col("f_qty").alias("updrs")), "recording_id", "left")
    rows = rec.select(
        "corpus", "group", "subject_id", "updrs", F.when(F.col("subject_id") % 10 != 0, F.col("age")).alias("age"),
        F.when(F.col("corpus") != 1, F.col("sex")).alias("sex"), F.when(F.col("label") == 1, F.col("header")).alias("hy"),
    )
    return C.missingness(rows, ["corpus", "group"], ["age", "sex", "hy", "updrs"])


# -- windows ---------------------------------------------------------------------------


@query("w01_session_index", f"""
WITH {REC} SELECT recording_id, dense_rank() OVER (PARTITION BY subject_id ORDER BY session_date) AS session_index FROM rec""")
def w01(spark, sf):
    return I.session_index(recordings(spark, sf), "subject_id", "session_date").select("recording_id", "session_index")


@query("w02_pseudonyms", f"""
WITH {META}, k AS (SELECT DISTINCT "group", subject_key FROM meta),
n AS (SELECT "group", subject_key, row_number() OVER (PARTITION BY "group" ORDER BY sha256(subject_key)) AS i FROM k)
SELECT recording_id, meta."group" || (CASE WHEN i < 10 THEN '0' || i::VARCHAR ELSE i::VARCHAR END) AS subject_id
FROM meta JOIN n ON meta."group" = n."group" AND meta.subject_key = n.subject_key""")
def w02(spark, sf):
    m = materialise(meta(spark, sf).select("recording_id", "group", "subject_key"))
    return m.join(I.pseudonyms(m, "group", "subject_key"), ["group", "subject_key"]).select("recording_id", "subject_id")


@query("w03_top_per_group", f"""
WITH {REC}, s AS (SELECT corpus, task, batch, avg(header) AS m FROM rec GROUP BY ALL)
SELECT corpus, task, batch, {s6('m')} AS m FROM (SELECT *, row_number() OVER (PARTITION BY corpus, task ORDER BY m DESC, batch) AS rn FROM s) WHERE rn = 1""")
def w03(spark, sf):
    s = recordings(spark, sf).groupBy("corpus", "task", "batch").agg(F.avg("header").alias("m"))
    return O.first_per_key(s, ["corpus", "task"], [-F.col("m"), F.col("batch")], ["batch", "m"]).withColumn("m", r6("m"))


@query("w04_first_row_per_key", f"""
WITH {REC} SELECT subject_id, batch, recording_id, header FROM
 (SELECT *, row_number() OVER (PARTITION BY subject_id, batch ORDER BY recording_id) AS rn FROM rec) WHERE rn = 1""")
def w04(spark, sf):
    return O.first_per_key(recordings(spark, sf), ["subject_id", "batch"], [F.col("recording_id")], ["recording_id", "header"])


@query("w05_average_rank", """
SELECT l_returnflag, l_quantity, count(*) AS n_ties, max(r) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank FROM
 (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1, 2""")
def w05(spark, sf):
    return O.average_rank(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")


@query("w06_running_class_counts", f"""
WITH {REC}, g AS (SELECT corpus, round(header / 1000) AS score, sum(label) AS p, count(*) - sum(label) AS q FROM rec GROUP BY ALL)
SELECT corpus, score, (sum(p) OVER w)::BIGINT AS cum_pos, (sum(q) OVER w)::BIGINT AS cum_neg FROM g WINDOW w AS (PARTITION BY corpus ORDER BY score DESC)""")
def w06(spark, sf):
    rows = recordings(spark, sf).select("corpus", F.round(F.col("header") / 1000).alias("score"), "label")
    cum = O.running_totals(rows, ["corpus"], "score", {"pos": F.sum("label"), "neg": F.sum(1 - F.col("label"))}, descending=True)
    return cum.select("corpus", "score", "cum_pos", "cum_neg")


@query("w07_cmvn", f"""
WITH {FRAMES} SELECT recording_id, coef, frame, {s6('(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8)')} AS z
FROM frames WINDOW w AS (PARTITION BY recording_id, coef)""")
def w07(spark, sf):
    out = signal.cmvn(frames(spark, sf), ["recording_id", "coef"], "value")
    return out.select("recording_id", "coef", "frame", r6("z").alias("z"))


def _tracks_sql(keys):
    """Every frame with both derivatives, from lists of whole tracks; short tracks as one row."""
    track = ", ".join(keys)

    def at_edges(order):
        weights, scale = signal.savgol(order)
        return s6("(" + " + ".join(f"({w}) * l[c + {o + 1}]" for o, w in weights.items() if w) + f") / {scale}")

    return f"""WITH t AS (SELECT user_id AS recording_id, event_type AS coef, value, ts, event_id FROM events),
l AS (SELECT {track}, list(value ORDER BY ts, event_id) AS l FROM t GROUP BY ALL),
f AS (SELECT *, unnest(range(len(l))) AS frame FROM l WHERE len(l) >= 9), e AS (SELECT *, least(greatest(frame, 4), len(l) - 5) AS c FROM f)
SELECT {track}, frame, {at_edges(1)} AS delta1, {at_edges(2)} AS delta2, NULL::BIGINT AS n_frames, NULL::VARCHAR AS error FROM e
UNION ALL SELECT {track}, NULL, NULL, NULL, len(l), 'track under nine frames' FROM l WHERE len(l) < 9"""


def _tracks(spark, sf, keys):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_type").alias("coef"), micros("ts").alias("t"), "event_id", F.col("value").alias("x")
    )
    pos = O.dense_position(ev, keys, ["t", "event_id"], "frame").withColumn("frame", F.col("frame") - 1)
    kept, short = signal.deltas(pos.select(*keys, "frame", "x"), keys, "frame", "x")
    rows = kept.select(*keys, "frame", r6("delta1").alias("delta1"), r6("delta2").alias("delta2"))
    return rows.unionByName(short, allowMissingColumns=True)


@query("w08_frame_deltas", _tracks_sql(["recording_id"]))
def w08(spark, sf):
    return _tracks(spark, sf, ["recording_id"])


@query("w08_short_tracks", _tracks_sql(["recording_id", "coef"]))
def w08_short(spark, sf):
    """Tracks of a few frames: one per participant and kind of event."""
    return _tracks(spark, sf, ["recording_id", "coef"])


# -- sorts and top-k ---------------------------------------------------------------------


@query("t01_canonical_sort", f"""WITH {REC} SELECT "group", subject_id, task, recording_id FROM rec ORDER BY ALL""")
def t01(spark, sf):
    cols = ["group", "subject_id", "task", "recording_id"]
    return recordings(spark, sf).select(*cols).orderBy(*cols)


@query("t02_best_row", f"""
WITH {REC} SELECT corpus, task, {s6('avg(header)')} AS m FROM rec GROUP BY 1, 2 ORDER BY avg(header) DESC, corpus, task LIMIT 1""")
def t02(spark, sf):
    s = recordings(spark, sf).groupBy("corpus", "task").agg(F.avg("header").alias("m"))
    return s.orderBy(F.desc("m"), "corpus", "task").limit(1).withColumn("m", r6("m"))


@query("t03_ranked_list", f"""
WITH {FT}, l AS (UNPIVOT (SELECT corpus, f_qty, f_discount, f_tax, f_lines, f_price FROM ft) ON f_qty, f_discount, f_tax, f_lines, f_price INTO NAME feature VALUE v)
SELECT corpus, feature, {s6('stddev_samp(v) / avg(v)')} AS spread FROM l GROUP BY 1, 2 ORDER BY spread DESC""")
def t03(spark, sf):
    long = feature_table(spark, sf).unpivot(["corpus"], FEATURES, "feature", "v")
    return long.groupBy("corpus", "feature").agg(r6(F.stddev_samp("v") / F.avg("v")).alias("spread")).orderBy(F.desc("spread"), "corpus", "feature")


@query("t04_reject_preview", f"""
WITH {NAMES} SELECT recording_id, name FROM names WHERE name LIKE 'not-a-corpus%' ORDER BY recording_id LIMIT 10""")
def t04(spark, sf):
    from .sources_scalars import names

    _, rejected = I.parse_names(names(spark, sf).drop("subject_id"))
    return rejected.select("recording_id", "name").orderBy("recording_id").limit(10)


# -- set operations ----------------------------------------------------------------------


@query("u01_corpus_union", f"""
WITH {NAMES}, {NAMES2} SELECT 'first' AS corpus, name FROM names UNION ALL SELECT 'second', name FROM names2""")
def u01(spark, sf):
    from .sources_scalars import names

    a = names(spark, sf).select(F.lit("first").alias("corpus"), "name")
    return a.unionByName(names2(spark, sf).select("name", F.lit("second").alias("corpus")))


@query("u02_prediction_union", f"""
WITH {FT} SELECT recording_id, 'qty' AS model, f_qty AS score FROM ft UNION ALL SELECT recording_id, 'lines', f_lines FROM ft""")
def u02(spark, sf):
    ft = feature_table(spark, sf)
    one = lambda m: ft.select("recording_id", F.lit(m).alias("model"), F.col(f"f_{m}").alias("score"))
    return one("qty").unionByName(one("lines"))


@query("u03_train_test_participants", f"""
WITH {REC} SELECT subject_id FROM rec WHERE batch <= 1998 INTERSECT SELECT subject_id FROM rec WHERE batch > 1998""")
def u03(spark, sf):
    rec = recordings(spark, sf)
    return rec.where("batch <= 1998").select("subject_id").intersect(rec.where("batch > 1998").select("subject_id"))


@query("u04_id_union", f"""
WITH {REC} SELECT subject_id FROM rec WHERE sex = 'F' UNION SELECT subject_id FROM rec WHERE header > 480000""")
def u04(spark, sf):
    rec = recordings(spark, sf)
    return rec.where("sex = 'F'").select("subject_id").union(rec.where("header > 480000").select("subject_id")).distinct()


@query("u05_value_set", f"""
WITH {REC}, have AS (SELECT DISTINCT task FROM rec), want AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','6-NEVER']) AS task)
SELECT task, 'unexpected' AS side FROM (FROM have EXCEPT FROM want) UNION ALL SELECT task, 'missing' FROM (FROM want EXCEPT FROM have)""")
def u05(spark, sf):
    return Q.value_set_difference(recordings(spark, sf), "task", ["1-URGENT", "2-HIGH", "3-MEDIUM", "6-NEVER"])


# -- quality gates -----------------------------------------------------------------------

#: Features of every recording; orders without lines leave NULLs to find.
HOLES = f"{REC}, holes AS (SELECT rec.*, q, d, CASE WHEN recording_id % 2 = 0 THEN 1.0::DOUBLE END AS flat FROM rec LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1) ON l_orderkey = recording_id)"


def holes(spark, sf):
    f = line_features(spark, sf).select("recording_id", F.col("f_qty").alias("q"), F.col("f_discount").alias("d"))
    return recordings(spark, sf).join(f, "recording_id", "left").withColumn("flat", F.when(F.col("recording_id") % 2 == 0, 1.0))


@query("q01_missing_values", f"""
WITH {HOLES} SELECT 'q' AS feature, count(*) - count(q) AS n_missing FROM holes UNION ALL SELECT 'd', count(*) - count(d) FROM holes UNION ALL SELECT 'flat', count(*) - count(flat) FROM holes""")
def q01(spark, sf):
    return Q.missing_counts(holes(spark, sf), ["q", "d", "flat"])


@query("q02_constant_columns", f"""
WITH {HOLES} SELECT 'q' AS feature, count(DISTINCT q) <= 1 AS is_constant FROM holes UNION ALL SELECT 'd', count(DISTINCT d) <= 1 FROM holes UNION ALL SELECT 'flat', count(DISTINCT flat) <= 1 FROM holes""")
def q02(spark, sf):
    return Q.constant_columns(holes(spark, sf), ["q", "d", "flat"])


@query("q03_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING n > 1")
def q03(spark, sf):
    return Q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q04_both_classes", f"""WITH {REC} SELECT corpus, task, count(DISTINCT label) AS classes, count(DISTINCT label) = 2 AS passed FROM rec GROUP BY 1, 2""")
def q04(spark, sf):
    return recordings(spark, sf).groupBy("corpus", "task").agg(F.countDistinct("label").alias("classes")).withColumn("passed", F.col("classes") == 2)


@query("q05_one_value_per_subject", f"""
WITH {REC} SELECT 'label' AS what, subject_id, min(label)::BIGINT AS lo, max(label)::BIGINT AS hi FROM rec GROUP BY subject_id HAVING lo <> hi
UNION ALL SELECT 'batch', subject_id, min(batch), max(batch) FROM rec GROUP BY subject_id HAVING min(batch) <> max(batch)""")
def q05(spark, sf):
    rec = recordings(spark, sf)
    one = lambda c: Q.conflicting(rec, "subject_id", c).select(
        F.lit(c).alias("what"), "subject_id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")
    )
    return one("label").unionByName(one("batch"))


@query("q06_drop_empty_columns", f"WITH {HOLES} SELECT recording_id, q, flat FROM holes")
def q06(spark, sf):
    rows = holes(spark, sf).withColumn("empty", F.lit(None).cast("double")).select("recording_id", "q", "flat", "empty")
    return Q.drop_empty_columns(rows, ["q", "flat", "empty"])


@query("q07_unscored_recordings", f"""
WITH {REC}, e AS (SELECT recording_id, unnest([0, 1]) AS repeat FROM rec)
SELECT recording_id, repeat FROM e WHERE NOT (repeat = 0 AND recording_id IN (SELECT l_orderkey FROM lineitem))
  AND NOT (repeat = 1 AND recording_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'))""")
def q07(spark, sf):
    expected = recordings(spark, sf).select("recording_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recording_id"), "l_returnflag", F.col("l_quantity").alias("score"))
    scored = li.select("recording_id", F.lit(0).alias("repeat"), "score").unionByName(
        li.where("l_returnflag = 'A'").select("recording_id", F.lit(1).alias("repeat"), "score")
    )
    return Q.unscored(expected, scored, ["recording_id", "repeat"])


@query("q08_identifier_leaks", "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def q08(spark, sf):
    return leaks.leaked_names(table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumnRenamed("text", "name"), "doc_id", "text", "item_id", "name")


@query("q08_many_identifiers", """WITH n AS (SELECT doc_id % 997 AS name_id, substr(text, 1 + (doc_id % 23)::BIGINT, 3 + (doc_id % 30)::BIGINT) AS name FROM documents)
SELECT DISTINCT d.doc_id, name_id FROM documents d JOIN n ON contains(d.text, name) WHERE length(name) > 0""")
def q08_many(spark, sf):
    """A piece of every document as a name, short and long ones."""
    docs = table(spark, sf, "documents")
    piece = F.substring(F.col("text"), (F.col("doc_id") % 23 + 1).cast("int"), (F.col("doc_id") % 30 + 3).cast("int"))
    names = docs.select((F.col("doc_id") % 997).alias("name_id"), piece.alias("name"))
    return leaks.leaked_names(docs, names, "doc_id", "text", "name_id", "name")


@query("q09_quality_report", f"""
WITH {HOLES}, r AS (
 SELECT 'missing_values' AS "check", (count(*) - count(q) + count(*) - count(d) + count(*) - count(flat))::BIGINT AS n_bad FROM holes
 UNION ALL SELECT 'constant_columns', ((count(DISTINCT q) <= 1)::INTEGER + (count(DISTINCT d) <= 1)::INTEGER + (count(DISTINCT flat) <= 1)::INTEGER)::BIGINT FROM holes
 UNION ALL SELECT 'single_class', CASE WHEN count(DISTINCT label) = 2 THEN 0 ELSE 1 END::BIGINT FROM holes
 UNION ALL SELECT 'duplicate_rows', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM holes GROUP BY subject_id, task, session_date)
 UNION ALL SELECT 'conflicting_labels', count(*) FROM (SELECT subject_id FROM holes GROUP BY 1 HAVING min(label) <> max(label)))
SELECT 'orders' AS "table", "check", n_bad, n_bad = 0 AS passed FROM r""")
def q09(spark, sf):
    return Q.quality_report(holes(spark, sf), "orders", ["q", "d", "flat"], ["subject_id", "task", "session_date"])
