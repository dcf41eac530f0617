"""Signal and feature operators (g01-g14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.draws import normal_sql, uniform_sql
from ...operators import quality as Q
from ...operators import signal as S
from ..registry import query
from ..views import FRAMES, SIG, frames, r6, s6, signals, table

FRAME = 8
RATE = 100.0
TOP_DB = 6.0
TARGET_DB = -18.0
SEED = 42

LEVELS = SIG + f""",
fr AS (SELECT recording_id, pos // {FRAME} AS frame, count(*) AS n, sum(x * x) AS sq, sum(x) AS s, max(abs(x)) AS peak, count(*) FILTER (abs(x) > 0.99) AS clipped FROM sig GROUP BY ALL),
lv AS (SELECT *, (sq / n > max(sq / n) OVER (PARTITION BY recording_id) * {10.0 ** (-TOP_DB / 10.0)!r}::DOUBLE)::INTEGER AS speech FROM fr)"""
ISLANDS = LEVELS + f""",
b AS (SELECT *, (speech = 1 AND coalesce(lag(speech) OVER (PARTITION BY recording_id ORDER BY frame), 0) = 0)::INTEGER AS st FROM lv),
isl AS (SELECT *, sum(st) OVER (PARTITION BY recording_id ORDER BY frame) AS k FROM b),
iv AS (SELECT recording_id, k AS interval, min(frame) * {FRAME} AS start, max(frame * {FRAME} + n) AS "end" FROM isl WHERE speech = 1 GROUP BY ALL)"""


def levels(spark, sf):
    return S.frame_levels(signals(spark, sf), FRAME, TOP_DB)


def six(df, *skip):
    floating = [c for c, t in df.dtypes if t == "double" and c not in skip]
    return df.withColumns({c: r6(c) for c in floating})


@query("g01_peak_normalise", f"""WITH {SIG} SELECT recording_id, pos, {s6('x / max(abs(x)) OVER (PARTITION BY recording_id)')} AS x FROM sig""")
def g01(spark, sf):
    return S.peak_normalise(signals(spark, sf)).select("recording_id", "pos", r6("x").alias("x"))


@query("g02_speech_intervals", f"""WITH {ISLANDS} SELECT recording_id, interval::BIGINT AS interval, start, "end" FROM iv""")
def g02(spark, sf):
    return S.speech_intervals(levels(spark, sf), FRAME).select("recording_id", F.col("interval").cast("bigint"), "start", "end")


@query("g03_pause_rhythm", f"""WITH {ISLANDS}, d AS (SELECT recording_id, sum(n) / {RATE}::DOUBLE AS duration FROM lv GROUP BY 1),
sp AS (SELECT recording_id, sum("end" - start) / {RATE}::DOUBLE AS sd, count(*) AS k FROM iv GROUP BY 1),
j AS (SELECT recording_id, duration, coalesce(sd, 0) AS sd, greatest(0, duration - coalesce(sd, 0)) AS pause, greatest(0, coalesce(k, 0) - 1)::DOUBLE AS c FROM d LEFT JOIN sp USING (recording_id))
SELECT recording_id, {s6('duration')} AS duration, {s6('sd')} AS speech_duration, {s6('pause')} AS pause_duration, c AS pause_count, {s6('coalesce(pause / nullif(c, 0), 0)')} AS mean_pause_dur, {s6('pause / (duration + 1e-12)')} AS pause_ratio FROM j""")
def g03(spark, sf):
    lv = levels(spark, sf)
    return six(S.pause_rhythm(lv, S.speech_intervals(lv, FRAME), RATE))


@query("g04_channel_statistics", f"""WITH {LEVELS}, a AS (SELECT recording_id, max(peak) AS pk, sum(n) AS n, sum(s) AS s, sum(clipped) AS c,
 coalesce(sum(n) FILTER (speech = 0), 0) AS nq, sum(sq) FILTER (speech = 0) AS q, coalesce(sum(n) FILTER (speech = 1), 0) AS ns, sum(sq) FILTER (speech = 1) AS p FROM lv GROUP BY 1),
d AS (SELECT *, nq >= 8 AND ns > 0 AS ok, 20 * log10(sqrt(q / nullif(nq, 0)) + 1e-12) AS qd, 20 * log10(sqrt(p / nullif(ns, 0)) + 1e-12) AS pd FROM a)
SELECT recording_id, CASE WHEN ok THEN {s6('pk')} END AS ch_peak, CASE WHEN ok THEN {s6('qd')} END AS ch_silence_db, CASE WHEN ok THEN {s6('pd')} END AS ch_speech_db, CASE WHEN ok THEN {s6('pd - qd')} END AS ch_snr_db,
 CASE WHEN ok THEN {s6('s / n')} END AS ch_dc_offset, CASE WHEN ok THEN {s6('c / n')} END AS ch_clipped_fraction, CASE WHEN NOT ok THEN 'too little silence' END AS error FROM d""")
def g04(spark, sf):
    kept, rejected = S.channel_statistics(levels(spark, sf), 8)
    return six(kept.unionByName(rejected, allowMissingColumns=True))


def arrays(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("recording_id"), F.col("embedding").alias("samples"))


def samples(spark, sf):
    """The arrays as a sample table."""
    return arrays(spark, sf).select("recording_id", F.posexplode("samples").alias("pos", "x"))


#: 64 samples sit in the middle of one centred 512-point frame; a plain DFT says the same.
DFT = """x AS (SELECT vec_id, i - 1 + 256 AS n, embedding[i]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * (i - 1 + 256) / 512)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
bins AS (SELECT vec_id, b, sqrt(pow(sum(v * cos(2 * pi() * b * n / 512)), 2) + pow(sum(v * sin(2 * pi() * b * n / 512)), 2)) AS mag FROM x, (SELECT unnest(range(257)) AS b) GROUP BY ALL)"""


@query("g05_spectral_shares", f"""WITH {DFT} SELECT vec_id AS recording_id, {s6('sum(mag) FILTER (b < 20) / sum(mag)')} AS ch_lf_ratio, {s6('sum(mag) FILTER (b >= 200) / sum(mag)')} AS ch_hf_ratio FROM bins GROUP BY vec_id""")
def g05(spark, sf):
    return six(S.chunked_spectrum(samples(spark, sf)))


#: The cepstra of 64 samples in the middle of one centred frame of 2048 points, term by term.
CEPSTRA = """WITH x AS (SELECT vec_id, i - 1 + 1024 AS n, embedding[i]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * (i - 1 + 1024) / 2048)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
p AS (SELECT vec_id, b, pow(sum(v * cos(2 * pi() * b * n / 2048)), 2) + pow(sum(v * sin(2 * pi() * b * n / 2048)), 2) AS p FROM x, (SELECT unnest(range(1025)) AS b) GROUP BY ALL),
k AS (SELECT j, j * (15 + ln(8.0::DOUBLE) / (ln(6.4::DOUBLE) / 27)) / 129 AS mel FROM (SELECT unnest(range(130)) AS j)),
hz AS (SELECT j, CASE WHEN mel < 15 THEN mel * 200 / 3.0::DOUBLE ELSE 1000 * exp(ln(6.4::DOUBLE) / 27 * (mel - 15)) END AS f FROM k),
tri AS (SELECT lo.j AS m, b, greatest(0, least((b * 7.8125::DOUBLE - lo.f) / (mid.f - lo.f), (hi.f - b * 7.8125::DOUBLE) / (hi.f - mid.f))) * 2 / (hi.f - lo.f) AS w
  FROM hz lo JOIN hz mid ON mid.j = lo.j + 1 JOIN hz hi ON hi.j = lo.j + 2, (SELECT unnest(range(1025)) AS b)),
e AS (SELECT vec_id, m, 10 * log10(greatest(sum(p * w), 1e-10)) AS db FROM p JOIN tri USING (b) WHERE w > 0 OR b = 0 GROUP BY ALL),
m AS (SELECT vec_id, m, db FROM e UNION ALL SELECT v.vec_id, t.m, -100 FROM (SELECT DISTINCT vec_id FROM x) v, (SELECT m FROM tri GROUP BY m HAVING max(w) = 0) t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.vec_id = v.vec_id AND e.m = t.m)),
c AS (SELECT vec_id, m, greatest(db, max(db) OVER (PARTITION BY vec_id) - 80) AS db FROM m)"""


@query("g06_cepstral_frames", f"""{CEPSTRA}
SELECT vec_id AS recording_id, coef::INTEGER AS coef, 0::BIGINT AS frame, {s6("sum(cos(pi() / 128 * (m + 0.5) * coef) * db) * sqrt(2 / 128.0::DOUBLE) * CASE WHEN coef = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END")} AS value
FROM c, (SELECT unnest(range(20)) AS coef) GROUP BY vec_id, coef""")
def g06(spark, sf):
    return six(S.chunked_cepstra(samples(spark, sf), 16000))


SUMMARY = ", ".join(
    f"{s6(f'avg(value) FILTER (coef = {i})')} AS mfcc{i:02d}_mean, {s6(f'stddev_pop(value) FILTER (coef = {i})')} AS mfcc{i:02d}_std" for i in range(4)
)


@query("g07_coefficient_summary", f"WITH {FRAMES} SELECT recording_id, {SUMMARY} FROM frames GROUP BY recording_id")
def g07(spark, sf):
    return six(S.coefficient_summary(frames(spark, sf), 4, "value", "mfcc"))


def edged(order, frames="l"):
    """A derivative at every frame of a list: the window of the nearest centred frame."""
    weights, scale = S.savgol(order)
    return "(" + " + ".join(f"({w}) * {frames}[c + {o + 1}]" for o, w in weights.items() if w) + f") / {scale}"


DSUM = ", ".join(
    f"{s6(f'avg(d) FILTER (coef = {i})')} AS delta{i:02d}_mean, {s6(f'stddev_pop(d) FILTER (coef = {i})')} AS delta{i:02d}_std" for i in range(4)
)


@query("g08_channel_invariant_set", f"""WITH {FRAMES}, l AS (SELECT recording_id, coef, list(value ORDER BY frame) AS l FROM frames GROUP BY ALL),
f AS (SELECT *, least(greatest(unnest(range(len(l))), 4), len(l) - 5) AS c FROM l), dl AS (SELECT recording_id, coef, {edged(1)} AS d FROM f)
SELECT recording_id, {DSUM} FROM dl GROUP BY recording_id""")
def g08(spark, sf):
    d, _ = S.deltas(frames(spark, sf), ["recording_id", "coef"], "frame", "value")
    return six(S.coefficient_summary(d, 4, "delta1", "delta"))


#: A frame is voiced when its value is large enough to pass as a pitch.
PITCH = "pitch AS (SELECT user_id AS recording_id, CASE WHEN value > 100 THEN value ELSE 0 END AS f0 FROM events)"


@query("g09_pitch_summary", f"""WITH {PITCH}, a AS (SELECT recording_id, avg(f0) FILTER (f0 > 0) AS m, stddev_pop(f0) FILTER (f0 > 0) AS sd, min(f0) FILTER (f0 > 0) AS lo, max(f0) FILTER (f0 > 0) AS hi, count(*) FILTER (f0 > 0) AS v, count(*) AS n FROM pitch GROUP BY 1)
SELECT recording_id, CASE WHEN v >= 5 THEN {s6('m')} END AS f0_mean, CASE WHEN v >= 5 THEN {s6('sd')} END AS f0_std, CASE WHEN v >= 5 THEN {s6('lo')} END AS f0_min, CASE WHEN v >= 5 THEN {s6('hi')} END AS f0_max,
 CASE WHEN v >= 5 THEN {s6('hi - lo')} END AS f0_range, CASE WHEN v >= 5 THEN {s6('v / (n - v + 1e-12)')} END AS voiced_unvoiced_ratio, CASE WHEN v < 5 THEN 'too few voiced frames' END AS error FROM a""")
def g09(spark, sf):
    pitch = table(spark, sf, "events").select(F.col("user_id").alias("recording_id"), F.when(F.col("value") > 100, F.col("value")).otherwise(0.0).alias("f0"))
    kept, rejected = S.pitch_summary(pitch, "f0")
    return six(kept.unionByName(rejected, allowMissingColumns=True))


def _valid(offsets, factor_amp=False):
    t = [f"t{o}".replace("-", "m") for o in offsets]
    a = [f"a{o}".replace("-", "m") for o in offsets]
    cond = [f"{x} BETWEEN 0.0001 AND 0.02" for x in t]
    cond += [f"greatest({x}, {y}) <= least({x}, {y}) * 1.3" for x, y in zip(t, t[1:])]
    if factor_amp:
        cond += [f"greatest({x}, {y}) <= least({x}, {y}) * 1.6" for x, y in zip(a, a[1:])]
    # a neighbour beyond the end of the signal makes the run invalid
    return " AND ".join([*(f"{x} IS NOT NULL" for x in t), *cond])


def _measure(v, offsets, amp):
    names = [f"{v}{o}".replace("-", "m") for o in offsets]
    value = f"abs({v}0 - {v}m1)" if len(offsets) == 2 else f"abs({v}0 - ({' + '.join(names)}) / {len(offsets)})"
    mean = f"avg({v}0) FILTER (t0 BETWEEN 0.0001 AND 0.02)"
    return s6(f"coalesce(avg({value}) FILTER ({_valid(offsets, amp)}) / {mean}, 0)")


NEAR = ", ".join(
    f"{'lead' if o > 0 else 'lag'}({c}, {abs(o)}) OVER w AS {n}{str(o).replace('-', 'm')}" for o in (-2, -1, 0, 1, 2) for c, n in (("period", "t"), ("amplitude", "a"))
)
P2, P3, P5 = (-1, 0), (-1, 0, 1), (-2, -1, 0, 1, 2)


@query("g10_perturbation", f"""WITH {SIG}, per AS (SELECT recording_id, pos, CASE WHEN value > 300 THEN 0.03 ELSE 0.005 + (value % 10) / 10000 END AS period, 1 + value / 1000 AS amplitude FROM sig),
nb AS (SELECT recording_id, {NEAR} FROM per WINDOW w AS (PARTITION BY recording_id ORDER BY pos))
SELECT recording_id, {_measure('t', P2, False)} AS jitter_local, {_measure('t', P3, False)} AS jitter_rap, {_measure('t', P5, False)} AS jitter_ppq5,
 {_measure('a', P2, True)} AS shimmer_local, {_measure('a', P3, True)} AS shimmer_apq3, {_measure('a', P5, True)} AS shimmer_apq5 FROM nb GROUP BY recording_id""")
def g10(spark, sf):
    v = F.col("value")
    per = signals(spark, sf).select(
        "recording_id", "pos", F.when(v > 300, 0.03).otherwise(F.lit(0.005) + (v % 10) / 10000).alias("period"), (F.lit(1) + v / 1000).alias("amplitude")
    )
    return six(S.perturbation(per))


def _between(lo, hi, k):
    return f"({lo} + {hi - lo} * {uniform_sql(SEED + k, 'recording_id')})"


@query("g11_augmentation", f"""WITH {SIG}, t AS (SELECT recording_id, pos, (x - {_between(-0.4, 0.4, 0)} * coalesce(lag(x) OVER (PARTITION BY recording_id ORDER BY pos), 0)) * pow(10, {_between(-4.0, 4.0, 1)} / 20) AS y FROM sig),
r AS (SELECT *, sqrt(avg(y * y) OVER (PARTITION BY recording_id)) + 1e-12 AS rms FROM t),
n AS (SELECT recording_id, pos, y + rms / pow(10, {_between(25.0, 45.0, 2)} / 20) * {normal_sql(SEED + 3, 'recording_id', 'pos')} AS y FROM r)
SELECT recording_id, pos, {s6('y / max(abs(y)) OVER (PARTITION BY recording_id)')} AS x FROM n""")
def g11(spark, sf):
    return S.augment(signals(spark, sf).select("recording_id", "pos", "x"), SEED).select("recording_id", "pos", r6("x").alias("x"))


@query("g12_noise_floor", f"""WITH {LEVELS}, q AS (SELECT recording_id, coalesce(sqrt(sum(sq) FILTER (speech = 0) / nullif(sum(n) FILTER (speech = 0), 0)), 1e-6) AS q FROM lv GROUP BY 1)
SELECT recording_id, pos, {s6(f"CASE WHEN q < {10.0 ** (TARGET_DB / 20.0)!r}::DOUBLE THEN x + sqrt(greatest(0, {10.0 ** (TARGET_DB / 20.0)!r}::DOUBLE * {10.0 ** (TARGET_DB / 20.0)!r}::DOUBLE - q * q)) * {normal_sql(SEED, 'recording_id', 'pos')} ELSE x END")} AS x
FROM sig JOIN q USING (recording_id)""")
def g12(spark, sf):
    sig = signals(spark, sf)
    out = S.equalise_noise_floor(sig, S.frame_levels(sig, FRAME, TOP_DB), FRAME, TARGET_DB, SEED)
    return out.select("recording_id", "pos", r6("x").alias("x"))


KINDS = sorted(S.EXTRACTORS)


@query("g13_bulk_extract", f"""SELECT kind, vec_id AS recording_id, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN kind = 'mfcc' THEN 40 WHEN kind = 'spectral' THEN 2 END::INTEGER AS n_features,
 CASE WHEN vec_id % 5 = 0 THEN 'no samples' WHEN kind NOT IN ('mfcc', 'spectral') THEN 'extractor returned no features' END AS error FROM embeddings, (SELECT unnest({KINDS}) AS kind)""")
def g13(spark, sf):
    """The whole registry. Every fifth signal is emptied; the others hold too little silence and too few frames for three kinds."""
    emptied = F.when(F.col("recording_id") % 5 == 0, F.array().cast("array<float>")).otherwise(F.col("samples"))
    src, parts = arrays(spark, sf).withColumn("samples", emptied), []
    for kind in KINDS:
        kept, rejected = S.extract(src, "samples", kind, 16000)
        rows = kept.select("recording_id", F.size("features").alias("n_features"))
        parts.append(rows.unionByName(rejected.select("recording_id", "error"), allowMissingColumns=True).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


EXT = ", ".join(f"{s6(f'embedding[{i + 1}]')} AS ext{i:02d}" for i in range(64))


@query("g14_external_features", f"SELECT vec_id AS recording_id, label, {EXT} FROM embeddings")
def g14(spark, sf):
    emb = table(spark, sf, "embeddings")
    wide = emb.select(F.col("vec_id").alias("recording_id"), "label", *[r6(F.col("embedding")[i].cast("double")).alias(f"ext{i:02d}") for i in range(64)])
    return ingest_external(wide, "recording_id", [f"ext{i:02d}" for i in range(64)])


def ingest_external(df, key, features):
    """A precomputed feature table is taken only when its columns and values are whole."""
    absent = [f for f in [key, *features] if f not in df.columns]
    if absent:
        raise ValueError(f"external feature table lacks {absent}")
    checks = Q.missing_counts(df, features).where("n_missing > 0").select("feature").unionByName(
        Q.constant_columns(df, features).where("is_constant").select("feature")
    )
    bad = [r[0] for r in checks.limit(10).collect()]
    if bad:
        raise ValueError(f"external features with missing or constant values: {bad}")
    return df
