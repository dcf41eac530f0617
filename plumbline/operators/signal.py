"""Signal operators over long sample tables ``recording_id, pos, x`` and arrays.

One recording may be very long, so nothing here windows over a whole recording:
per-recording constants are aggregates joined back, neighbours come from
overlapping chunks, running counts from value ranges.
"""

from __future__ import annotations

from functools import lru_cache
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions.names import rms_db
from ..session import materialise
from .ordering import neighbours, running_totals

REC = ["recording_id"]

# Savitzky-Golay weights of a nine-point window.
SAVGOL_FIRST = ([-4, -3, -2, -1, 0, 1, 2, 3, 4], 60)
SAVGOL_SECOND = ([28, 7, -8, -17, -20, -17, -8, 7, 28], 462)


def savgol(order: int) -> tuple[dict[int, int], int]:
    weights, scale = SAVGOL_FIRST if order == 1 else SAVGOL_SECOND
    return dict(zip(range(-4, 5), weights)), scale


#: Samples of a recording that share a key.
SAMPLES_PER_KEY = 1 << 16


def with_values(df: DataFrame, parts: dict[str, Column], merged: dict[str, Column], pos: str = "pos") -> DataFrame:
    """Rows with values of their whole recording, however long it is.

    The values are added up per stretch of a recording, then per recording, and go back
    to the keys ``(recording, stretch)``; no key holds more than ``SAMPLES_PER_KEY`` rows.
    """
    rows = df.withColumn("_key", F.floor(F.col(pos) / F.lit(SAMPLES_PER_KEY)).cast("bigint"))
    per_key = rows.groupBy(*REC, "_key").agg(*[c.alias(n) for n, c in parts.items()])
    whole = per_key.groupBy(*REC).agg(*[c.alias(n) for n, c in merged.items()], F.collect_set("_key").alias("_keys"))
    back = whole.select(*REC, *merged, F.explode("_keys").alias("_key"))
    return rows.join(back, [*REC, "_key"]).drop("_key")


def peak_normalise(df: DataFrame, value: str = "x") -> DataFrame:
    peaked = with_values(df, {"_p": F.max(F.abs(value))}, {"_peak": F.max("_p")})
    scaled = F.when(F.col("_peak") > 0, F.col(value) / F.col("_peak")).otherwise(F.col(value))
    return peaked.withColumn(value, scaled).drop("_peak")


def cmvn(df: DataFrame, keys: Sequence[str], value: str, eps: float = 1e-8) -> DataFrame:
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(moments, list(keys)).withColumn(
        "z", (F.col(value) - F.col("_m")) / (F.col("_s") + F.lit(eps))
    ).drop("_m", "_s")


#: Frames on each side of a window, and frames of a window.
HALF, WIDTH = 4, 9


def deltas(df: DataFrame, keys: Sequence[str], frame: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: both derivatives of every frame; tracks under nine frames are rejects.

    A derivative of order ``k`` is that of a polynomial of degree ``k`` fitted to nine
    frames. In the middle of a track the window is centred. The four frames at each end
    share the window of the nearest centred frame, as the polynomial fitted there has the
    same derivative everywhere.
    """
    boxed = df.withColumn("_v", F.struct(F.col(value).cast("double").alias("v")))
    reach = WIDTH - 1
    near = neighbours(boxed, keys, frame, "_v", list(range(-reach, reach + 1)))
    at = lambda o: F.col(f"v_{o}".replace("-", "m"))
    missing = lambda offsets: sum(((at(o).isNull()).cast("int") for o in offsets), F.lit(0))
    near = near.withColumns({
        "_shift": missing(range(-HALF, 0)) - missing(range(1, HALF + 1)),
        "_near": F.array(*[at(o) for o in range(-reach, reach + 1)]),
    })
    pick = lambda j: F.get(F.col("_near"), F.col("_shift") + (reach + j))
    whole = pick(-HALF).isNotNull() & pick(HALF).isNotNull()

    def combine(order: int) -> Column:
        weights, scale = savgol(order)
        return sum((pick(o)["v"] * F.lit(w) for o, w in weights.items() if w), F.lit(0.0)) / F.lit(scale)

    kept = near.where(whole).select(*df.columns, combine(1).alias("delta1"), combine(2).alias("delta2"))
    short = near.where(~whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))
    return kept, short.withColumn("error", F.lit("track under nine frames"))


# -- silence -------------------------------------------------------------------------


def frame_levels(df: DataFrame, frame_len: int, top_db: float = 30.0, value: str = "x") -> DataFrame:
    """Per-frame sums and ``speech`` = within ``top_db`` of the loudest frame."""
    x = F.col(value)
    frames = df.groupBy(*REC, F.floor(F.col("pos") / frame_len).cast("bigint").alias("frame")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("sq"), F.sum(x).alias("s"),
        F.max(F.abs(x)).alias("peak"), F.count_if(F.abs(x) > 0.99).alias("clipped"),
    ).withColumn("ms", F.col("sq") / F.col("n"))
    loudest = frames.groupBy(*REC).agg(F.max("ms").alias("_top"))
    cut = F.col("_top") * F.lit(10.0 ** (-top_db / 10.0))
    return frames.join(loudest, REC).withColumn("speech", (F.col("ms") > cut).cast("int")).drop("_top")


def speech_intervals(levels: DataFrame, frame_len: int) -> DataFrame:
    """``recording_id, start, end`` of every run of speech frames, in samples."""
    prev = neighbours(levels.select(*REC, "frame", "speech", "n"), REC, "frame", "speech", [-1])
    begins = ((F.col("speech") == 1) & (F.coalesce(F.col("v_m1"), F.lit(0)) == 0)).cast("int")
    marked = prev.withColumn("_begin", begins)
    runs = running_totals(
        marked, REC, "frame", {"begin": F.max("_begin"), "speech": F.max("speech"), "n": F.max("n")}
    ).where("speech = 1")
    return runs.groupBy(*REC, F.col("cum_begin").alias("interval")).agg(
        (F.min("frame") * frame_len).alias("start"),
        F.max(F.col("frame") * frame_len + F.col("n")).alias("end"),
    )


def pause_rhythm(levels: DataFrame, intervals: DataFrame, rate: float) -> DataFrame:
    total = levels.groupBy(*REC).agg((F.sum("n") / F.lit(float(rate))).alias("duration"))
    speech = intervals.groupBy(*REC).agg(
        (F.sum(F.col("end") - F.col("start")) / F.lit(float(rate))).alias("speech_duration"),
        F.count(F.lit(1)).alias("_k"),
    )
    out = total.join(speech, REC, "left").na.fill(0, ["speech_duration", "_k"])
    pause = F.greatest(F.lit(0.0), F.col("duration") - F.col("speech_duration"))
    count = F.greatest(F.lit(0), F.col("_k") - 1).cast("double")
    return out.select(
        *REC, "duration", "speech_duration", pause.alias("pause_duration"), count.alias("pause_count"),
        F.coalesce(F.try_divide(pause, count), F.lit(0.0)).alias("mean_pause_dur"),
        (pause / (F.col("duration") + F.lit(1e-12))).alias("pause_ratio"),
    )


def channel_statistics(levels: DataFrame, min_silence: int) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)`` time-domain properties; too little silence is a reject."""
    quiet = F.col("speech") == 0
    part = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    agg = levels.groupBy(*REC).agg(
        F.max("peak").alias("ch_peak"), F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.sum("clipped").alias("_c"),
        part("n", quiet).alias("_nq"), part("sq", quiet).alias("_sq"),
        part("n", ~quiet).alias("_ns"), part("sq", ~quiet).alias("_ss"),
    )
    ok = (F.col("_nq") >= min_silence) & (F.col("_ns") > 0)
    silence = rms_db(F.col("_sq") / F.col("_nq"))
    speech = rms_db(F.col("_ss") / F.col("_ns"))
    kept = agg.where(ok).select(
        *REC, "ch_peak", silence.alias("ch_silence_db"), speech.alias("ch_speech_db"), (speech - silence).alias("ch_snr_db"),
        (F.col("_s") / F.col("_n")).alias("ch_dc_offset"), (F.col("_c") / F.col("_n")).alias("ch_clipped_fraction"),
    )
    return kept, agg.where(~ok).select(*REC, F.lit("too little silence").alias("error"))


# -- pitch and periods -----------------------------------------------------------------


def pitch_summary(df: DataFrame, f0: str, min_voiced: int = 5) -> tuple[DataFrame, DataFrame]:
    v = F.when(F.col(f0) > 0, F.col(f0))
    agg = df.groupBy(*REC).agg(
        F.avg(v).alias("f0_mean"), F.stddev_pop(v).alias("f0_std"), F.min(v).alias("f0_min"), F.max(v).alias("f0_max"),
        F.count(v).alias("_v"), F.count(F.lit(1)).alias("_n"),
    )
    kept = agg.where(F.col("_v") >= min_voiced).select(
        *REC, "f0_mean", "f0_std", "f0_min", "f0_max", (F.col("f0_max") - F.col("f0_min")).alias("f0_range"),
        (F.col("_v") / (F.col("_n") - F.col("_v") + F.lit(1e-12))).alias("voiced_unvoiced_ratio"),
    )
    return kept, agg.where(F.col("_v") < min_voiced).select(*REC, F.lit("too few voiced frames").alias("error"))


def perturbation(
    df: DataFrame, pos: str = "pos", period: str = "period", amplitude: str = "amplitude",
    shortest: float = 0.0001, longest: float = 0.02, period_factor: float = 1.3, amplitude_factor: float = 1.6,
) -> DataFrame:
    """Jitter (local, rap, ppq5) and shimmer (local, apq3, apq5) per recording.

    A run of neighbouring periods counts when all lie within the bounds and no two
    consecutive ones differ by more than the factor. Nothing to measure gives 0.
    """
    near = neighbours(
        df.withColumn("_pa", F.struct(F.col(period).alias("t"), F.col(amplitude).alias("a"))), REC, pos, "_pa", [-2, -1, 0, 1, 2]
    )
    cell = {o: F.col(f"v_{o}".replace("-", "m")) for o in (-2, -1, 0, 1, 2)}
    t = {o: c["t"] for o, c in cell.items()}
    a = {o: c["a"] for o, c in cell.items()}

    def within(values, factor, i, j):
        hi, lo = F.greatest(values[i], values[j]), F.least(values[i], values[j])
        return hi <= lo * F.lit(factor)

    def run(offsets):
        good = None
        for o in offsets:
            one = t[o].between(shortest, longest)
            good = one if good is None else good & one
        for i, j in zip(offsets, offsets[1:]):
            good = good & within(t, period_factor, i, j)
        return good

    def amp(offsets):
        good = run(offsets)
        for i, j in zip(offsets, offsets[1:]):
            good = good & within(a, amplitude_factor, i, j)
        return good

    def off_centre(values, offsets):
        total = values[offsets[0]]
        for o in offsets[1:]:
            total = total + values[o]
        return F.abs(values[0] - total / F.lit(float(len(offsets))))

    pair, three, five = [-1, 0], [-1, 0, 1], [-2, -1, 0, 1, 2]
    mean_t = F.avg(F.when(t[0].between(shortest, longest), t[0]))
    mean_a = F.avg(F.when(t[0].between(shortest, longest), a[0]))

    def ratio(value, cond, mean):
        return F.coalesce(F.try_divide(F.avg(F.when(cond, value)), mean), F.lit(0.0))

    return near.groupBy(*REC).agg(
        ratio(F.abs(t[0] - t[-1]), run(pair), mean_t).alias("jitter_local"),
        ratio(off_centre(t, three), run(three), mean_t).alias("jitter_rap"),
        ratio(off_centre(t, five), run(five), mean_t).alias("jitter_ppq5"),
        ratio(F.abs(a[0] - a[-1]), amp(pair), mean_a).alias("shimmer_local"),
        ratio(off_centre(a, three), amp(three), mean_a).alias("shimmer_apq3"),
        ratio(off_centre(a, five), amp(five), mean_a).alias("shimmer_apq5"),
    )


# -- augmentation ------------------------------------------------------------------------


def augment(df: DataFrame, seed: int, value: str = "x") -> DataFrame:
    """Tilt, gain, noise at a drawn SNR, peak normalisation; parameters per recording."""
    rec, pos = F.col("recording_id"), F.col("pos")
    between = lambda lo, hi, k: F.lit(lo) + F.lit(hi - lo) * D.uniform(seed + k, rec)
    near = neighbours(df, REC, "pos", value, [-1])
    tilted = (F.col(value) - between(-0.4, 0.4, 0) * F.coalesce(F.col("v_m1"), F.lit(0.0))) * F.pow(
        F.lit(10.0), between(-4.0, 4.0, 1) / F.lit(20.0)
    )
    out = near.select(*df.columns, tilted.alias("_y"))
    power = {"_sq": F.sum(F.col("_y") * F.col("_y")), "_n": F.count("_y")}
    out = with_values(out, power, {"_rms": F.sqrt(F.sum("_sq") / F.sum("_n")) + F.lit(1e-12)})
    noise_rms = F.col("_rms") / F.pow(F.lit(10.0), between(25.0, 45.0, 2) / F.lit(20.0))
    noisy = out.withColumn("_y", F.col("_y") + noise_rms * D.normal(seed + 3, rec, pos))
    return peak_normalise(noisy.drop("_rms", value).withColumnRenamed("_y", value), value)


def equalise_noise_floor(df: DataFrame, levels: DataFrame, frame_len: int, target_db: float, seed: int, value: str = "x") -> DataFrame:
    """Add noise to recordings whose silence is below the target level."""
    target = 10.0 ** (target_db / 20.0)
    key = lambda c: F.floor(c / F.lit(SAMPLES_PER_KEY)).cast("bigint").alias("_key")
    silent = lambda c: F.sum(F.when(F.col("speech") == 0, F.col(c)))
    per_key = levels.groupBy(*REC, key(F.col("frame") * frame_len)).agg(
        silent("sq").alias("_sq"), silent("n").alias("_n"), F.max(F.floor((F.col("frame") * frame_len + F.col("n") - 1) / F.lit(SAMPLES_PER_KEY))).alias("_last")
    )
    quiet = per_key.groupBy(*REC).agg(
        F.coalesce(F.sqrt(F.try_divide(F.sum("_sq"), F.sum("_n"))), F.lit(1e-6)).alias("_q"), F.max("_last").cast("bigint").alias("_last")
    )
    back = quiet.select(*REC, "_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("_key"))
    need = F.sqrt(F.greatest(F.lit(0.0), F.lit(target * target) - F.col("_q") * F.col("_q")))
    noise = need * D.normal(seed, F.col("recording_id"), F.col("pos"))
    lifted = F.when(F.col("_q") < target, F.col(value) + noise).otherwise(F.col(value))
    rows = df.withColumn("_key", key(F.col("pos")))
    return rows.join(back, [*REC, "_key"]).withColumn(value, lifted).drop("_q", "_key")


# -- coefficient tables --------------------------------------------------------------------


def coefficient_summary(df: DataFrame, n_coef: int, value: str, prefix: str) -> DataFrame:
    """Mean and population SD per coefficient, one wide row per recording."""
    aggs = []
    for i in range(n_coef):
        v = F.when(F.col("coef") == i, F.col(value))
        aggs += [F.avg(v).alias(f"{prefix}{i:02d}_mean"), F.stddev_pop(v).alias(f"{prefix}{i:02d}_std")]
    return df.groupBy(*REC).agg(*aggs)


# -- spectra and cepstra -------------------------------------------------------------------


def _power_frames(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Magnitude spectra of centred Hann frames, ``(bins, frames)``."""
    padded = np.pad(x, n_fft // 2)
    count = 1 + (len(padded) - n_fft) // hop
    at = np.arange(n_fft)[None, :] + hop * np.arange(count)[:, None]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.abs(np.fft.rfft(padded[at] * hann, axis=1)).T


@lru_cache(maxsize=8)
def _mel_filters(rate: int, n_fft: int, n_mels: int = 128) -> np.ndarray:
    """Area-normalised triangles on the auditory scale: linear to 1 kHz, then log."""
    step, knee, ratio = 200.0 / 3, 1000.0, np.log(6.4) / 27.0
    to_mel = lambda f: f / step if f < knee else knee / step + np.log(f / knee) / ratio
    mels = np.linspace(0.0, to_mel(rate / 2.0), n_mels + 2)
    hz = np.where(mels < knee / step, mels * step, knee * np.exp(ratio * (mels - knee / step)))
    bins = np.fft.rfftfreq(n_fft, 1.0 / rate)
    rise = (bins[None, :] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    fall = (hz[2:, None] - bins[None, :]) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(rise, fall)) * (2.0 / (hz[2:] - hz[:-2]))[:, None]


def log_mel(magnitude: np.ndarray, rate: int, n_fft: int) -> np.ndarray:
    """Decibels per auditory band and frame, not yet cut at the floor below the loudest."""
    return 10.0 * np.log10(np.maximum(_mel_filters(rate, n_fft) @ magnitude**2, 1e-10))


#: What is further below the loudest band of a recording counts as this far below.
TOP_DB = 80.0


def cosine_basis(n: int, n_coef: int) -> np.ndarray:
    basis = np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(n_coef)[:, None]) * np.sqrt(2.0 / n)
    basis[0] /= np.sqrt(2.0)
    return basis


def cepstra(x: np.ndarray, rate: int, n_coef: int = 20, n_fft: int = 2048, hop: int = 512) -> np.ndarray:
    db = log_mel(_power_frames(x, n_fft, hop), rate, n_fft)
    return cosine_basis(db.shape[0], n_coef) @ np.maximum(db, db.max() - TOP_DB)


# -- long recordings: chunks with a halo ----------------------------------------------------


def chunk_rows(df: DataFrame, n_fft: int, hop: int, frames: int, value: str = "x") -> DataFrame:
    """``recording_id, chunk, first, samples`` of a sample table ``recording_id, pos, x``.

    A chunk holds the samples under the centred windows of ``frames`` neighbouring frames;
    those near a border are in both chunks. Positions are dense and start at 0.
    """
    half, span = n_fft // 2, frames * hop
    lo = F.greatest(F.floor((F.col("pos") - F.lit(half - 1 + (frames - 1) * hop) + F.lit(span - 1)) / F.lit(span)), F.lit(0))
    hi = F.floor((F.col("pos") + F.lit(half)) / F.lit(span))
    spread = df.select(*REC, "pos", F.col(value).cast("double").alias("x"), F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))).alias("chunk"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return spread.groupBy(*REC, "chunk").agg(F.min("pos").alias("first"), ordered.alias("s")).select(
        *REC, "chunk", "first", F.transform("s", lambda s: s["x"]).alias("samples")
    )


def _chunk_frames(x: np.ndarray, first: int, chunk: int, n_fft: int, hop: int, frames: int) -> np.ndarray:
    """Magnitude spectra of a chunk's frames as one product, ``(bins, frames)``."""
    start, last = chunk * frames * hop - n_fft // 2, first + len(x) - 1
    # A recording of n samples has 1 + n // hop frames.
    count = min(frames, max((last + 1) // hop - chunk * frames + 1, 0))
    room = np.zeros((max(count, 1) - 1) * hop + n_fft)
    offset = first - start
    x = x[: max(0, len(room) - offset)]
    room[offset:offset + len(x)] = x
    at = np.arange(n_fft)[None, :] + hop * np.arange(count)[:, None]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    return np.abs(np.fft.rfft(room[at] * hann, axis=1)).T


def chunked_cepstra(df: DataFrame, rate: int, n_coef: int = 20, n_fft: int = 2048, hop: int = 512, frames: int = 256, value: str = "x") -> DataFrame:
    """``recording_id, coef, frame, value`` of a sample table; a long recording is many rows.

    The floor below the loudest band is one number per recording, which goes back to its
    chunks by ``(recording, chunk)``.
    """
    chunks = chunk_rows(df, n_fft, hop, frames, value)
    kind = dict(df.dtypes)["recording_id"]

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [
                log_mel(_chunk_frames(np.asarray(x.values), first, chunk, n_fft, hop, frames), rate, n_fft)
                for chunk, first, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))
            ]
            top = [float(m.max()) if m.size else None for m in made]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(top, pa.float64()), pa.array([m.T.tobytes() for m in made], pa.binary())],
                names=["recording_id", "chunk", "top", "bands"],
            )

    mel = materialise(chunks.mapInArrow(bands, f"recording_id {kind}, chunk bigint, top double, bands binary"))
    loudest = mel.groupBy(*REC).agg(F.max("top").alias("_top"), F.collect_list("chunk").alias("_chunks"))
    back = loudest.select(*REC, "_top", F.explode("_chunks").alias("chunk"))

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (chunk, top, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))):
                db = np.frombuffer(data.as_py()).reshape(-1, 128).T
                if not db.size:
                    continue
                c = cosine_basis(128, n_coef) @ np.maximum(db, top - TOP_DB)
                coef, frame = np.indices(c.shape)
                rec = pa.array([b.column(0)[i].as_py()] * c.size, b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [rec, pa.array(coef.ravel(), pa.int32()), pa.array(frame.ravel() + chunk * frames, pa.int64()), pa.array(c.ravel())],
                    names=["recording_id", "coef", "frame", "value"],
                )

    rows = mel.join(back, [*REC, "chunk"]).select(*REC, "chunk", "_top", "bands")
    return rows.mapInArrow(coefficients, f"recording_id {kind}, coef int, frame bigint, value double")


def chunked_spectrum(df: DataFrame, n_fft: int = 512, hop: int = 128, frames: int = 1024, value: str = "x") -> DataFrame:
    """``recording_id, ch_lf_ratio, ch_hf_ratio`` of a sample table, from sums per chunk."""
    kind = dict(df.dtypes)["recording_id"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for chunk, first, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                per_bin = _chunk_frames(np.asarray(x.values), first, chunk, n_fft, hop, frames).sum(axis=1)
                told.append((per_bin[:20].sum(), per_bin[200:].sum(), per_bin.sum()))
            columns = [pa.array(c, pa.float64()) for c in zip(*told)] if told else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["recording_id", "lo", "hi", "all"])

    parts = chunk_rows(df, n_fft, hop, frames, value).mapInArrow(sums, f"recording_id {kind}, lo double, hi double, all double")
    whole = parts.groupBy(*REC).agg(*[F.sum(c).alias(c) for c in ("lo", "hi", "all")])
    return whole.select(*REC, F.try_divide("lo", "all").alias("ch_lf_ratio"), F.try_divide("hi", "all").alias("ch_hf_ratio"))


# -- registry of array extractors -------------------------------------------------------------


def spectral_shares(x: np.ndarray, rate: int) -> dict[str, float] | None:
    mean = _power_frames(x, 512, 128).mean(axis=1)
    if mean.sum() == 0:
        return None
    share = mean / mean.sum()
    return {"ch_lf_ratio": float(share[:20].sum()), "ch_hf_ratio": float(share[200:].sum())}


def cepstral_summary(x: np.ndarray, rate: int) -> dict[str, float]:
    c = cepstra(x, rate)
    out = {}
    for i, row in enumerate(c):
        out[f"mfcc{i:02d}_mean"], out[f"mfcc{i:02d}_std"] = float(row.mean()), float(row.std())
    return out


def _silent(x: np.ndarray, rate: int, top_db: float = 30.0) -> np.ndarray:
    """Samples of 32 ms frames at least ``top_db`` below the loudest frame, as in :func:`frame_levels`."""
    frame_len = max(1, rate * 32 // 1000)
    starts = np.arange(0, len(x), frame_len)
    power = np.add.reduceat(x * x, starts) / np.diff(np.r_[starts, len(x)])
    return np.repeat(power <= power.max() * 10.0 ** (-top_db / 10.0), np.diff(np.r_[starts, len(x)]))


def silence_summary(x: np.ndarray, rate: int) -> dict[str, float] | None:
    """Cepstra of the silent samples alone; under 250 ms of them say nothing."""
    quiet = x[_silent(x, rate)]
    if len(quiet) < rate // 4:
        return None
    out = {f"sil_{name}": value for name, value in cepstral_summary(quiet, rate).items()}
    return {"silence_seconds": len(quiet) / rate, **out}


def channel_summary(x: np.ndarray, rate: int) -> dict[str, float] | None:
    """Eight properties of level, noise floor and tilt; under 100 ms of silence has no floor."""
    mask = _silent(x, rate)
    quiet, loud = x[mask], x[~mask]
    if len(quiet) < rate // 10 or not len(loud):
        return None
    db = lambda v: float(20 * np.log10(np.sqrt(np.mean(v * v)) + 1e-12))
    return {
        "ch_peak": float(np.abs(x).max()), "ch_silence_db": db(quiet), "ch_speech_db": db(loud), "ch_snr_db": db(loud) - db(quiet),
        "ch_dc_offset": float(x.mean()), "ch_clipped_fraction": float((np.abs(x) > 0.99).mean()), **(spectral_shares(x, rate) or {}),
    }


def invariant_summary(x: np.ndarray, rate: int) -> dict[str, float] | None:
    """Mean and SD of first cepstral derivatives, which a constant channel does not change."""
    c = cepstra(x, rate)
    if c.shape[1] < WIDTH:
        return None
    weights, scale = savgol(1)
    centre = np.clip(np.arange(c.shape[1]), HALF, c.shape[1] - HALF - 1)
    d = sum(c[:, centre + o] * w for o, w in weights.items() if w) / scale
    return {f"cmvn_delta{i:02d}_{n}": float(v) for i, row in enumerate(d) for n, v in (("mean", row.mean()), ("std", row.std()))}


EXTRACTORS: dict[str, Callable[[np.ndarray, int], dict[str, float] | None]] = {
    "mfcc": cepstral_summary,
    "spectral": spectral_shares,
    "silence": silence_summary,
    "channel": channel_summary,
    "channel_invariant": invariant_summary,
}


def extract(df: DataFrame, samples: str, kind: str, rate: int) -> tuple[DataFrame, DataFrame]:
    """``(features, rejects)``: an extractor over every row, errors reported not hidden."""
    if kind not in EXTRACTORS:
        raise KeyError(f"unknown feature set {kind!r}; expected one of {sorted(EXTRACTORS)}")
    fn = EXTRACTORS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec, x in zip(batch["recording_id"], batch[samples]):
                if x is None or not len(x):
                    rows.append((rec, None, "no samples"))
                    continue
                try:
                    values = fn(np.asarray(x, dtype=float), rate)
                    rows.append((rec, values, None if values else "extractor returned no features"))
                except Exception as exc:  # noqa: BLE001 - goes to the reject table
                    rows.append((rec, None, repr(exc)))
            yield pd.DataFrame(rows, columns=["recording_id", "features", "error"])

    done = df.select("recording_id", samples).mapInPandas(
        run, "recording_id bigint, features map<string,double>, error string"
    )
    return done.where("error IS NULL").drop("error"), done.where("error IS NOT NULL").drop("features")
