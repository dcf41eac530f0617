"""Deterministic random draws, in three equal spellings: Spark, SQL and numpy.

A draw is a pure function of a seed and integer keys, so it does not depend on
partitioning, survives task retries and can be recomputed anywhere. The state is
folded over the keys with ``state = ((state xor key) * A + C) mod P`` and finished
with two more such rounds; every step fits a signed 64-bit integer.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest prime below 2**32, odd multipliers below 2**31.
PRIME = 4294967291
FOLD = (1597334677, 374761393)
FINISH = ((2654435769, 747796405, 12345), (3266489917, 1103515245, 668265263))
LOW32 = 0xFFFFFFFF


def _halves(key: int) -> list[int]:
    return [key & LOW32, (key >> 32) & LOW32]


def _step(state, key, mult, add, xor):
    return (xor(state, key) * mult + add) % PRIME


def _start(seed: int) -> int:
    return reduce(lambda s, k: _step(s, k, *FOLD, lambda a, b: a ^ b), _halves(seed), 1)


# -- Spark ---------------------------------------------------------------------

def draw(seed: int, *keys: Column | int) -> Column:
    """Integer in ``[0, PRIME)`` as a codegen-friendly expression."""
    xor = lambda a, b: a.bitwiseXOR(b)
    state = F.lit(_start(seed)).cast("bigint")
    for key in keys:
        col = F.lit(key).cast("bigint") if isinstance(key, int) else key.cast("bigint")
        for half in (col.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(col, 32)):
            state = _step(state, half, *FOLD, xor)
    for salt, mult, add in FINISH:
        state = _step(state, F.lit(salt).cast("bigint"), mult, add, xor)
    return state


def uniform(seed: int, *keys: Column | int) -> Column:
    """Double in ``(0, 1)``."""
    return (draw(seed, *keys) + F.lit(0.5)) / F.lit(float(PRIME))


def normal(seed: int, *keys: Column | int) -> Column:
    """Standard normal by Box-Muller from two draws."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, *keys)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed + 1, *keys))


def text_key(col: Column) -> Column:
    """First 60 bits of the MD5 of a string, as an integer key."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 15), 16, 10).cast("bigint")


def unit_key(df: DataFrame, unit: str) -> Column:
    """Integer key of a column: integers as they are, anything else through its text."""
    whole = dict(df.dtypes)[unit] in ("tinyint", "smallint", "int", "bigint")
    return F.col(unit).cast("bigint") if whole else text_key(F.col(unit))


def poisson(seed: int, *keys: Column | int) -> Column:
    """Poisson(1) count by comparing one draw with fixed cut points."""
    u = draw(seed, *keys)
    return reduce(lambda a, b: a + b, [(u >= F.lit(t)).cast("int") for t in POISSON_CUTS])


# -- numpy ---------------------------------------------------------------------

def _step_np(state, key: np.ndarray, mult: int, add: int) -> np.ndarray:
    """One round without sign and in place: division by a constant is fast only so."""
    out = np.asarray(state ^ key)
    out *= np.uint64(mult)
    out += np.uint64(add)
    whole = np.asarray(out // np.uint64(PRIME))
    whole *= np.uint64(PRIME)
    out -= whole
    return out


def draw_np(seed: int, *keys) -> np.ndarray:
    state = np.uint64(_start(seed))
    for key in keys:
        key = np.asarray(key, dtype=np.int64).astype(np.uint64)
        for half in (key & np.uint64(LOW32), key >> np.uint64(32)):
            state = _step_np(state, half, *FOLD)
    for salt, mult, add in FINISH:
        state = _step_np(state, np.uint64(salt), mult, add)
    return np.asarray(state).astype(np.int64)[()]


def poisson_bytes(seed: int, *keys) -> np.ndarray:
    """Poisson(1) counts as bytes; none is larger than the number of cut points."""
    u = np.asarray(draw_np(seed, *keys)).astype(np.uint32)
    out = np.zeros(u.shape, dtype=np.uint8)
    for cut in POISSON_CUTS[:3]:
        out += u >= np.uint32(cut)
    rare = np.flatnonzero(u >= np.uint32(POISSON_CUTS[3]))
    out.flat[rare] = np.searchsorted(POISSON_CUTS, u.flat[rare], side="right")
    return out


def poisson_np(seed: int, *keys) -> np.ndarray:
    return poisson_bytes(seed, *keys).astype(np.int64)[()]


def _poisson_cuts() -> list[int]:
    cuts, cdf = [], 0.0
    for k in range(12):
        cdf += math.exp(-1) / math.factorial(k)
        cuts.append(int(cdf * PRIME))
    return cuts


POISSON_CUTS = _poisson_cuts()


# -- SQL -----------------------------------------------------------------------

def draw_sql(seed: int, *keys: str | int) -> str:
    state = str(_start(seed))
    for key in keys:
        for half in (f"(({key})::BIGINT & {LOW32})", f"((({key})::BIGINT >> 32) & {LOW32})"):
            state = f"((xor(({state})::BIGINT, {half}) * {FOLD[0]} + {FOLD[1]}) % {PRIME})"
    for salt, mult, add in FINISH:
        state = f"((xor({state}, {salt}::BIGINT) * {mult} + {add}) % {PRIME})"
    return state


def uniform_sql(seed: int, *keys: str | int) -> str:
    return f"(({draw_sql(seed, *keys)} + 0.5::DOUBLE) / {PRIME}::DOUBLE)"


def normal_sql(seed: int, *keys: str | int) -> str:
    return (
        f"(sqrt(-2.0::DOUBLE * ln({uniform_sql(seed, *keys)})) "
        f"* cos(2::DOUBLE * pi() * {uniform_sql(seed + 1, *keys)}))"
    )


def text_key_sql(expr: str) -> str:
    return f"(('0x' || substr(md5(({expr})::VARCHAR), 1, 15))::BIGINT)"


def poisson_sql(seed: int, *keys: str | int) -> str:
    u = draw_sql(seed, *keys)
    cases = " ".join(f"WHEN {t} <= u_ THEN {i + 1}" for i, t in reversed(list(enumerate(POISSON_CUTS))))
    return f"(SELECT CASE {cases} ELSE 0 END FROM (SELECT {u} AS u_))"
