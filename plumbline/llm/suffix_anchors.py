"""Anchors: positions that equal strings of ``LENGTH`` bytes choose alike.

Every window of ``LENGTH`` bytes picks the leftmost of its ``GRAM``-byte grams with
the smallest hash. Equal windows pick the same place, so only windows with an equal
gram at their anchor can be equal, and neighbouring windows mostly share an anchor.
"""

from __future__ import annotations

import numpy as np

from . import vectors as V

LENGTH = 100
GRAM = 32
U64 = np.uint64


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, from running minima of blocks of ``w``."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(block: V.Block) -> dict[str, np.ndarray]:
    """Per anchor: ``owner``; first and last window start ``lo``/``hi`` and the
    anchor ``at``, within the document; ``gram`` hash at the anchor; ``region`` hash of all bytes its windows span.
    """
    data, off = block.data, block.offsets
    n = len(data) - LENGTH + 1
    empty = {k: np.zeros(0, t) for k, t in (("owner", np.int64), ("lo", np.int64), ("hi", np.int64), ("at", np.int64), ("gram", U64), ("region", U64))}
    if n <= 0:
        return empty
    prefix = V.prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = V.span_hash(prefix, at, at + GRAM)
    bits = max(21, int(len(data)).bit_length())
    keyed = ((gram >> U64(bits)) << U64(bits)) | at.astype(U64)
    chosen = (_sliding_min(keyed, LENGTH - GRAM + 1) & U64((1 << bits) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(block.n), np.diff(off))[:n]
    inside = np.flatnonzero(np.arange(n) + LENGTH <= off[owner + 1])
    if not len(inside):
        return empty
    chosen, owner = chosen[inside], owner[inside]
    first = np.ones(len(inside), dtype=bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(inside)) - 1
    lo, hi, q, who = inside[begin], inside[end], chosen[begin], owner[begin]
    return {
        "owner": who, "lo": lo - off[who], "hi": hi - off[who], "at": q - off[who], "gram": gram[q],
        "region": V.mix(V.span_hash(prefix, lo, hi + LENGTH) + (q - lo).astype(U64) * U64(0x9E3779B97F4A7C15)),
    }
