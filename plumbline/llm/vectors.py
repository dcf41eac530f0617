"""Array kernels over Arrow text columns.

A text column arrives as one byte buffer with offsets, so words, lines and their
hashes are found for thousands of documents at once without a Python loop per word.
Work is cut into blocks of about a megabyte; a block always holds whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.Generator(np.random.PCG64(20240131))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES * 2)
            self.up, self.down = _powers(BASE, size), _powers(BASE_INVERSE, size)
        return self.up[:n], self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = np.array(h, dtype=U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Block:
    """Whole documents of one batch: rows ``lo`` to ``hi``."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_doc(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted positions lie in each document."""
        return np.diff(np.searchsorted(positions, self.offsets))

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        return self.per_doc(np.flatnonzero(flags))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and int64 offsets of a text or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; a run ends with its document."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(flags)
    before[0], before[1:] = False, flags[:-1]
    before[offsets[:-1][offsets[:-1] < len(flags)]] = False
    after = np.empty_like(flags)
    after[-1], after[:-1] = False, flags[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, equal for equal bytes."""
    _, down = _POWERS.get(len(prefix) + 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def shingle_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes; positions run over the whole block."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for i in range(k):
        out *= U64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    return mix(out)


def hash_text(text: str) -> int:
    """Hash of a single string by the same rule."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])


def lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every ``\\n``-split line, the line feed left out."""
    feeds = np.flatnonzero(block.data == 10)
    some = np.flatnonzero(np.diff(block.offsets) > 0)
    starts = np.concatenate([block.offsets[:-1][some], feeds + 1])
    ends = np.concatenate([feeds, block.offsets[1:][some]])
    return np.sort(starts), np.sort(ends)


def repeated(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per element: does its key occur twice in its document, and did it occur before.

    Elements must be in text order within a document.
    """
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    same = np.zeros(len(o), dtype=bool)
    if len(o) > 1:
        same[1:] = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
    twice = same.copy()
    if len(o) > 1:
        twice[:-1] |= same[1:]
    many, later = np.zeros(len(o), dtype=bool), np.zeros(len(o), dtype=bool)
    many[order], later[order] = twice, same
    return many, later


def output(batch_like: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """Record batch from ``{name: (values, type)}``."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in batch_like.values()],
        names=list(batch_like),
    )
