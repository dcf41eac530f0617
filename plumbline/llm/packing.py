"""Online packing of token ids into windows with bounded space.

Each partition keeps at most ``OPEN`` windows. A document's full windows leave at
once; its remainder goes into the open window that it fits best. When it fits none
and all places are taken, the fullest window is topped up with the head of the
remainder and leaves. What is open at the end of a partition is packed again in groups of about
``OPEN * FAN_IN`` windows, each of which leaves at most ``OPEN`` open, until there is one
group; there the last pieces are laid end to end. Only open windows keep their ids.

Edge cases: a null text counts as empty and is packed as its end id; repeated ids are
packed row by row; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 1
WINDOW = 2048
OPEN = 64
#: A gap below this many ids is padded instead of filled with a fragment.
SMALLEST_CUT = 16
FAN_IN = 16
BATCH = 4096


class Packer:
    """Pieces are ``(doc_id, start, doc_tokens, ids)`` with ids as 32-bit bytes."""

    def __init__(self, first_id: int, window: int = WINDOW, places: int = OPEN):
        self.window, self.places, self.next_id = window, places, first_id
        self.gaps: list[tuple[int, int]] = []  # (free ids, sequence), ascending
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _close(self, sequence: int) -> None:
        at = 0
        for doc, start, total, ids in self.held.pop(sequence):
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, sequence, at, None))
            at += n

    def _put(self, gap: int, sequence: int, piece: tuple) -> None:
        self.held.setdefault(sequence, []).append(piece)
        left = gap - len(piece[3]) // 4
        if left:
            bisect.insort(self.gaps, (left, sequence))
        else:
            self._close(sequence)

    def add(self, doc, start: int, total: int, ids: bytes) -> None:
        size = 4 * self.window
        while len(ids) >= size:
            self._put(self.window, self._new(), (doc, start, total, ids[:size]))
            start, ids = start + self.window, ids[size:]
        while ids:
            n = len(ids) // 4
            fit = bisect.bisect_left(self.gaps, (n, -1))
            if fit < len(self.gaps):
                self._put(*self.gaps.pop(fit), (doc, start, total, ids))
                return
            if len(self.gaps) < self.places:
                self._put(self.window, self._new(), (doc, start, total, ids))
                return
            gap, sequence = self.gaps.pop(0)
            if gap < SMALLEST_CUT:
                self._close(sequence)
            else:
                self._put(gap, sequence, (doc, start, total, ids[: 4 * gap]))
                start, ids = start + gap, ids[4 * gap :]

    def leave(self) -> list[tuple]:
        """Finished pieces so far."""
        out, self.done = self.done, []
        return out

    def still_open(self) -> Iterator[tuple]:
        for sequence in sorted(self.held):
            at = 0
            for doc, start, total, ids in self.held[sequence]:
                yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, ids
                at += len(ids) // 4

    def lay_out(self) -> None:
        """Close everything: the open pieces are laid end to end and cut at windows."""
        pieces = [p for s in sorted(self.held) for p in self.held[s]]
        self.held, self.gaps = {}, []
        gap, sequence = self.window, self._new()
        for doc, start, total, ids in pieces:
            while ids:
                part = ids[: 4 * gap]
                self.held.setdefault(sequence, []).append((doc, start, total, part))
                gap, start, ids = gap - len(part) // 4, start + len(part) // 4, ids[4 * gap :]
                if not gap:
                    self._close(sequence)
                    gap, sequence = self.window, self._new()
        if sequence in self.held:
            self._close(sequence)


def _schema(kind: str) -> str:
    return (
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, ids binary"
    )


TYPES = (pa.int64(),) * 6 + (pa.binary(),)
NAMES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def _batches(rows, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for at in range(0, len(rows), BATCH):
        doc, *rest = zip(*rows[at : at + BATCH])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, kind), *[pa.array(c, t) for c, t in zip(rest, TYPES)]], names=["doc_id", *NAMES]
        )


def _first_id(level: int) -> int:
    """Sequence ids of a task: 31 bits of its own below its level and partition."""
    return ((level << 26) + TaskContext.get().partitionId()) << 31


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, places: int = OPEN, remember: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Workers remember pieces of words from task to task; without ``remember`` a task gives
    that memory back, for jobs in which other stages need it.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary or vocabulary_path(VOCABULARY), END_ID, spaces_kept=True)
        packer, arrow = Packer(_first_id(0), window, places), None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode_all(batch.column(1).to_pylist())):
                packer.add(doc, 0, len(ids) // 4, ids)
            yield from _batches(packer.leave(), arrow)
        if arrow is not None:
            yield from _batches(packer.still_open(), arrow)
        if not remember:
            tokens.forget()

    written = stored(docs.select("doc_id", "text").mapInArrow(online, _schema(kind)), "packing")
    parts = written.where("ids is null")
    rest, level, before = written.where("ids is not null"), 1, None
    while True:
        n = rest.agg(F.countDistinct("sequence_id")).first()[0]
        # A group ends with its pieces laid end to end once it is the only one, or when
        # the last round has not even halved the open windows.
        last = n <= places * FAN_IN or (before is not None and 2 * n > before)
        before = n
        rest = stored(_again(rest, -(-n // (places * FAN_IN)) or 1, level, last, kind, window, places), "packing")
        parts = parts.unionByName(rest.where("ids is null"))
        if last:
            return parts.drop("ids")
        rest, level = rest.where("ids is not null"), level + 1


def _again(rest: DataFrame, groups: int, level: int, last: bool, kind: str, window: int, places: int) -> DataFrame:
    """Pack the pieces of open windows once more, one group of windows after the other.

    The group is a column, so how far a round shrinks does not depend on how many
    partitions Spark makes of the groups.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group, arrow = None, None, None
        for batch in batches:
            arrow = batch.schema.field(1).type
            for here, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if packer is None or here != group:
                    if packer is not None:
                        yield from _batches(end(packer), arrow)
                    packer = Packer(_first_id(level) if packer is None else packer.next_id, window, places)
                    group = here
                packer.add(*row)
            if packer is not None:
                yield from _batches(packer.leave(), arrow)
        if packer is not None:
            yield from _batches(end(packer), arrow)

    def end(packer: Packer) -> list[tuple]:
        if last:
            packer.lay_out()
        return [*packer.leave(), *packer.still_open()]

    group = F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("group")
    slim = rest.select(group, "doc_id", "start", "doc_tokens", "ids")
    dealt = slim.repartition("group").sortWithinPartitions("group", F.desc(F.length("ids")), "doc_id", "start")
    return dealt.mapInArrow(merge, _schema(kind))
