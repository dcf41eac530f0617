"""Removal of repeated byte strings by a distributed, prefix-aware suffix sort.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier, in a
document of smaller id or at a smaller position of the same one.

1. Windows of ``LENGTH`` bytes are gathered under content-chosen anchors. Anchors whose
   whole surroundings are equal are repeats of the first one, so long copies are found
   without sorting a single byte of them.
2. What is left are different surroundings with the same gram at their anchor, mostly
   the ends of repeated passages. Their suffixes at a few fixed distances from the
   anchor are sorted in each task, front-coded, exchanged by ranges of suffixes and
   merged with loser trees that know all shared prefixes. Neighbours in that order
   show which windows can be repeated at all.
3. Those windows meet by their hash; all but the first of equal ones are repeats.

Hot strings: equal surroundings and equal windows are combined before they are
shuffled, and what is left of a common string is spread over ranges by what follows.

Edge cases: null texts count as empty; texts under ``LENGTH`` bytes have no window; of
rows with equal ids and texts the whole group shares its marks, so equal ids must not
repeat if they are to be told apart; other columns are ignored; an empty table gives
an empty result. A cut may fall inside a character; digests are of the bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffix_merge as M
from . import vectors as V
from .common import bit_map, marked, stored
from .suffix_anchors import LENGTH, anchors

#: Distances before the anchor at which suffixes are sorted, and windows up to the next.
GRID = (0, 17, 34, 51)
REACH = (16, 16, 16, 17)
#: Id, suffix start, first and last step back, bytes before.
PAYLOAD = "<qiBB18s"
PAYLOAD_BYTES = struct.calcsize(PAYLOAD)
RUN_ROWS = 25_000
#: Text looked at together for anchors: an array of 8-byte numbers per byte, times fifteen.
ANCHOR_BYTES = 1 << 18
SUFFIXES_PER_RANGE = 100_000
SAMPLE_DOCUMENTS = 2000


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """``gram, region, doc_id, place``: place packs first window, anchor and last window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1), ANCHOR_BYTES):
                a = anchors(block)
                place = (a["lo"] << 16) | ((a["at"] - a["lo"]) << 8) | (a["hi"] - a["lo"])
                yield V.output({
                    "gram": (a["gram"].view(np.int64), pa.int64()), "region": (a["region"].view(np.int64), pa.int64()),
                    "doc_id": (batch.column(0).take(pa.array(a["owner"] + block.lo)), None), "place": (place, pa.int64()),
                })

    return docs.mapInArrow(find, "gram bigint, region bigint, doc_id bigint, place bigint")


def _classes(docs: DataFrame) -> DataFrame:
    """``kind, doc_id, place``: repeated surroundings (0) and first ones to compare (1).

    One shuffle and one pass in order; a task keeps the first row of the surroundings
    that it is in, and whether that row has left already.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if first is not None:
                rows = np.concatenate([first, rows], axis=1)
            gram, region, doc, place = rows
            change = (gram[1:] != gram[:-1]) | (region[1:] != region[:-1])
            heads = np.flatnonzero(np.append(True, change))
            own = np.repeat(heads, np.diff(np.append(heads, len(gram))))
            copies = np.flatnonzero((doc != doc[own]) | (place != place[own]))
            same = gram[heads[1:]] == gram[heads[:-1]]
            several = np.append(False, same) | np.append(same, False)
            leaving = several.copy()
            leaving[0] &= not told
            at = np.concatenate([copies, heads[leaving]])
            kind = np.repeat(np.array([0, 1], np.int32), [len(copies), len(at) - len(copies)])
            yield V.output({"kind": (kind, pa.int32()), "doc_id": (doc[at], pa.int64()), "place": (place[at], pa.int64())})
            told = bool(several[-1]) or (told and len(heads) == 1)
            first = rows[:, heads[-1] :][:, :1].copy()

    rows = _anchor_rows(docs).repartition("gram").sortWithinPartitions("gram", "region", "doc_id", "place")
    return stored(rows.mapInArrow(pick, "kind int, doc_id bigint, place bigint"), "suffix-classes")


def _suffixes(text: bytes, doc: int, places: list[int]) -> Iterator[tuple[bytes, bytes]]:
    """Suffixes on the grid of each anchor that stand for at least one window."""
    for place in places:
        lo = place >> 16
        at, hi = lo + ((place >> 8) & 255), lo + (place & 255)
        for back, reach in zip(GRID, REACH):
            start = at - back
            near, far = max(0, start - hi), min(reach, start - lo)
            if near <= far:
                yield text[start : start + LENGTH], struct.pack(PAYLOAD, doc, start, near, far, text[max(0, start - 18) : start].rjust(18, b"\0"))


def _splitters(docs: DataFrame, open_ones: DataFrame, ranges: int) -> list[bytes]:
    """Heads of suffixes that divide a bounded sample into equal ranges.

    They are as long as what the furthest window needs to share, so suffixes that can
    show a repeated window to each other are never on two sides of a cut.
    """
    ids = open_ones.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCUMENTS)
    sample = marked(docs, bit_map(ids)).join(F.broadcast(ids), "doc_id")
    some = open_ones.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("place")), 1, 64).alias("places"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                s for d, t, p in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for s, _ in _suffixes((t or "").encode(), d, p)
            ]
            yield V.output({"s": (found[::8], pa.binary())})

    got = sorted(bytes(r[0]) for r in sample.join(some, "doc_id").select("doc_id", "text", "places").mapInArrow(heads, "s binary").toLocalIterator())
    step = max(1, len(got) // ranges)
    return sorted({s[: LENGTH - max(REACH)] for s in got[step::step]})


def _runs(candidates: DataFrame, splitters: list[bytes]) -> DataFrame:
    """``part, run``: front-coded sorted runs of each task, cut at the splitters."""
    shared = candidates.sparkSession.sparkContext.broadcast(splitters)

    def flush(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        rows.sort()
        keys = [r[0] for r in rows]
        parts, runs, at = [], [], 0
        for part, splitter in enumerate([*shared.value, None]):
            stop = len(rows) if splitter is None else bisect.bisect_left(keys, splitter, lo=at)
            if stop > at:
                parts.append(part)
                runs.append(M.encode(rows[at:stop]))
            at = stop
        return V.output({"part": (parts, pa.int32()), "run": (runs, pa.binary())})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for doc, text, places in zip(*batch.columns):
                rows += _suffixes((text.as_py() or "").encode(), doc.as_py(), places.as_py())
                if len(rows) >= RUN_ROWS:
                    yield flush(rows)
                    rows = []
        if rows:
            yield flush(rows)

    return candidates.select("doc_id", "text", "places").mapInArrow(sort, "part int, run binary")


def _windows(suffix: bytes, payload: bytes, most: int) -> Iterator[tuple[bytes, int, int]]:
    """Windows of a suffix that share enough with a neighbour: bytes, id, start."""
    doc, start, near, far, before = struct.unpack(PAYLOAD, payload)
    for back in range(max(near, LENGTH - most), far + 1):
        window = before[18 - back :] + suffix[: LENGTH - back] if back else suffix
        if len(window) == LENGTH:
            yield window, doc, start - back


def _merge(runs: DataFrame) -> DataFrame:
    """``key1, key2, doc_id, at`` of every window whose suffix has a close neighbour."""

    def out(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w, _, _ in rows), "<i8").reshape(-1, 2)
        return V.output({
            "key1": (keys[:, 0], pa.int64()), "key2": (keys[:, 1], pa.int64()),
            "doc_id": ([r[1] for r in rows], pa.int64()), "at": ([r[2] for r in rows], pa.int32()),
        })

    def merged(part: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, int]] = []
        held = None
        for same, suffix, payload in M.LoserTree([M.decode(r, PAYLOAD_BYTES) for r in part]):
            if held is not None:
                rows += _windows(held[1], held[2], max(held[0], same))
            held = (same, suffix, payload)
            if len(rows) >= RUN_ROWS:
                yield out(rows)
                rows = []
        if held is not None:
            rows += _windows(held[1], held[2], held[0])
        if rows:
            yield out(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for part, run in zip(*batch.columns):
                if part.as_py() != here:
                    if held:
                        yield from merged(held)
                    here, held = part.as_py(), []
                held.append(run.as_py())
        if held:
            yield from merged(held)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(
        merge, "key1 bigint, key2 bigint, doc_id bigint, at int"
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, lo, hi``: byte spans to remove; they may touch and overlap."""
    docs = docs.where("doc_id is not null")
    classes = _classes(docs)
    copies = classes.where("kind = 0").selectExpr(
        "doc_id", "shiftright(place, 16) AS lo", f"shiftright(place, 16) + (place & 255) + {LENGTH} AS hi"
    )
    open_ones = classes.where("kind = 1")
    count = open_ones.count()
    lists = open_ones.groupBy("doc_id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    candidates = marked(docs, bit_map(open_ones.select("doc_id"))).join(lists, "doc_id")
    splitters = _splitters(docs, open_ones, max(1, count * len(GRID) // SUFFIXES_PER_RANGE))
    windows = stored(_merge(_runs(candidates, splitters)), "suffix-windows")
    first = windows.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    later = windows.join(first, ["key1", "key2"]).where("struct(doc_id, at) > first").selectExpr(
        "doc_id", "CAST(at AS BIGINT) AS lo", f"CAST(at AS BIGINT) + {LENGTH} AS hi"
    )
    return copies.unionByName(later)


def merged_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: sorted, disjoint spans packed as ``[lo, hi, ...]``."""
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("s"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi in zip(batch.column(1), batch.column(2)):
                lo, hi = (x.values.to_numpy() for x in (lo, hi))
                top = np.maximum.accumulate(hi)
                fresh = np.flatnonzero(np.append(True, lo[1:] > top[:-1]))
                ends = top[np.append(fresh[1:] - 1, len(lo) - 1)]
                found.append(np.stack([lo[fresh], ends], axis=1).ravel().tolist())
            yield V.output({"doc_id": (batch.column(0), None), "spans": (found, pa.list_(pa.int64()))})

    return stored(
        spans.select("doc_id", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
        .mapInArrow(join, "doc_id bigint, spans array<bigint>"),
        "suffix-spans",
    )


def cut(text: bytes, spans: list[int]) -> bytes:
    """The bytes that no span covers."""
    edges = [0, *spans, len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def dedup(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (bytes)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spans = merged_spans(docs)
    bits = bit_map(spans.select("doc_id"))
    touched = marked(docs, bits).join(spans, "doc_id", "left")
    clean = marked(docs.where("doc_id is not null"), bits, present=False).withColumn("spans", F.lit(None).cast("array<bigint>"))
    unknown = docs.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<bigint>"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2)):
                raw, found = (text.as_py() or "").encode(), found.as_py() or []
                kept = cut(raw, found)
                rows.append((len(raw), len(raw) - len(kept), len(found) // 2, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [()] * 5
            yield V.output({
                "doc_id": (batch.column(0), None), "n_bytes": (cols[0], pa.int64()), "n_removed": (cols[1], pa.int64()),
                "n_spans": (cols[2], pa.int64()), "kept_sha256": (cols[3], pa.string()), "kept": (cols[4], pa.binary()),
            })

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    both = touched.select("doc_id", "text", "spans").unionByName(clean.unionByName(unknown))
    return both.mapInArrow(apply, schema)


def report(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`dedup`."""
    return dedup(docs).drop("kept")
