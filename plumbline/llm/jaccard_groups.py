"""Exact n-gram Jaccard self join with a token-group matrix, reduced to components.

A document is its set of distinct word shingles, kept as 64-bit hashes. Equal sets are
one document from the first pass on. For a threshold of t percent, two sets can only
link if they share one of the ``n - ceil(t n / 100) + 1`` first tokens of each under
any common order; the order here puts frequent tokens last (a frequency sketch of
fixed size ranks them), so the shared first tokens are rare. If the first token that
two sets share is at place ``i`` of one, they share at most ``n - i``; its ``reach`` is
the size of the largest set that it could still link with.

1. Leaders: every bucket of a shared token has a most central document, and each
   document is compared with the most central of those it meets. That links groups of
   copies by stars, not by pairs.
2. Groups: the components so far are cut into groups of about ``GROUP`` similar
   documents. The token-group matrix holds the tokens of each group; a document meets
   the groups of other components with which it shares a first token, the larger
   component being opened. A bit map of the tokens of each document, four bits or more
   a token, and their union for each group bound the overlap; a document meets the
   members, one per row, only of groups whose union leaves room for a link, and token
   sets are moved only of pairs whose own maps leave room for one.

Each pair of documents that could link is in one component after step 1 or met in
step 2, and no map says that a common token is absent, so no link between components
is lost. Tokens of candidates are derived from
their texts again instead of being stored for all documents; a bit map of fixed size
says which rows may be candidates.

Edge cases: null or empty texts have no shingle and link with nothing; a text with
fewer words than a shingle is one shingle of all its words; equal texts are one class;
every row of one id keeps its own set and is a node of its own content, and what links
with one row of an id is linked with the id; other columns are ignored; an empty table
gives none. Ids are whole numbers; a null id has no place in a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vectors as V
from .common import bit_map, components, in_map, placed, stored

WORDS = 4
PERCENT = 85
GROUP = 64
#: Bits of a map for each token.
MAP_ROOM = 4
SKETCH_BITS = 18
U64 = np.uint64


def shingle_sets(block: V.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block with their owners, ordered by owner and hash."""
    data = V.LOWER[block.data]
    starts, ends = V.runs(V.NOT_SPACE[data], block.offsets)
    owner = block.owner(starts)
    words = V.span_hash(V.prefix_hash(data), starts, ends)
    shingles = V.shingle_hash(words, k)
    inside = np.flatnonzero(owner[: len(shingles)] == owner[k - 1 :]) if len(shingles) else np.zeros(0, np.int64)
    tokens, owners = [shingles[inside]], [owner[inside]]
    first = np.searchsorted(owner, np.arange(block.n + 1))
    for doc in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k)):
        own = words[first[doc] : first[doc + 1]]
        tokens.append(V.mix(V.shingle_hash(own, len(own)) + U64(len(own))))
        owners.append(np.array([doc]))
    token, owner = np.concatenate(tokens), np.concatenate(owners)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    fresh = np.ones(len(token), dtype=bool)
    fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return token[fresh], owner[fresh]


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, s1, s2`` per document, and frequency sketches of the tasks."""
    kind = dict(docs.dtypes)["doc_id"]

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids = np.zeros(1 << SKETCH_BITS, dtype=np.int64), None
        for batch in batches:
            ids = batch.schema.field(0).type
            for block in V.blocks(batch.column(1)):
                token, owner = shingle_sets(block, k)
                counts += np.bincount((token >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                edge = np.searchsorted(owner, np.arange(block.n + 1))
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(x)]) for x in (token, V.mix(token + U64(99)))]
                s1, s2 = ((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)
                yield V.output({
                    "doc_id": (batch.column(0).slice(block.lo, block.n), None), "n": (np.diff(edge), pa.int64()),
                    "s1": (s1, pa.int64()), "s2": (s2, pa.int64()), "sketch": (pa.nulls(block.n, pa.binary()), None),
                })
        if ids is not None:
            yield V.output({
                "doc_id": (pa.nulls(1, ids), None), "n": ([None], pa.int64()), "s1": ([None], pa.int64()),
                "s2": ([None], pa.int64()), "sketch": ([counts.tobytes()], pa.binary()),
            })

    return stored(
        docs.select("doc_id", "text").mapInArrow(profile, f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, sketch binary"),
        "jaccard-profiles",
    )


def _levels(profiles: DataFrame) -> np.ndarray:
    """Logarithm of the number of documents per sketch bucket, of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0):
                counts = np.frombuffer(part.as_py(), np.int64)
                total = counts.copy() if total is None else total + counts
        if total is not None:
            yield V.output({"sketch": ([total.tobytes()], pa.binary())})

    parts = profiles.where("sketch is not null").select("sketch")
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for row in parts.mapInArrow(add, "sketch binary").toLocalIterator():
        total += np.frombuffer(row[0], np.int64)
    return np.log2(total + 1).astype(np.uint8)


def _first_tokens(docs: DataFrame, ids: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """``rid, n, token, reach`` for the first tokens of each document in ``ids``, rare ones first.

    Sets of ``n`` and ``m`` tokens need ``percent * (n + m) / (100 + percent)`` in common,
    so a token at place ``i`` is the first shared one of a link only if ``reach``, which is
    ``100 * n - (100 + percent) * i``, is ``percent * m`` or more.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((bit_map(ids), levels))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, levels = shared.value
        for batch in batches:
            batch = in_map(batch, bits)
            for block in V.blocks(batch.column(1)):
                token, owner = shingle_sets(block, k)
                level = levels[(token >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((token, level, owner))
                n = np.bincount(owner, minlength=block.n)
                take = n - -(-percent * n // 100) + 1
                rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                chosen = rank < take[owner]
                at = owner[chosen]
                yield V.output({
                    "rid": (batch.column(0).take(pa.array(at + block.lo)), None), "n": (n[at], pa.int32()),
                    "token": (token[order][chosen].view(np.int64), pa.int64()),
                    "reach": (100 * n[at] - (100 + percent) * rank[chosen], pa.int64()),
                })

    return placed(docs).mapInArrow(first, f"rid {kind}, n int, token bigint, reach bigint")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``rid, tokens`` (sorted hashes as bytes) of the documents in ``ids``."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids))

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = in_map(batch, shared.value)
            for block in V.blocks(batch.column(1)):
                token, owner = shingle_sets(block, k)
                edge = np.searchsorted(owner, np.arange(block.n + 1))
                yield V.output({
                    "rid": (batch.column(0).slice(block.lo, block.n), None),
                    "tokens": ([token[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
                })

    return placed(docs).mapInArrow(derive, f"rid {kind}, tokens binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))


def _maps(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``rid, n, bits`` of the documents in ``ids``: a bit map of the tokens, of ``MAP_ROOM`` bits or more for each.

    Its length is a power of two and a token's place are its low bits, so a longer map
    is folded to a shorter one by putting its stretches together.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(ids))

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = in_map(batch, shared.value)
            for block in V.blocks(batch.column(1)):
                token, owner = shingle_sets(block, k)
                edge = np.searchsorted(owner, np.arange(block.n + 1))
                yield V.output({
                    "rid": (batch.column(0).slice(block.lo, block.n), None), "n": (np.diff(edge), pa.int32()),
                    "bits": ([_map(token[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary()),
                })

    return placed(docs).mapInArrow(derive, f"rid {kind}, n int, bits binary")


def _map(token: np.ndarray) -> bytes:
    flags = np.zeros(max(64, 1 << (MAP_ROOM * len(token) - 1).bit_length()) if len(token) else 64, dtype=bool)
    flags[(token & U64(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def _absent(a: bytes, b: bytes) -> tuple[int, int]:
    """How many tokens of each of two maps the other surely lacks, or more."""
    size = min(len(a), len(b))
    a, b = _folded(a, size), _folded(b, size)
    return int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())


def _unions(groups: DataFrame, maps: DataFrame) -> DataFrame:
    """``gid, n, bits``: the map of all tokens of each group, at most ``GROUP`` sets, as long as its shortest."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column(2):
                members = members.as_py()
                size = min(map(len, members))
                found.append(np.bitwise_or.reduce([_folded(m, size) for m in members], axis=0).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["gid", "n", "bits"])

    kind = dict(groups.dtypes)["gid"]
    members = groups.join(maps, "rid").groupBy("gid").agg(F.max("n").alias("n"), F.collect_list("bits").alias("bits"))
    return members.mapInArrow(unite, f"gid {kind}, n int, bits binary")


def _possible(rows: DataFrame, keep: str, enough) -> DataFrame:
    """``rid`` and ``keep`` of the rows ``rid, keep, own_n, own, n, bits`` whose maps leave room for ``enough``.

    No map counts a token as absent that is there, so nothing is lost; what passes by
    chance is left to the exact comparison.
    """
    kinds = dict(rows.dtypes)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_n, n = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            flags = [
                enough(x, y, *_absent(own.as_py(), other.as_py()))
                for x, own, y, other in zip(own_n, batch.column(3), n, batch.column(5))
            ]
            yield batch.select(["rid", keep]).filter(pa.array(flags, pa.bool_()))

    rows = rows.select("rid", keep, "own_n", "own", "n", "bits")
    return rows.mapInArrow(test, f"rid {kinds['rid']}, {keep} {kinds[keep]}")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``rid, other`` pairs that are similar enough, as ``a, b``."""
    own = sets.withColumnRenamed("tokens", "own")
    member = sets.withColumnRenamed("rid", "other")
    rows = pairs.join(own, "rid").join(member, "other")
    kinds = dict(rows.dtypes)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for own, other in zip(batch.column(2), batch.column(3)):
                own, other = np.frombuffer(own.as_py(), U64), np.frombuffer(other.as_py(), U64)
                common = _overlap(own, other)
                flags.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["rid", "other"]).filter(pa.array(flags, pa.bool_()))

    linked = rows.select("rid", "other", "own", "tokens").mapInArrow(test, f"rid {kinds['rid']}, other {kinds['other']}")
    return stored(linked.toDF("a", "b"), "jaccard-links")


def _pairs(meets: DataFrame, groups: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """``rid, other``: the documents ``meets(rid, gid)`` with members of the groups ``(gid, rid)`` they may link with.

    A document is held against the map of a group first, then against those of members.
    """
    own = maps.select("rid", F.col("n").alias("own_n"), F.col("bits").alias("own"))
    bounded = meets.join(own, "rid").join(_unions(groups, maps), "gid")
    passing = stored(_possible(bounded, "gid", lambda n, _, gone, __: 100 * (n - gone) >= percent * n), "jaccard-passing")

    def near(n: int, m: int, gone: int, back: int) -> bool:
        common = min(n - gone, m - back)
        return 100 * common >= percent * (n + m - common)

    met = passing.join(groups.withColumnRenamed("rid", "other"), "gid").select("rid", "other")
    rows = met.join(own, "rid").join(maps.withColumnRenamed("rid", "other"), "other")
    return _possible(rows, "other", near).distinct()


def _open_groups(meets: DataFrame, groups: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a, b`` of the documents ``meets(rid, gid)`` with members of the groups ``(gid, rid)``.

    Bit maps of tokens, an eighth of their size at most, say which two may link; only the
    sets of these are made and moved.
    """
    wanted = meets.select("rid").unionByName(groups.select("rid")).distinct()
    maps = stored(_maps(docs, wanted, k), "jaccard-maps")
    pairs = stored(_pairs(meets, groups, maps, percent), "jaccard-pairs")
    ends = pairs.select("rid").unionByName(pairs.select(F.col("other").alias("rid"))).distinct()
    return _links(pairs, _sets(docs, ends, k), percent)


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    docs = docs.select("doc_id", "text")
    profiles = _profiles(docs, k)
    levels = _levels(profiles)
    slim = profiles.where("sketch is null").select("doc_id", "n", "s1", "s2")
    classes = stored(slim.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rid")), "jaccard-classes")

    # Tokens are made and shuffled once: the count stands beside them in the same partition.
    first = _first_tokens(docs, classes.select("rid"), k, percent, levels)
    df = F.count(F.lit(1)).over(W.partitionBy("token"))
    shared = stored(first.withColumn("df", df).where("df > 1"), "jaccard-shared")

    score = shared.groupBy("rid").agg(F.sum("df").alias("score"))
    leader = (
        shared.join(score, "rid").groupBy("token")
        .agg(F.max_by(F.struct("rid", "n", "score", "reach"), F.struct("score", (-F.col("rid")).alias("r"))).alias("lead"))
        .select("token", F.col("lead.rid").alias("gid"), F.col("lead.n").alias("lead_n"), F.col("lead.score").alias("score"), F.col("lead.reach").alias("lead_reach"))
    )
    fits = (F.col("reach") >= percent * F.col("lead_n")) & (F.col("lead_reach") >= percent * F.col("n"))
    # One leader each, the most central that could link, so there are fewer pairs than documents.
    best = F.max_by("gid", F.struct("score", (-F.col("gid")).alias("r")))
    stars = stored(
        shared.join(leader, "token").where(fits).where("rid <> gid").groupBy("rid").agg(best.alias("gid")), "jaccard-stars"
    )
    # A star's group is its leader alone, whose set is the union.
    ends = stars.select("rid").unionByName(stars.select(F.col("gid").alias("rid"))).distinct()
    links = _links(stars.withColumnRenamed("gid", "other"), _sets(docs, ends, k), percent)

    part = components(links)
    known = stored(
        shared.select("rid", "n").distinct().join(part.withColumnRenamed("node", "rid"), "rid", "left")
        .select("rid", "n", F.coalesce("component", "rid").alias("comp")),
        "jaccard-parts",
    )
    size = known.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    place = known.join(size, "comp").select(
        "rid", "comp", "size",
        F.struct("comp", F.pmod(F.xxhash64("rid"), F.ceil(F.col("size") / GROUP)).alias("chunk")).alias("gid"),
    )
    placed = shared.select("rid", "n", "token", "reach").join(place, "rid")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    open_tokens = stored(placed.join(mixed, "token"), "jaccard-open")
    matrix = open_tokens.groupBy("token", "gid", F.struct("size", "comp").alias("weight")).agg(
        F.min("n").alias("n_lo"), F.max("reach").alias("farthest")
    )
    queries = open_tokens.select("token", "rid", "n", "reach", F.struct("size", "comp").alias("own"))
    meets = (
        queries.join(matrix, "token").where("own < weight")
        .where(f"reach >= {percent} * n_lo and farthest >= {percent} * n")
        .select("rid", "gid").distinct()
    )
    meets = stored(meets, "jaccard-meets")
    opened = place.select("gid", "rid").join(meets.select("gid").distinct(), "gid")
    more = _open_groups(meets, opened, docs, k, percent)

    whole = components(links.unionByName(more)).withColumnRenamed("node", "rid")
    named = classes.join(whole, "rid", "left").select("n", "s1", "s2", F.coalesce("component", "rid").alias("component_id"))
    return slim.join(named, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of every component."""
    found = near_duplicates(docs, k, percent)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi")
