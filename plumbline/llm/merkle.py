"""Merkle manifest of a dataset with tamper versions by path copying.

Rows are leaves, one tree per group in the order of an id; while several nodes remain,
every three neighbours become the digest of their concatenated digests. The roots of the
groups are the leaves of one more tree.

A tree is never in one task. Aligned blocks of ``BLOCK`` leaves are folded by one task
each; the block roots are the leaves of the next stage, until a stage has one block. On
the way back every block receives the path of its own root: the digests next to it on each
level up to the root of all groups. Blocks are immutable. Changing a leaf makes a version
of the tree: the ancestors inside the block are copied, all other nodes are shared, and
the version goes on over the levels above through the path that the block received, so
the versions of one group are spread over its blocks and no upper node is a hot spot.

Edge cases: a null field is hashed as ``-`` and so differs from an empty one; rows without
group are a group of their own, the first; rows with a null id come first in their group;
rows of one id are ordered by their digests; a lone leaf is the root of its group, and a
lone group's root is the root of all; an empty table gives no rows; columns that are not
named as fields are ignored, and only the id is returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .numbering import numbered

FANOUT = 3
BLOCK_LEVELS = 7
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


# -- leaves -------------------------------------------------------------------------------


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of typed-free, length-prefixed fields, as 32 bytes."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]), 256))


def leaves(docs: DataFrame, fields: Sequence[str], group: str, order: str, edits: dict[str, Column], edited: Column) -> DataFrame:
    """``group, id, leaf, changed``; ``changed`` is the digest after the edits, NULL if the same."""
    plain = [F.col(f"`{f}`") for f in fields]
    after = [edits.get(f, c) for f, c in zip(fields, plain)]
    differs = reduce(lambda a, b: a | b, [~e.eqNullSafe(F.col(f"`{f}`")) for f, e in edits.items()], F.lit(False))
    return docs.select(
        F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("id"), leaf(plain).alias("leaf"),
        F.when(F.coalesce(edited, F.lit(False)) & differs, leaf(after)).alias("changed"),
    )


# -- trees --------------------------------------------------------------------------------


def parent(run: Sequence[bytes]) -> bytes:
    return sha256(b"".join(run)).hexdigest().encode()


class Tree:
    """The levels of one block, as lowercase hex; never changed once made."""

    def __init__(self, nodes: Sequence[bytes], n_levels: int):
        self.levels = [tuple(nodes)]
        for _ in range(n_levels):
            low = self.levels[-1]
            self.levels.append(tuple(parent(low[i:i + FANOUT]) for i in range(0, len(low), FANOUT)))

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, i: int) -> list[tuple[int, tuple[bytes, ...]]]:
        """Per level: place in the run, and the others of the run."""
        out = []
        for level in self.levels[:-1]:
            first = i - i % FANOUT
            run = level[first:first + FANOUT]
            out.append((i - first, run[:i - first] + run[i - first + 1:]))
            i //= FANOUT
        return out


def version(node: bytes, path: Sequence[tuple[int, tuple[bytes, ...]]]) -> list[bytes]:
    """The copied ancestors of a new node, lowest first; what is beside the path is shared."""
    out = []
    for at, others in path:
        node = parent((*others[:at], node, *others[at:]))
        out.append(node)
    return out


def levels_in_block(size: int) -> int:
    """All levels of a tree that fits in a block, otherwise those of a whole block."""
    n, levels = min(size, BLOCK), 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return BLOCK_LEVELS if size > BLOCK else levels


def pack_path(path: Sequence[tuple[int, tuple[bytes, ...]]]) -> bytes:
    return b"".join(bytes([at, len(o)]) + b"".join(bytes.fromhex(h.decode()) for h in o) for at, o in path)


def unpack_path(data: bytes) -> list[tuple[int, tuple[bytes, ...]]]:
    out, i = [], 0
    while i < len(data):
        at, n = data[i], data[i + 1]
        ends = range(i + 2, i + 2 + n * DIGEST, DIGEST)
        out.append((at, tuple(data[j:j + DIGEST].hex().encode() for j in ends)))
        i += 2 + n * DIGEST
    return out


# -- blocks in tasks ----------------------------------------------------------------------


def _join(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def whole_blocks(batches: Iterator[pa.RecordBatch], is_first) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The sorted rows again, cut so that blocks are whole; with the bounds of the blocks."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else _join([held, batch])
        starts = np.flatnonzero(is_first(rows))
        cut = int(starts[-1])
        if cut:
            yield rows.slice(0, cut), starts
        held = rows.slice(cut)
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _hex(column: pa.Array) -> list[bytes | None]:
    return [None if v is None else v.hex().encode() for v in column.to_pylist()]


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _in_blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "_place")


def _block() -> Column:
    return F.floor(F.col("_place") / F.lit(BLOCK)).cast("bigint").alias("_block")


def block_roots(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _place, _size, digest`` of the next stage: one node per block."""
    kinds = dict(nodes.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_blocks(batches, lambda r: _numbers(r, "_place") % BLOCK == 0):
            digests = _hex(rows.column(rows.num_columns - 1))
            starts = bounds[:-1]
            place, size = _numbers(rows, "_place")[starts], _numbers(rows, "_size")[starts]
            roots = [
                bytes.fromhex(Tree(digests[a:b], levels_in_block(int(n))).root.decode())
                for a, b, n in zip(starts, bounds[1:], size)
            ]
            firsts = rows.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays(
                [*[firsts.column(i) for i in range(len(keys))], pa.array(place // BLOCK), pa.array(-(-size // BLOCK)), pa.array(roots, pa.binary())],
                names=[*keys, "_place", "_size", "digest"],
            )

    rows = _in_blocks(nodes.select(*keys, _block(), "_place", "_size", "digest"), keys)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "_place bigint, _size bigint, digest binary"
    return rows.mapInArrow(fold, schema)


def climb(nodes: DataFrame, keys: Sequence[str], label: str) -> tuple[list[DataFrame], DataFrame]:
    """All stages, and ``keys, stage, digest`` of the tree roots with the stage that made them."""
    largest = nodes.agg(F.max("_size")).first()[0] or 0
    stages, tops = [nodes], []
    while True:
        up = stored(block_roots(stages[-1], keys), f"{label}-{len(stages)}")
        done = up.where("_size = 1").select(*keys, F.lit(len(stages) - 1).alias("stage"), "digest")
        tops.append(done)
        if largest <= BLOCK:
            return stages, reduce(DataFrame.unionByName, tops)
        stages.append(up.where("_size > 1"))
        largest = -(-largest // BLOCK)


def _with_headers(nodes: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes with one row before each block that brings the path of the block's root."""
    first = headers.select(*keys, F.col("_place").alias("_block"), F.lit(-1).cast("bigint").alias("_place"), "path", "top")
    both = nodes.withColumn("_block", _block()).unionByName(first, allowMissingColumns=True)
    return _in_blocks(both, keys)


def descend(nodes: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _place, path, top`` of every node of a stage; it heads a block of the stage below.

    ``headers`` are such rows of the stage above. ``top`` is the root of the node's tree.
    """
    kinds = dict(nodes.dtypes)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_blocks(batches, lambda r: _numbers(r, "_place") < 0):
            k = len(keys)
            place, digests = _numbers(rows, "_place"), _hex(rows.column(k + 2))
            above, tops = rows.column(k + 3).to_pylist(), rows.column(k + 4).to_pylist()
            path, top = [b""] * rows.num_rows, [b""] * rows.num_rows
            for a, b in zip(bounds[:-1], bounds[1:]):
                size = _numbers(rows, "_size")[a + 1:a + 2]
                tree = Tree(digests[a + 1:b], levels_in_block(int(size[0]))) if len(size) else None
                for i in range(a + 1, b):
                    path[i] = pack_path(tree.path(i - a - 1)) + above[a]
                    top[i] = tops[a]
            out = pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in range(k)], pa.array(place), pa.array(path, pa.binary()), pa.array(top, pa.binary())],
                names=[*keys, "_place", "path", "top"],
            )
            yield out.filter(pa.array(place >= 0))

    rows = _with_headers(nodes.select(*keys, "_place", "_size", "digest"), headers, keys)
    rows = rows.select(*keys, "_place", "_size", "digest", "path", "top")
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "_place bigint, path binary, top binary"
    return rows.mapInArrow(paths, schema)


# -- manifest -----------------------------------------------------------------------------


def manifest(rows: DataFrame) -> DataFrame:
    """Manifest and versions of ``group, id, leaf, changed``.

    Returns ``id, leaf, subroot, root, proof, folded_root, copied``: digests as bytes;
    ``proof`` is the digest of the siblings' hex text from leaf to root, ``folded_root``
    the root recomputed from the changed leaf (else the leaf) and those siblings, and
    ``copied`` the number of nodes that the row's version does not share.
    """
    kind = dict(rows.dtypes)["id"]
    nodes = numbered(stored(rows, "merkle-leaves"), ["group"], ["id", "leaf"], "merkle-order")
    nodes = stored(nodes.withColumnRenamed("leaf", "digest"), "merkle-nodes")
    stages, tops = climb(nodes.drop("id", "changed"), ["group"], "merkle-stage")
    upper = stored(numbered(stored(tops, "merkle-tops"), [], ["group"], "merkle-groups"), "merkle-upper")
    root_stages, roots = climb(upper, [], "merkle-root")
    found = roots.select("digest").take(1)
    if not found:
        return rows.select("id", "leaf", *[F.lit(None).cast("binary").alias(c) for c in ("subroot", "root", "proof", "folded_root")], F.lit(0).alias("copied"))
    root = bytes(found[0]["digest"])

    # From the root of all groups down to the roots of the groups.
    spark = rows.sparkSession
    above = spark.createDataFrame([(0, b"", root)], "_place bigint, path binary, top binary")
    for stage in reversed(root_stages):
        above = stored(descend(stage, above, []), "merkle-down")
    group_paths = upper.join(above.select("_place", "path"), "_place").select(
        "group", "stage", F.lit(0).cast("bigint").alias("_place"), "path", F.col("digest").alias("top")
    )
    group_paths = stored(group_paths, "merkle-group-paths")

    # Down each group; a group enters at the stage where it has one block.
    headers = None
    for number in range(len(stages) - 1, -1, -1):
        entering = group_paths.where(F.col("stage") == number).drop("stage")
        headers = entering if headers is None else headers.unionByName(entering)
        if number:
            headers = stored(descend(stages[number], headers, ["group"]), "merkle-down")
    return _versions(nodes, headers, root, kind)


def _versions(nodes: DataFrame, headers: DataFrame, root: bytes, kind: str) -> DataFrame:
    """The last step down: every leaf with its proof and the root of its version."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_blocks(batches, lambda r: _numbers(r, "_place") < 0):
            place, size = _numbers(rows, "_place"), _numbers(rows, "_size")
            digests, changed = _hex(rows.column(3)), _hex(rows.column(4))
            above, tops = rows.column(5).to_pylist(), rows.column(6).to_pylist()
            out = {c: [] for c in ("subroot", "proof", "folded_root", "copied")}
            for a, b in zip(bounds[:-1], bounds[1:]):
                if b - a < 2:
                    continue
                tree = Tree(digests[a + 1:b], levels_in_block(int(size[a + 1])))
                upper = unpack_path(above[a])
                rest = b"".join(h for _, others in upper for h in others)
                for i in range(a + 1, b):
                    path = tree.path(i - a - 1)
                    copies = version(changed[i] or digests[i], path + upper)
                    beside = b"".join([h for _, others in path for h in others])
                    out["subroot"].append(tops[a])
                    out["proof"].append(sha256(beside + rest).digest())
                    out["folded_root"].append(bytes.fromhex((copies[-1] if copies else changed[i] or digests[i]).decode()))
                    out["copied"].append(len(copies) + 1 if changed[i] else 0)
            keep = rows.filter(pa.array(place >= 0))
            yield pa.RecordBatch.from_arrays(
                [keep.column(2), keep.column(3), *[pa.array(out[c], pa.binary()) for c in ("subroot", "proof", "folded_root")], pa.array(out["copied"], pa.int32())],
                names=["id", "leaf", "subroot", "proof", "folded_root", "copied"],
            )

    rows = _with_headers(nodes.select("group", "_place", "_size", "id", "digest", "changed"), headers, ["group"])
    rows = rows.select("_place", "_size", "id", "digest", "changed", "path", "top")
    schema = f"id {kind}, leaf binary, subroot binary, proof binary, folded_root binary, copied int"
    return rows.mapInArrow(prove, schema).withColumn("root", F.lit(root))


def tampered(id_column: str = "doc_id") -> Column:
    """Half of the ids, by their checksum; never a null id."""
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % 2 == 0


def report(docs: DataFrame) -> DataFrame:
    """Manifest of documents per source, against versions whose texts lost their line feeds."""
    edits = {"text": F.translate("text", "\n", "")}
    rows = manifest(leaves(docs, FIELDS, "source", "doc_id", edits, tampered("doc_id")))
    text = lambda c: F.lower(F.hex(c))
    return rows.select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text("proof").alias("proof_sha256"), text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
