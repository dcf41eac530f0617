"""Quality rules and a hashed n-gram classifier behind one verdict.

Exact counts per document decide the base rules. Documents that pass them are
judged by a logistic regression over hashed word 1- and 2-grams and 4-byte character
grams, fitted on a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` of each
class, chosen by hash) and calibrated on a part of the sample that the fit does not
see. Scoring walks Arrow batches with array operations over the whole text.

Edge cases: null and empty texts have no words and fail the base rules; repeated rows
are judged one by one; further columns are ignored; if a class has no labelled row
every document that passes the base rules is kept; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics as S
from . import vectors as V

SAMPLE_PER_CLASS = 3000
BITS = 15
WIDTH = 1 << BITS
CHAR_GRAM = 4
EPOCHS = 60
RATE = 0.3
L2 = 1e-5
CALIBRATION_SHARE = 5
THRESHOLD = 0.5
MIN_WORDS = 50


def _grams(block: V.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature index and owner of every gram: words and pairs first, then characters."""
    data = V.LOWER[block.data]
    starts, ends = V.runs(V.NOT_SPACE[data], block.offsets)
    owner = block.owner(starts)
    words = V.span_hash(V.prefix_hash(data), starts, ends)
    pairs = V.shingle_hash(words, 2)
    inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) > 1 else np.zeros(0, np.int64)
    top = np.uint64(64 - BITS)
    yield (np.concatenate([words, pairs[inside]]) >> top).astype(np.int64), np.concatenate([owner, owner[inside]])
    n = len(data) - CHAR_GRAM + 1
    if n > 0:
        gram = np.zeros(n, dtype=np.uint32)
        for i in range(CHAR_GRAM):
            gram = (gram << np.uint32(8)) | data[i : i + n]
        gram *= np.uint32(2654435761)
        gram >>= np.uint32(32 - BITS)
        at = np.repeat(np.arange(block.n), np.diff(block.offsets))[:n]
        whole = at == np.repeat(np.arange(block.n), np.diff(block.offsets))[CHAR_GRAM - 1 :]
        yield gram[whole].astype(np.int64) + WIDTH, at[whole]
    else:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)


def logits(block: V.Block, weights: np.ndarray) -> np.ndarray:
    """Bias plus the mean weight of a document's word grams and of its byte grams."""
    out = np.full(block.n, weights[-1])
    for index, owner in _grams(block):
        n = np.maximum(np.bincount(owner, minlength=block.n), 1)
        out += np.bincount(owner, weights=weights[index], minlength=block.n) / n
    return out


def _sparse(block: V.Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their shares, per document."""
    keys, shares = [], []
    for index, owner in _grams(block):
        both, count = np.unique(owner * (2 * WIDTH) + index, return_counts=True)
        total = np.maximum(np.bincount(owner, minlength=block.n), 1)
        keys.append(both)
        shares.append(count / total[both // (2 * WIDTH)])
    key, share = np.concatenate(keys), np.concatenate(shares)
    order = np.argsort(key, kind="stable")
    key, share = key[order], share[order]
    cut = np.searchsorted(key, np.arange(block.n + 1) * (2 * WIDTH))
    return [(key[a:b] % (2 * WIDTH), share[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weights, then bias; full-batch adaptive gradient steps over bounded rows."""
    lengths = np.array([len(r[0]) for r in rows])
    index = np.concatenate([r[0] for r in rows]).astype(np.int64)
    share = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias = np.zeros(2 * WIDTH), 0.0
    seen, seen_bias = np.full(2 * WIDTH, 1e-10), 1e-10
    for _ in range(EPOCHS):
        raw = np.bincount(owner, weights=share * w[index], minlength=len(rows)) + bias
        error = (1.0 / (1.0 + np.exp(-raw)) - y) * balance
        grad = np.bincount(index, weights=share * error[owner], minlength=2 * WIDTH) + L2 * w
        seen += grad * grad
        w -= RATE * grad / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(seen_bias)
    return np.append(w, bias)


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic regression with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    beta = np.array([1.0, 0.0])
    x = np.column_stack([raw, np.ones(len(raw))])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta -= np.clip(step, -2, 2)
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model from a bounded, hash-chosen sample of labelled rows; None without both classes."""
    order = F.xxhash64(F.lit(17), "doc_id")
    usable = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = [usable.where(F.col("quality") == k).orderBy(order).limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(0)):
                rows = _sparse(block)
                yield V.output({
                    "doc_id": (batch.column(1).slice(block.lo, block.n), None),
                    "quality": (batch.column(2).slice(block.lo, block.n), None),
                    "index": ([r[0].astype("<u4").tobytes() for r in rows], pa.binary()),
                    "share": ([r[1].astype("<f4").tobytes() for r in rows], pa.binary()),
                })

    kind = dict(docs.dtypes)["doc_id"]
    rows = sample.select("text", "doc_id", F.col("quality").cast("int")).mapInArrow(
        features, f"doc_id {kind}, quality int, index binary, share binary"
    )

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        pairs = [
            (np.frombuffer(i, "<u4"), np.frombuffer(s, "<f4").astype(np.float64))
            for i, s in zip(table["index"].to_pylist(), table["share"].to_pylist())
        ]
        y = table["quality"].to_numpy().astype(np.float64)
        held = np.arange(len(y)) % CALIBRATION_SHARE == 0
        if min(y.sum(), (1 - y).sum()) == 0:
            return pa.table({"weights": pa.array([], pa.binary()), "slope": pa.array([], pa.float64()), "intercept": pa.array([], pa.float64())})
        if min(y[held].sum(), (1 - y[held]).sum()) == 0 or min(y[~held].sum(), (1 - y[~held]).sum()) == 0:
            held = np.zeros(len(y), dtype=bool)
        w = _fit([p for p, h in zip(pairs, held) if not h], y[~held])
        part = held if held.any() else ~held
        raw = np.array([s @ w[i] + w[-1] for (i, s), h in zip(pairs, part) if h])
        slope, intercept = _calibrate(raw, y[part])
        return pa.table({"weights": [w.astype("<f8").tobytes()], "slope": [slope], "intercept": [intercept]})

    got = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(
        train, "weights binary, slope double, intercept double"
    ).collect()
    if not got:
        return None
    return {"weights": np.frombuffer(got[0]["weights"], "<f8"), "slope": got[0]["slope"], "intercept": got[0]["intercept"]}


def judge(docs: DataFrame, model: dict | None) -> DataFrame:
    """Counts, base rules, probability and verdict of every row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                c = S.base(block)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                if model is None:
                    p = np.ones(block.n)
                else:
                    raw = model["slope"] * logits(block, model["weights"]) + model["intercept"]
                    p = 1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30)))
                yield V.output(
                    {"doc_id": (batch.column(0).slice(block.lo, block.n), None)}
                    | {k: (c[k], pa.int64()) for k in counts}
                    | {"base_failed": (failed, pa.bool_()), "kept": (~failed & (p >= THRESHOLD), pa.bool_()), "probability": (p, pa.float64())}
                )

    schema = f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in counts) + ", base_failed boolean, kept boolean, probability double"
    return docs.select("doc_id", "text").mapInArrow(apply, schema)


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
