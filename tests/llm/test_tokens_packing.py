"""Token ids against the library's own over every letter, and packing in few and many partitions."""

import os
import random
import sys
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from plumbline.llm import jaccard_groups, packing, suffix_dedup, tokens  # noqa: E402

VOCABULARIES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]


def library_ids(encoder, text):
    return [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name, spaces", VOCABULARIES)
def test_every_letter_has_the_ids_of_the_library(name, spaces):
    encoder = tokens.Encoder(tokens.vocabulary_path(name), 1, spaces)
    letters = [chr(c) for c in range(1, 0x600) if not 0xD800 <= c < 0xE000]
    texts = [f"x {c}stanbul a{c}b {c} {c}." for c in letters] + [f"{c}\n{c}{c}" for c in letters]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(encoder, text), repr(text)


@pytest.mark.parametrize("name, spaces", VOCABULARIES)
def test_ids_do_not_depend_on_what_is_remembered(name, spaces, monkeypatch):
    rng = random.Random(9)
    words = ["the", "of", "Über", "x1.", "data,", "東京", "", "  "] + [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    whole = list(tokens.Encoder(tokens.vocabulary_path(name), 1, spaces).encode_all(texts))
    monkeypatch.setattr(tokens, "MEMORY", 20_000)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 500)
    encoder = tokens.Encoder(tokens.vocabulary_path(name), 1, spaces)
    assert list(encoder.encode_all(texts)) == whole and encoder.older
    assert [np.frombuffer(w, "<u4").tolist() for w in whole] == [library_ids(encoder, t) for t in texts]


@pytest.mark.parametrize("name, spaces", VOCABULARIES)
def test_words_go_through_the_merges_together(name, spaces, monkeypatch):
    rng = random.Random(4)
    odd = [None, "", "\n", " ", "\na", "a\n", "a \nb", "a\nb c\n\nd\n e", "x\n Äb\nÖd, d\n(a) b\n\u00a0c", "Don't.\nIt's", "a\r\nb", "a\n1\n東\nq"]
    odd += ["a\n<|endoftext|>\nb <|endoftext|>", "l\x1f\nm a\x85\nb", "Thre*** at,&&& a_b_ c' d'' e.....!", "of%%%\nand,*** ...\n'", "İstanbul ǅ µ ª\nñ́ é"]
    texts = odd + [" ".join("".join(rng.choice("aeßéTNrst") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "\n" + "b", ".", "?!"]) for _ in range(90)) for _ in range(20)]
    encoder = tokens.Encoder(tokens.vocabulary_path(name), 1, spaces)
    monkeypatch.setattr(encoder, "_word", None)  # words are not asked for one by one
    heads = [f"x {t}" if t else t for t in texts[len(odd) :]]
    monkeypatch.setitem(encoder.heads, "x", np.array(library_ids(encoder, "x")[:-1], "<u4").tobytes())
    assert [np.frombuffer(w, "<u4").tolist() for w in encoder.encode_all(heads)] == [library_ids(encoder, t) for t in heads]
    encoder = tokens.Encoder(tokens.vocabulary_path(name), 1, spaces)
    assert [np.frombuffer(w, "<u4").tolist() for w in encoder.encode_all(texts)] == [library_ids(encoder, t or "") for t in texts]


@pytest.mark.parametrize("partitions", [2, 90])
def test_open_windows_become_few_in_any_number_of_partitions(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 60)))) for i in range(3000)] + [(9, "again"), (9, "again"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = packing.pack(docs, window=64, places=4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for spans in windows.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 64
    n_ids = 0
    for doc, spans in pieces.items():
        total = sum(n for _, n, _ in spans)
        n_ids += total
        if doc == 9:
            continue
        assert total == spans[0][2] and sorted(spans)[0][0] == 0
    short = sum(64 - sum(n for _, n in spans) for spans in windows.values())
    # Gaps under ``SMALLEST_CUT`` ids stay open, a quarter of these short windows at most.
    assert len(pieces) == 3001 and short < 0.25 * n_ids


def test_a_shared_passage_goes_from_all_but_its_first_document(spark):
    rng = random.Random(3)
    passage = " ".join(f"word{rng.randrange(900)}" for _ in range(60))
    rows = [(i, f"{i} " + " ".join(f"t{rng.randrange(9999)}" for _ in range(40)) + (passage if i % 7 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = sorted(map(tuple, suffix_dedup.report(docs).collect()))
    assert sum(r[2] > 300 for r in whole) == 8


def test_first_tokens_and_sets_take_one_python_step(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j % (i + 3)}" for j in range(40))) for i in range(9)], "doc_id bigint, text string")
    ids = docs.where("doc_id < 3").select(docs.doc_id.alias("rid"))
    levels = np.zeros(1 << jaccard_groups.SKETCH_BITS, dtype=np.uint8)
    for frame in (jaccard_groups._first_tokens(docs, ids, 4, 85, levels), jaccard_groups._sets(docs, ids, 4)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert {0, 1, 2} <= {r["rid"] for r in frame.collect()} < set(range(9))


def test_unions_rule_out_groups_and_members_make_the_links(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(30)]
    rows = []
    for i, b in enumerate(base):
        for j in range(4):
            parts = b.split(" ")
            parts[7 * j + 3] = f"z{j}"
            rows.append((len(rows), " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups.near_duplicates(docs, 4, 60).collect()}
    assert got == {i: i // 4 * 4 for i in range(len(rows))}
