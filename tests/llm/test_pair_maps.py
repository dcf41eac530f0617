"""Bit maps that rule pairs out before their sets are moved: no link is lost, little else passes."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from plumbline.llm import jaccard_groups, line_dedup  # noqa: E402


def test_maps_bound_what_sets_lack():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 40), (70, 64), (200, 900), (0, 5)):
        both = rng.integers(0, 1 << 63, min(n, m) // 2, dtype=np.uint64)
        a, b = (np.unique(np.r_[both, rng.integers(0, 1 << 63, x - len(both), dtype=np.uint64)]) for x in (n, m))
        gone, back = jaccard_groups._absent(jaccard_groups._map(a), jaccard_groups._map(b))
        assert gone <= len(np.setdiff1d(a, b)) and back <= len(np.setdiff1d(b, a))
        if min(n, m) >= 64:
            assert gone + back > 0


def test_only_documents_that_may_link_are_compared_exactly(spark):
    """Every document meets groups of every size; links of brute force are kept, few other pairs are."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice((40, 44, 400)))] for _ in range(24)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i, " ".join(words)))
        rows.append((100 + i, " ".join([*words[:-1], f"x{i}"])))
        rows.append((200 + i, " ".join([*words[: len(words) * 2 // 3], *(f"y{rng.randrange(3000)}" for _ in range(len(words) // 3))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: {tuple(t.split()[j:j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    group = {i: i % 9 for i in sets}
    ids = docs.select(docs["doc_id"].alias("rid"))
    maps = jaccard_groups._maps(docs, ids, 4)
    meets = spark.createDataFrame([(i, g) for i in sets for g in range(9) if g != group[i]], "rid bigint, gid int")
    groups = spark.createDataFrame([(g, i) for i, g in group.items()], "gid int, rid bigint")
    found = [tuple(r) for r in jaccard_groups._pairs(meets, groups, maps, 85).collect()]
    want = {
        (a, b) for a in sets for b in sets
        if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    }
    assert len(want) >= 20 and want <= set(found)
    assert len(found) == len(set(found)) <= 2 * len(want)


def test_lines_meet_again_only_where_maps_leave_room(spark):
    """One window of lines that agree in all half bands: pairs of brute force stay, other pairs go."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh éß東") for _ in range(n)) for n in (3, 7, 60, 64, 150, 700)]
    lines = [*base, *(x[:-1] + "q" for x in base), *(x[: len(x) // 2] + x[: len(x) // 2 : -1] for x in base), "ab" * 100, "ab" * 101]
    sets = [{x[i:i + 5] for i in range(len(x) - 4)} or {x} for x in lines]
    texts = spark.createDataFrame([((i, 0), x, len(s)) for i, (x, s) in enumerate(zip(lines, sets))], "node struct<doc_id: bigint, line_no: int>, line string, size int")
    mapped = {r["node"]["doc_id"]: r for r in line_dedup._mapped(texts).collect()}
    ones = {i: sum(bin(x & (1 << 64) - 1).count("1") for x in r["map"]) for i, r in mapped.items()}
    assert all(len(r["map"]) == line_dedup.MAP_WORDS and r["spare"] == len(sets[i]) - ones[i] >= 0 for i, r in mapped.items())
    window = texts.selectExpr("7L AS base", "node.doc_id AS id", "1L AS s0", "1L AS s1", f"{len(lines)} AS n")
    maps = line_dedup._mapped(texts).selectExpr("node.doc_id AS id", "size", "spare", "map")
    none = spark.createDataFrame([], "id bigint, part bigint")
    got = {tuple(r) for r in line_dedup._inner_pairs(window.join(maps, "id"), none).collect()}
    want = {
        (a, b) for a in range(len(lines)) for b in range(a)
        if len(sets[a] & sets[b]) >= line_dedup.SIMILARITY * len(sets[a] | sets[b])
    }
    assert len(want) >= 4 and want <= got and len(got) <= len(want) + 6


def test_lines_that_agree_with_another_are_found_without_pairs(spark, monkeypatch):
    """The same lines as those of all pairs, in one block and in many, each once."""
    rng = np.random.default_rng(2)
    rows = [(b, 100 * b + i, *(int(x) for x in rng.integers(0, 1 << 8, 2) * 0x0101010101), 40) for b in (1, 2) for i in range(40)]
    rows += [(3, 900 + i, 5, 5, 3) for i in range(3)]
    windows = spark.createDataFrame(rows, "base bigint, id bigint, s0 bigint, s1 bigint, n bigint")
    part = spark.createDataFrame([(100 + i, i // 20) for i in range(40)], "id bigint, part bigint")
    for lines in (1000, 7):
        monkeypatch.setattr(line_dedup, "BLOCK_LINES", lines)
        want = {x for r in line_dedup._inner_pairs(windows, part).collect() for x in r}
        got = [r[0] for r in line_dedup._meeting(windows, part).collect()]
        assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 80
