"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format, decontaminate, html_text, importance, jaccard_groups, line_dedup, merkle, packing, quality_ngrams,
    quality_rff, suffix_dedup, surrogates, token_file,
)
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ngrams.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.report(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_html_text, op3_decontaminate, op4_suffix_dedup, op5_jaccard_groups, op6_token_file,
        op7_line_dedup, op8_quality_rules, op9_packing, op10_surrogates, op11_importance_resampling,
        op12_chat_format, op13_merkle_manifest,
    )
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

#: CRC-32 of a feature's UTF-8 bytes, byte by byte from a table that SQL makes by its rule.
_CRC_TABLE = """
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
    FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    spelt = f"hex(encode({text}))"
    return (
        f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr({spelt}, (2 * i + 1)::BIGINT, 2))::BIGINT), "
        "lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"
    )


_BUCKETS = f"""{_CRC_TABLE},
bucket AS (SELECT f, {_crc("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM feat), crc)"""


def _field(expr: str) -> str:
    return f"coalesce(octet_length(encode({expr}::VARCHAR))::VARCHAR || ':' || {expr}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, base: str) -> str:
    """Recursive levels of trees ``(g, l, i, n, h)``, three nodes a run."""
    return (
        f"{name} AS ({base} UNION ALL SELECT g, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) "
        f"FROM {name} WHERE n > 1 GROUP BY g, l, i // 3, n)"
    )


def _beside(name: str, tree: str) -> str:
    """What stands left and right of each node in its run, for levels below the root."""
    return (
        f"{name} AS (SELECT a.g, a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, "
        f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt FROM {tree} a JOIN {tree} b "
        "ON a.g IS NOT DISTINCT FROM b.g AND a.l = b.l AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.g, a.l, a.i)"
    )

_ESCAPED = "replace({c}, chr(92), chr(92) || chr(92))"
for _control in chat_format.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}' || chr(92) || '.{_control[1:]}')"

ORACLES: dict[str, str] = {
    "op12_chat_format": f"""
WITH rows AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM (SELECT unnest(range(2)) AS i)
),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(24 + length(replace({_ESCAPED.replace('{c}', 'role')}, chr(10), chr(92) || 'n')) + length({_ESCAPED.replace('{c}', 'text')}))::BIGINT AS formatted_chars
FROM filled GROUP BY conv_id
""",
    "op11_importance_resampling": f"""
WITH words AS (SELECT 'd' AS side, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 't', item_id, {_WORDS} FROM benchmark),
feat AS (
    SELECT side, id, unnest(w) AS f FROM words
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
),{_BUCKETS},
held AS (SELECT b, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 't')::DOUBLE AS t FROM feat JOIN bucket USING (f) GROUP BY b),
total AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM held),
gain AS (SELECT b, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM held, total),
mean AS (SELECT id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM feat JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY id),
drawn AS (SELECT id, len(w) AS n_words, ('0x' || substr(sha256('7:' || id::VARCHAR), 1, 8))::BIGINT AS h FROM words WHERE side = 'd'),
scored AS (
    SELECT id, n_words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM drawn LEFT JOIN mean USING (id)
),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS n_all FROM scored WHERE n_words >= 20)
SELECT id AS doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN r <= 25 * n_all // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (id)
""",
    "op3_decontaminate": f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS k FROM item WHERE len(w) > 0),
cut AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM cut),
size AS (SELECT DISTINCT k FROM win),
place AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k),
seen AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM place),
found AS (SELECT doc_id, item_id, win.k, i FROM seen JOIN win ON seen.k = win.k AND seen.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
who AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(who.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE {_CRC_TABLE},
leaf AS (
    SELECT doc_id, source AS g, {_leaf("text")} AS h,
        CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS h2,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
    FROM documents, crc
),
{_levels("low", "SELECT g, 0 AS l, i, n, h FROM leaf")},
sub AS (SELECT g, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_levels("high", "SELECT 0 AS g, 0 AS l, i, n, h FROM sub")},
{_beside("low_run", "low")}, {_beside("high_run", "high")},
steps AS (
    SELECT doc_id, l, lft, rgt FROM leaf JOIN low_run r ON leaf.g IS NOT DISTINCT FROM r.g AND r.i = leaf.i // (3 ** r.l)::BIGINT
    UNION ALL SELECT doc_id, 100 + l, lft, rgt FROM leaf JOIN sub ON leaf.g IS NOT DISTINCT FROM sub.g
        JOIN high_run r ON r.i = sub.i // (3 ** r.l)::BIGINT
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS step FROM steps),
proof AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS p, max(step) AS last FROM numbered GROUP BY doc_id),
fold AS (
    SELECT doc_id, 0::BIGINT AS step, h2 AS h FROM leaf
    UNION ALL SELECT fold.doc_id, fold.step + 1, sha256(lft || fold.h || rgt) FROM fold JOIN numbered r ON r.doc_id = fold.doc_id AND r.step = fold.step + 1
),
top AS (SELECT h FROM high WHERE n = 1)
SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, top.h AS root, coalesce(p, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = top.h AS verified
FROM leaf JOIN sub ON leaf.g IS NOT DISTINCT FROM sub.g CROSS JOIN top LEFT JOIN proof ON proof.doc_id = leaf.doc_id
JOIN fold ON fold.doc_id = leaf.doc_id AND fold.step = coalesce(proof.last, 0)
""",
}
