"""SQL text shared by the oracles: folds, models, AUROC, bootstrap.

These say the same things as the operators in the most direct way (re-scans,
plain windows, one row per participant and draw), which is what makes them a check.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.draws import draw_sql, poisson_sql, text_key_sql

UNIT = {
    "A_recording": "recording_id::VARCHAR",
    "B_folder_path": "folder_path",
    "C_subject_key": "subject_id::VARCHAR",
}


def _list(cols: Sequence[str], prefix: str = "", tail: str = ", ") -> str:
    return "".join(f"{prefix}{c}{tail}" for c in cols)


def _same(cols: Sequence[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols) or "TRUE"


def folds_sql(arms, k: int, repeats: int, seed: int, base: str = "fc", cell: Sequence[str] = (), name: str = "folds") -> str:
    """CTEs ending in ``name``: rows of ``base`` once per arm and repeat with ``fold``."""
    ctes, unions = [], []
    for i, arm in enumerate(arms):
        if arm == "D_leave_one_corpus_out":
            unions.append(
                f"SELECT {base}.*, '{arm}' AS arm, r AS repeat, (dense_rank() OVER (PARTITION BY {_list(cell)}r ORDER BY corpus) - 1)::BIGINT AS fold "
                f"FROM {base}, (SELECT unnest(range({repeats})) AS r)"
            )
            continue
        unit = UNIT[arm]
        u, d = f"{name}_u{i}", f"{name}_d{i}"
        ctes.append(f"{u} AS (SELECT {_list(cell)}{unit} AS unit, max(label) AS label FROM {base} GROUP BY ALL)")
        h = text_key_sql("unit")
        ctes.append(
            f"{d} AS (SELECT {_list(cell)}unit, r AS repeat, ((row_number() OVER (PARTITION BY {_list(cell)}r, label ORDER BY "
            f"{draw_sql(seed, 'r', h)}, unit) - 1) % {k})::BIGINT AS fold FROM {u}, (SELECT unnest(range({repeats})) AS r))"
        )
        unions.append(
            f"SELECT b.*, '{arm}' AS arm, d.repeat, d.fold FROM {base} b JOIN {d} d ON d.unit = b.{unit} AND {_same(cell, 'b', 'd')}"
        )
    ctes.append(f"{name} AS ({' UNION ALL '.join(unions)})")
    return ",\n".join(ctes)


def models_sql(features, keys: Sequence[str], folds: str = "folds", name: str = "models", label: str = "label") -> str:
    cols = [f"count(*) FILTER (t.{label} = 1) AS n1, count(*) FILTER (t.{label} = 0) AS n0"]
    for f in features:
        for y in (0, 1):
            cols.append(f"avg(t.{f}) FILTER (t.{label} = {y}) AS {f}_m{y}, var_pop(t.{f}) FILTER (t.{label} = {y}) + 1e-9::DOUBLE AS {f}_v{y}")
    return (
        f"{name} AS (SELECT {_list(keys, 'm.')}m.fold, {', '.join(cols)} FROM (SELECT DISTINCT {_list(keys)}fold FROM {folds}) m "
        f"JOIN {folds} t ON {_same(keys, 'm', 't')} AND t.fold <> m.fold GROUP BY {_list(keys, 'm.')}m.fold)"
    )


def log_odds_sql(features, model: str = "m", row: str = "f") -> str:
    total = f"ln(nullif({model}.n1, 0)::DOUBLE) - ln(nullif({model}.n0, 0)::DOUBLE)"
    for f in features:
        for y, sign in ((1, "-"), (0, "+")):
            total += f" {sign} (ln({model}.{f}_v{y}) + ({row}.{f} - {model}.{f}_m{y}) * ({row}.{f} - {model}.{f}_m{y}) / {model}.{f}_v{y}) / 2"
    return f"({total})"


def scored_sql(features, keys: Sequence[str], folds: str = "folds", models: str = "models", name: str = "scored", extra: str = "") -> str:
    return (
        f"{name} AS (SELECT f.*{extra}, {log_odds_sql(features)} AS score FROM {folds} f JOIN {models} m "
        f"ON {_same(keys, 'f', 'm')} AND f.fold = m.fold)"
    )


def auroc_sql(src: str, keys: Sequence[str], name: str, label: str = "label", score: str = "score") -> str:
    k = _list(keys)
    part = f"PARTITION BY {k[:-2]} " if keys else ""
    ties = f"PARTITION BY {k}{score}"
    return (
        f"{name}_r AS (SELECT {k}{label} AS y, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({ties}) - 1) / 2.0::DOUBLE AS r "
        f"FROM {src} WHERE {score} IS NOT NULL),\n"
        f"{name} AS (SELECT {k}count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, "
        f"(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) "
        f"/ nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)::DOUBLE AS auroc FROM {name}_r {'GROUP BY ' + k[:-2] if keys else ''})"
    )


def draws_sql(src: str, keys: Sequence[str], unit: str, n_boot: int, seed: int, name: str) -> str:
    """CTEs ending in ``name``: ``keys, draw, auroc`` with Poisson weights."""
    k = _list(keys)
    part = f"PARTITION BY {k}draw"
    return (
        f"{name}_w AS (SELECT {k}score, label, draw, {poisson_sql(seed, 'draw', unit)} AS w FROM {src}, (SELECT unnest(range({n_boot})) AS draw) WHERE score IS NOT NULL),\n"
        f"{name}_s AS (SELECT {k}draw, score, sum(w * label) AS p, sum(w * (1 - label)) AS q FROM {name}_w GROUP BY ALL),\n"
        f"{name}_c AS (SELECT {k}draw, p, q, sum(q) OVER ({part} ORDER BY score) - q AS below FROM {name}_s),\n"
        f"{name} AS (SELECT {k}draw, sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0)::DOUBLE AS auroc FROM {name}_c GROUP BY ALL)"
    )


def ci_sql(src: str, keys: Sequence[str], unit: str, n_boot: int, seed: int, name: str) -> str:
    k = _list(keys)
    band = (
        f"{name}_b AS (SELECT {k}quantile_cont(auroc, 0.025) AS ci_lo, quantile_cont(auroc, 0.975) AS ci_hi "
        f"FROM {name}_d WHERE auroc IS NOT NULL {'GROUP BY ALL' if keys else ''})"
    )
    on = _same(keys, "p", "b")
    return (
        draws_sql(src, keys, unit, n_boot, seed, f"{name}_d") + ",\n" + band + ",\n" + auroc_sql(src, keys, f"{name}_p") + ",\n"
        f"{name} AS (SELECT {_list(keys, 'p.')}p.auroc, b.ci_lo, b.ci_hi, p.n_pos + p.n_neg AS n FROM {name}_p p LEFT JOIN {name}_b b ON {on})"
    )
