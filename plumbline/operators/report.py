"""Gates and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ci_text
from .cohort import histogram
from .ordering import exact_quantiles

# Acceptance thresholds.
CONTROL_CEILING = 0.65
SEVERITY_FLOOR = 0.30


def gates(control: DataFrame, headline: DataFrame, proxy: DataFrame, severity: DataFrame) -> DataFrame:
    """``gate, value, threshold, passed`` from four one-row inputs.

    ``control.auroc`` must stay low, ``headline.ci_lo`` must beat ``proxy.auroc``, and
    both ``severity.rho_1`` and ``rho_2`` must be clear.
    """
    a = control.select(
        F.lit("A").alias("gate"), F.col("auroc").alias("value"), F.lit(CONTROL_CEILING).alias("threshold"),
        (F.col("auroc") <= CONTROL_CEILING).alias("passed"),
    )
    floor = proxy.select("auroc").scalar()
    b = headline.select(
        F.lit("B").alias("gate"), F.col("ci_lo").alias("value"), floor.alias("threshold"), (F.col("ci_lo") > floor).alias("passed")
    )
    low = F.least("rho_1", "rho_2")
    c = severity.select(
        F.lit("C").alias("gate"), low.alias("value"), F.lit(SEVERITY_FLOOR).alias("threshold"), (low > SEVERITY_FLOOR).alias("passed")
    )
    return a.unionByName(b).unionByName(c).withColumn("passed", F.coalesce("passed", F.lit(False)))


def comparison_table(results: DataFrame, literature: Sequence[tuple[str, str, str]], name: str) -> DataFrame:
    """Published rows as given, followed by the best computed row."""
    given = results.sparkSession.createDataFrame(list(literature), "study string, scheme string, metric string")
    best = results.orderBy(F.desc_nulls_last("auroc_participant"), "arm").limit(1)
    text = F.concat(F.lit("AUROC "), ci_text(*[F.round(c, 6) for c in ("auroc_participant", "ci_lo", "ci_hi")]))
    return given.unionByName(best.select(F.lit(name).alias("study"), F.col("arm").alias("scheme"), text.alias("metric")))


def plot_data(df: DataFrame, by: Sequence[str], value: str, cuts: Sequence[float]) -> DataFrame:
    """Histogram counts and box quartiles as one long table."""
    bars = histogram(df, by, value, cuts).select(
        *by, F.lit("histogram").alias("kind"), F.col("bin").cast("string").alias("item"), F.col("n").cast("double").alias("value")
    )
    boxes = exact_quantiles(df, by, value, [0.25, 0.5, 0.75]).unpivot(list(by), ["q_0", "q_1", "q_2"], "item", "value")
    return bars.unionByName(boxes.select(*by, F.lit("box").alias("kind"), "item", "value"))
