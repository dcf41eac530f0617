"""Audit views over the star schema, each as a DataFrame and as a SQL CTE.

A recording is an order, a participant is a customer, a corpus is a region, a
session is an order date and the acquisition batch is its year. The line items of
an order give its feature vector. Orders without lines have no features.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import dense_position

FEATURES = ["f_qty", "f_discount", "f_tax", "f_lines", "f_price"]
MATCHED_BATCH = 1997


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


# -- recordings ----------------------------------------------------------------

REC = """
rec AS (
  SELECT o_orderkey AS recording_id, o_custkey AS subject_id, n_regionkey AS corpus,
    CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 'case'
         WHEN c_mktsegment IN ('AUTOMOBILE','FURNITURE') THEN 'control' ELSE 'young' END AS "group",
    CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 1 ELSE 0 END AS label,
    o_orderpriority AS task,
    o_orderstatus || '/' || o_custkey::VARCHAR AS folder_path,
    'dir' || (o_custkey % 1000)::VARCHAR AS folder_name,
    strftime(o_orderdate, '%Y-%m-%d') AS session_date,
    year(o_orderdate)::INTEGER AS batch,
    CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    c_acctbal AS age, o_totalprice AS header
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    seg = F.col("c_mktsegment")
    is_case = seg.isin("BUILDING", "MACHINERY")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("recording_id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("n_regionkey").alias("corpus"),
            F.when(is_case, "case")
            .when(seg.isin("AUTOMOBILE", "FURNITURE"), "control")
            .otherwise("young").alias("group"),
            is_case.cast("int").alias("label"),
            F.col("o_orderpriority").alias("task"),
            F.concat_ws("/", "o_orderstatus", F.col("o_custkey").cast("string")).alias("folder_path"),
            F.concat(F.lit("dir"), (F.col("o_custkey") % 1000).cast("string")).alias("folder_name"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("session_date"),
            F.year("o_orderdate").alias("batch"),
            F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("M").alias("sex"),
            F.col("c_acctbal").alias("age"),
            F.col("o_totalprice").alias("header"),
        )
    )


# -- features ------------------------------------------------------------------

FEAT = """
feat AS (
  SELECT l_orderkey AS recording_id, sum(l_quantity) AS f_qty, round(avg(l_discount), 12) AS f_discount,
    round(avg(l_tax), 12) AS f_tax, count(*)::DOUBLE AS f_lines, round(sum(l_extendedprice), 9) AS f_price
  FROM lineitem GROUP BY l_orderkey
)"""


def line_features(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("recording_id")).agg(
        F.sum("l_quantity").alias("f_qty"),
        # rounded, so that the order of summation cannot split tied values
        F.round(F.avg("l_discount"), 12).alias("f_discount"),
        F.round(F.avg("l_tax"), 12).alias("f_tax"),
        F.count(F.lit(1)).cast("double").alias("f_lines"),
        F.round(F.sum("l_extendedprice"), 9).alias("f_price"),
    )


#: ``ft`` = recordings with features, ``fc`` = its case/control cohort.
FT = REC + "," + FEAT + """,
ft AS (SELECT rec.*, f_qty, f_discount, f_tax, f_lines, f_price
       FROM rec JOIN feat USING (recording_id)),
fc AS (SELECT * FROM ft WHERE "group" IN ('case','control'))"""


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return recordings(spark, sf).join(line_features(spark, sf), "recording_id")


def feature_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return feature_table(spark, sf).where(F.col("group").isin("case", "control"))


# -- signals -------------------------------------------------------------------

#: One signal per user: dense positions in time order, mean removed, scaled.
SIG = """
sig0 AS (SELECT user_id AS recording_id, event_type AS coef, value,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
           avg(value) OVER (PARTITION BY user_id) AS m
         FROM events),
sig AS (SELECT recording_id, coef, pos, (value - m) / 500.0::DOUBLE AS x, value FROM sig0)"""


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zoned or zone-free timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST({ts} AS TIMESTAMP_NTZ))")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_type").alias("coef"),
        "value", micros("ts").alias("t"), "event_id",
    )
    pos = dense_position(ev, ["recording_id"], ["t", "event_id"], "pos")
    mean = ev.groupBy("recording_id").agg(F.avg("value").alias("m"))
    return pos.join(mean, "recording_id").select(
        "recording_id", "coef", (F.col("pos") - 1).alias("pos"),
        ((F.col("value") - F.col("m")) / F.lit(500.0)).alias("x"), "value",
    )


#: Embeddings as frame tables: 4 coefficients by 16 frames per vector.
FRAMES = """
frames AS (SELECT vec_id AS recording_id, ((i - 1) // 16)::INTEGER AS coef,
             ((i - 1) % 16)::BIGINT AS frame, embedding[i]::DOUBLE AS value
           FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return emb.select(F.col("vec_id").alias("recording_id"), F.posexplode("embedding")).select(
        "recording_id", F.floor(F.col("pos") / 16).cast("int").alias("coef"),
        (F.col("pos") % 16).cast("bigint").alias("frame"),
        F.col("col").cast("double").alias("value"),
    )


def r6(col: Column | str) -> Column:
    """Round to six places so that sum order does not show."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def s6(expr: str) -> str:
    """SQL twin of ``r6``; adding zero turns -0.0 into 0.0."""
    return f"(round(({expr})::DOUBLE, 6) + 0.0::DOUBLE)"
