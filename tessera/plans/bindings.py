"""Tables of the star schema seen as grouped, ordered point data; beside each view its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

#: events per user: unit, i (order), x (value), k, y (label).
EV = """ev AS (SELECT user_id AS unit, event_id AS i, value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(event_type = 'purchase' AS INTEGER) AS y, event_type FROM events)"""
#: embeddings as points of a unit: unit, i, px, py, pz (scaled so that radii of 6 to 18 tell something).
PTS = """pts AS (SELECT label AS unit, vec_id AS i, embedding[1]::DOUBLE * 30 AS px, embedding[2]::DOUBLE * 30 AS py, embedding[3]::DOUBLE * 30 AS pz, embedding[4]::DOUBLE * 30 AS v FROM embeddings)"""
#: orders per customer: unit, i, x, y.
ORD = """od AS (SELECT o_custkey AS unit, o_orderkey AS i, o_totalprice AS x, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)"""


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("unit"), F.col("event_id").alias("i"), F.col("value").alias("x"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), (F.col("event_type") == "purchase").cast("int").alias("y"), "event_type")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.get(F.col("embedding"), F.lit(k)).cast("double") * 30
    return e.select(F.col("label").alias("unit"), F.col("vec_id").alias("i"), at(0).alias("px"), at(1).alias("py"), at(2).alias("pz"), at(3).alias("v"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
