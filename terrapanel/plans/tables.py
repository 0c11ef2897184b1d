"""Stand-ins for the domain's tables: a supplier by ship year panel (nested in regions), daily and monthly series, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import read_table


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    n = read_table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("e"), F.col("n_regionkey").cast("int").alias("g"), F.col("s_nationkey").cast("int").alias("nation"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """e, g, t, y, x, z by supplier and ship year."""
    li = read_table(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount"])
    by = li.groupBy(F.col("l_suppkey").alias("e"), F.year("l_shipdate").alias("t")).agg(F.round(F.sum("l_extendedprice") / 1000, 3).alias("y"), F.sum("l_quantity").alias("x"), F.round(F.sum("l_discount") * 100).alias("z"))
    return by.join(suppliers(spark, d).select("e", "g"), "e").select("e", "g", "t", "y", "x", "z")


PANEL_SQL = """
s AS (SELECT s_suppkey AS e, CAST(n_regionkey AS INTEGER) AS g, CAST(s_nationkey AS INTEGER) AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p0 AS (SELECT l_suppkey AS e, CAST(year(l_shipdate) AS INTEGER) AS t, round(sum(l_extendedprice) / 1000, 3) AS y, sum(l_quantity) AS x, round(sum(l_discount) * 100) AS z FROM lineitem GROUP BY 1, 2),
p AS (SELECT e, g, t, y, x, z FROM p0 JOIN s USING (e))
"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """nation, year, month, v: orders' quantity of customers by nation and order month; months without orders are absent."""
    o = read_table(spark, d, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"])
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy(F.col("c_nationkey").cast("int").alias("nation"), F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo")).agg(F.round(F.sum("o_totalprice"), 0).alias("v"))


MONTHLY_SQL = "m AS (SELECT CAST(c_nationkey AS INTEGER) AS nation, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mo, round(sum(o_totalprice), 0) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """g, yr, q, day, v: mean quantity shipped by region and day."""
    li = read_table(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity"])
    j = li.join(suppliers(spark, d), li["l_suppkey"] == F.col("e"))
    day = F.to_date("l_shipdate")
    return j.groupBy("g", day.alias("day")).agg(F.avg("l_quantity").alias("v")).select("g", F.year("day").alias("yr"), F.quarter("day").alias("q"), "day", "v")


DAILY_SQL = """
s AS (SELECT s_suppkey AS e, CAST(n_regionkey AS INTEGER) AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dd AS (SELECT g, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS v FROM lineitem JOIN s ON l_suppkey = e GROUP BY 1, 2),
d AS (SELECT g, CAST(year(day) AS INTEGER) AS yr, CAST(quarter(day) AS INTEGER) AS q, day, v FROM dd)
"""


def two_daily(spark: SparkSession, d: str) -> DataFrame:
    """Named daily series (g, day, name, v): hi and lo of quantities, rain and vapour and deficit of discounts and taxes; lo lacks some days."""
    li = read_table(spark, d, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_linenumber"])
    j = li.join(suppliers(spark, d), li["l_suppkey"] == F.col("e")).withColumn("day", F.to_date("l_shipdate"))
    by = j.groupBy("g", "day").agg(F.max("l_quantity").alias("hi"), F.min(F.when(F.col("l_linenumber") <= 2, F.col("l_quantity"))).alias("lo"), F.round(F.sum("l_discount") * 10, 2).alias("rain"), F.round(F.sum("l_tax"), 2).alias("vapour"), F.round(F.sum("l_discount"), 2).alias("deficit"))
    return by.unpivot(["g", "day"], ["hi", "lo", "rain", "vapour", "deficit"], "name", "v").where("v is not null")


TWO_DAILY_SQL = """
s AS (SELECT s_suppkey AS e, CAST(n_regionkey AS INTEGER) AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w AS (SELECT g, CAST(l_shipdate AS DATE) AS day, max(l_quantity) AS hi, min(l_quantity) FILTER (WHERE l_linenumber <= 2) AS lo, round(sum(l_discount) * 10, 2) AS rain, round(sum(l_tax), 2) AS vapour, round(sum(l_discount), 2) AS deficit FROM lineitem JOIN s ON l_suppkey = e GROUP BY 1, 2)
"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, x, y: a supplier's place, from the first two components of the vector of its number."""
    v = read_table(spark, d, "embeddings", ["vec_id", "embedding"]).select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return v.join(read_table(spark, d, "supplier", ["s_suppkey"]).select(F.col("s_suppkey").alias("id")), "id", "left_semi")


POINTS_SQL = "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings WHERE vec_id IN (SELECT s_suppkey FROM supplier))"
