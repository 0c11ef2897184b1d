"""Queries over daily and monthly series: paired series, annual indicators, normals, gap filling, satellite bands by year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import panel as P
from ..operators import series as I
from ..sources.io import read_table
from . import tables as T
from .queries import _DRY, _dry, query, rounded

W_ = "WITH " + T.TWO_DAILY_SQL
_PAIR = ", b AS (SELECT g, day, CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter, hi, lo FROM w WHERE hi IS NOT NULL AND lo IS NOT NULL)"


def _days(spark, d):
    both = I.paired(T.two_daily(spark, d), ["g", "day"], "name", "v", "hi", "lo")
    return both.select("g", "day", F.year("day").alias("year"), F.quarter("day").alias("quarter"), "hi", "lo")


@query(W_ + _PAIR + " SELECT g, day, hi, lo, round((hi + lo) / 2, 6) AS mean, hi - lo AS amplitude FROM b")
def daily_pair_join(spark, d):
    """The two series of a day side by side; days that one lacks are absent."""
    return rounded(_days(spark, d).select("g", "day", "hi", "lo", ((F.col("hi") + F.col("lo")) / 2).alias("mean"), (F.col("hi") - F.col("lo")).alias("amplitude")), 6)


_ANNUAL = _PAIR + """, bar AS (SELECT g, quantile_cont(hi, 0.9) AS ph, quantile_cont(lo, 0.9) AS pl FROM b WHERE year BETWEEN 1995 AND 1998 AND g <> 4 GROUP BY g)
, t AS (SELECT g, year, count(*) AS n_days, round(avg((hi + lo) / 2), 6) AS mean, round(avg(hi - lo), 6) AS amplitude, """ + ", ".join(f"round(avg((hi + lo) / 2) FILTER (WHERE quarter = {q}), 6) AS mean_q{q}" for q in (1, 2, 3, 4)) + """,
 max(hi) AS highest, min(lo) AS lowest, round(quantile_cont(hi, 0.95), 6) AS p95, count(*) FILTER (WHERE hi > ph) AS hot_days, count(*) FILTER (WHERE lo > pl) AS hot_nights, count(*) FILTER (WHERE hi >= 45) AS days_over_limit, count(*) FILTER (WHERE lo >= 20) AS nights_over_limit
 FROM b JOIN bar USING (g) GROUP BY g, year)
, r AS (SELECT g, CAST(year(day) AS INTEGER) AS year, round(sum(rain), 4) AS rain_total, count(*) FILTER (WHERE rain >= 1) AS rain_days, round(max(rain), 4) AS rain_highest FROM w WHERE rain IS NOT NULL GROUP BY 1, 2)
, h AS (SELECT g, CAST(year(day) AS INTEGER) AS year, round(avg(100 * vapour / nullif(vapour + deficit, 0)), 6) AS humidity, round(min(100 * vapour / nullif(vapour + deficit, 0)), 6) AS humidity_lowest FROM w WHERE vapour IS NOT NULL AND deficit IS NOT NULL GROUP BY 1, 2)"""


@query(W_ + _ANNUAL + " SELECT t.*, rain_total, rain_days, rain_highest, humidity, humidity_lowest FROM t LEFT JOIN r USING (g, year) LEFT JOIN h USING (g, year)")
def annual_climate(spark, d):
    """Thirteen indicators of the paired series, three of rain and two of humidity, left-joined; region 4 has no reference years, so no threshold and no rows."""
    days = _days(spark, d)
    reference = days.where((F.col("g") != 4) | ~F.col("year").between(1995, 1998))
    bars = reference.where(F.col("year").between(1995, 1998)).select("g").distinct()
    both = I.two_sided_indicators(days.join(bars, "g", "left_semi"), "g", "hi", "lo", (1995, 1998), 45.0, 20.0)
    series = T.two_daily(spark, d).withColumn("year", F.year("day"))
    rain = series.where("name = 'rain'").groupBy("g", "year").agg(F.round(F.sum("v"), 4).alias("rain_total"), F.count_if(F.col("v") >= 1).alias("rain_days"), F.max("v").alias("rain_highest"))
    air = I.paired(series, ["g", "day", "year"], "name", "v", "vapour", "deficit").withColumn("rh", S.relative_humidity(F.col("vapour"), F.col("deficit")))
    air = air.groupBy("g", "year").agg(F.avg("rh").alias("humidity"), F.min("rh").alias("humidity_lowest"))
    return rounded(both.join(rain, ["g", "year"], "left").join(air, ["g", "year"], "left"), 6)


_M = "WITH " + T.MONTHLY_SQL


@query(_M + ", n AS (SELECT nation, mo, sum(v) / count(DISTINCT yr) AS normal FROM m GROUP BY 1, 2) SELECT nation, round(avg(normal), 5) AS mean, round(avg(normal) * 12, 5) AS year_total, count(*) AS months FROM n GROUP BY 1")
def monthly_normals(spark, d):
    """Monthly totals over their years, and the year made of twelve such means."""
    n = T.monthly(spark, d).groupBy("nation", "mo").agg((F.sum("v") / F.count_distinct("yr")).alias("normal"))
    return rounded(n.groupBy("nation").agg(F.avg("normal").alias("mean"), (F.avg("normal") * 12).alias("year_total"), F.count("*").alias("months")), 5)


_GAPS = ", t AS (SELECT DISTINCT yr, mo FROM m), n0 AS (SELECT DISTINCT nation FROM m), nm AS (SELECT nation, mo, avg(v) AS normal FROM m GROUP BY 1, 2), x AS (SELECT n0.nation, t.yr, t.mo, coalesce(v, normal) * 0.1 AS v, CAST(m.v IS NULL AS INTEGER) AS was FROM n0 CROSS JOIN t LEFT JOIN m ON m.nation = n0.nation AND m.yr = t.yr AND m.mo = t.mo LEFT JOIN nm ON nm.nation = n0.nation AND nm.mo = t.mo)"


@query(_DRY + _GAPS + " SELECT x.nation, yr, round(avg(x.v), 8) AS mean, round(avg(x.v) FILTER (WHERE (mo - start + 12) % 12 < 3), 8) AS dry_mean, CAST(sum(was) AS BIGINT) AS n_filled FROM x LEFT JOIN f ON f.nation = x.nation GROUP BY 1, 2")
def gap_filled_means(spark, d):
    """Annual and dry-season means of the filled series, rescaled by a tenth."""
    m = T.monthly(spark, d)
    rows = P.skeleton(m.select("nation").distinct(), m.select("yr", "mo")).join(m, ["nation", "yr", "mo"], "left")
    rows = I.gap_filled(rows, ["nation"], "mo", "v").withColumn("filled", F.col("filled") * 0.1).join(_dry(spark, d), "nation", "left")
    dry = F.when(I.in_season(F.col("mo"), F.col("start")), F.col("filled"))
    return rounded(rows.groupBy("nation", "yr").agg(F.avg("filled").alias("mean"), F.avg(dry).alias("dry_mean"), F.sum("was_filled").alias("n_filled")), 8)


_EV = "WITH ev AS (SELECT user_id, CAST(year(ts) AS INTEGER) AS yr, CAST(month(ts) AS INTEGER) AS mo, value * 0.02 - 1.5 AS v, event_id & 3 AS f, (event_id >> 6) & 3 AS er FROM events), q AS (SELECT *, (f <= 1 AND er <= 1) AS wide, (f = 0 OR (f = 1 AND er = 0)) AS strict FROM ev)"
_BANDS = ", ".join(f"round(avg(v) FILTER (WHERE {c}), 7) AS {c}_mean, count(v) FILTER (WHERE {c}) AS {c}_n, round(avg(v) FILTER (WHERE {c} AND mo BETWEEN 7 AND 9), 7) AS {c}_jas, round(max(v) FILTER (WHERE {c}), 7) AS {c}_highest, round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 7) AS {c}_valid" for c in ("wide", "strict"))


@query(_EV + f" SELECT user_id, yr, {_BANDS} FROM q GROUP BY 1, 2")
def satellite_bands(spark, d):
    """By user and year, under the wide and the strict quality rule: mean, observations, mean of July to September, maximum, valid share; values decoded by scale and offset."""
    e = read_table(spark, d, "events", ["event_id", "user_id", "ts", "value"])
    wide, strict = S.quality_masks(S.bits(F.col("event_id"), 0, 3), S.bits(F.col("event_id"), 6, 3))
    q = e.select("user_id", F.year("ts").alias("yr"), F.month("ts").alias("mo"), (F.col("value") * 0.02 - 1.5).alias("v"), wide.alias("wide"), strict.alias("strict"))
    out = []
    for c in ("wide", "strict"):
        v = F.when(F.col(c), F.col("v"))
        out += [F.avg(v).alias(f"{c}_mean"), F.count(v).alias(f"{c}_n"), F.avg(F.when(F.col("mo").between(7, 9), v)).alias(f"{c}_jas"), F.max(v).alias(f"{c}_highest"), F.avg(F.col(c).cast("int")).alias(f"{c}_valid")]
    return rounded(q.groupBy("user_id", "yr").agg(*out), 7)


@query("SELECT event_type, CAST(month(ts) AS INTEGER) AS mo, min(CAST(dayofyear(ts) AS INTEGER)) AS first_day, max(CAST(dayofyear(ts) AS INTEGER)) AS last_day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-03-01' GROUP BY 1, 2")
def date_window(spark, d):
    """A half-open range of dates, by month, with days of the year."""
    e = S.in_dates(read_table(spark, d, "events", ["event_type", "ts"]), "ts", "2024-01-05", "2024-03-01")
    day = F.dayofyear("ts")
    return e.groupBy("event_type", F.month("ts").alias("mo")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))
