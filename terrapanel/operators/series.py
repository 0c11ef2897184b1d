"""Indicators of daily series, composites of pixels, dry seasons, zonal summaries and table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def annual_indicators(daily: DataFrame, entity: str, year: str, quarter: str, value: str, reference: tuple[int, int], limit: float) -> DataFrame:
    """Mean, quarter means, greatest value, exact p95, days over the entity's own reference p90 (strictly) and at or over a limit."""
    bar = daily.where(F.col(year).between(*reference)).groupBy(entity).agg(F.percentile(value, 0.9).alias("_p90"))
    joined = daily.join(bar, entity)  # entities without reference years have no threshold and no rows
    v = F.col(value)
    quarters = [F.avg(F.when(F.col(quarter) == q, v)).alias(f"mean_q{q}") for q in (1, 2, 3, 4)]
    return joined.groupBy(entity, year).agg(
        F.count("*").alias("n_days"), F.avg(v).alias("mean"), *quarters, F.max(v).alias("highest"), F.percentile(value, 0.95).alias("p95"),
        F.count_if(v > F.col("_p90")).alias("days_over_p90"), F.count_if(v >= limit).alias("days_over_limit"))


def climatology_anomaly(df: DataFrame, keys: list[str], season: str, value: str) -> DataFrame:
    """anomaly from the mean of the season over all years, and level: anomaly plus the equal-weight mean of the seasons."""
    by = df.groupBy(*keys, season).agg(F.avg(value).alias("_normal"))
    level = by.withColumn("_level", F.avg("_normal").over(W.partitionBy(*keys)))
    out = df.join(level, [*keys, season])
    return out.withColumn("anomaly", F.col(value) - F.col("_normal")).withColumn("deseasoned", F.col("anomaly") + F.col("_level")).drop("_normal", "_level")


def driest_start(monthly: DataFrame, key: str, month: str, value: str, width: int = 3) -> DataFrame:
    """First month (1 to 12) of the circular run of `width` months of least sum; the earliest at ties. Needs twelve months."""
    rows = monthly.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(month).alias("m"), F.col(value).alias("v")))).alias("_a")).where(F.size("_a") == 12)
    sums = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(sum((F.element_at("_a", (i + k) % 12 + 1)["v"] for k in range(1, width)), F.element_at("_a", i + 1)["v"]).alias("s"), (i + 1).alias("start")))
    return rows.select(key, F.array_min(sums)["start"].alias("start"))


def in_season(month: Column, start: Column, width: int = 3) -> Column:
    return F.pmod(month - start, F.lit(12)) < width


def weighted_mean(value: Column, weight: Column) -> Column:
    known = F.when(value.isNotNull(), weight)
    return F.try_divide(F.sum(value * weight), F.when(F.sum(known) != 0, F.sum(known)))


def exact_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value, the smallest at ties, by counting."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias("mode"))


def block_means(df: DataFrame, x: str, y: str, side: float, value: str) -> DataFrame:
    """Means over square blocks with missing cells as zero: a share of the block, not of what is known."""
    return df.groupBy(F.floor(F.col(x) / side).alias("bx"), F.floor(F.col(y) / side).alias("by")).agg(F.avg(F.coalesce(F.col(value), F.lit(0.0))).alias("mean"), F.count("*").alias("cells"))


def coverage(df: DataFrame) -> DataFrame:
    """By column the number of nulls and the share of known values, from one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns], *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"s_{c}") for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("nulls"), F.col(f"s_{c}").alias("known")) for c in df.columns]))
    return one.select(rows.alias("r")).select("r.*")


def describe(df: DataFrame, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high"))
    return one.select("n", "mean", "std", "low", *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "high")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def paired(series: DataFrame, keys: list[str], name: str, value: str, left: str, right: str) -> DataFrame:
    """Two named series side by side, on keys where both are known."""
    one = lambda n: series.where(F.col(name) == n).select(*keys, F.col(value).alias(n))
    return one(left).join(one(right), keys)


def two_sided_indicators(days: DataFrame, entity: str, high: str, low: str, reference: tuple[int, int], warm_day: float, warm_night: float) -> DataFrame:
    """Thirteen indicators a year of days (entity, year, quarter, high, low), thresholds by entity from its reference years."""
    bar = days.where(F.col("year").between(*reference)).groupBy(entity).agg(F.percentile(high, 0.9).alias("_h"), F.percentile(low, 0.9).alias("_l"))
    mean = (F.col(high) + F.col(low)) / 2
    quarters = [F.avg(F.when(F.col("quarter") == q, mean)).alias(f"mean_q{q}") for q in (1, 2, 3, 4)]
    return days.join(bar, entity).groupBy(entity, "year").agg(
        F.count("*").alias("n_days"), F.avg(mean).alias("mean"), F.avg(F.col(high) - F.col(low)).alias("amplitude"), *quarters, F.max(high).alias("highest"), F.min(low).alias("lowest"), F.percentile(high, 0.95).alias("p95"),
        F.count_if(F.col(high) > F.col("_h")).alias("hot_days"), F.count_if(F.col(low) > F.col("_l")).alias("hot_nights"),
        F.count_if(F.col(high) >= warm_day).alias("days_over_limit"), F.count_if(F.col(low) >= warm_night).alias("nights_over_limit"))


def gap_filled(df: DataFrame, keys: list[str], season: str, value: str) -> DataFrame:
    """filled: the value, or where it is missing the mean of its season over all years; was_filled says which."""
    normal = df.groupBy(*keys, season).agg(F.avg(value).alias("_normal"))
    out = df.join(normal, [*keys, season])
    return out.withColumn("filled", F.coalesce(value, "_normal")).withColumn("was_filled", F.col(value).isNull().cast("int")).drop("_normal")
