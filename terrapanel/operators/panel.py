"""Balanced panels: skeletons, lags, bands, steps, imputation, reshaping and shares.

Lags count rows, so a panel is completed with skeleton() before they are taken.
All windows of a call share one partitioning and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import gains, labelled, losses, percent


def skeleton(entities: DataFrame, periods: DataFrame) -> DataFrame:
    """Every entity in every period; periods are few, so each entity row carries them as an array."""
    names = periods.columns
    every = periods.distinct().agg(F.collect_list(F.struct(*names)).alias("_p"))
    return entities.crossJoin(F.broadcast(every)).withColumn("_p", F.explode("_p")).select(*entities.columns, *[F.col(f"_p.{c}").alias(c) for c in names])


def order(entity: str, period: str):
    return W.partitionBy(entity).orderBy(period)


def changes(df: DataFrame, entity: str, period: str, value: str, step: int = 1) -> DataFrame:
    d = F.col(value) - F.lag(value, step).over(order(entity, period))
    return df.withColumn("change", d).withColumns({"loss": losses(F.col("change")), "gain": gains(F.col("change"))})


def lags_leads(df: DataFrame, entity: str, period: str, value: str, lags: int, leads: int) -> DataFrame:
    w = order(entity, period)
    return df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in range(lags + 1)} | {f"lead_{k}": F.lead(value, k).over(w) for k in range(1, leads + 1)})


def lag_bands(df: DataFrame, entity: str, period: str, value: str, bands: list[tuple[int, int]]) -> DataFrame:
    """Sums over bands of lags; null unless all lags of a band are known."""
    w = order(entity, period)
    return df.withColumns({f"band_{a}_{b}": sum((F.lag(value, k).over(w) for k in range(a + 1, b + 1)), F.lag(value, a).over(w)) for a, b in bands})


def cumulative_endpoint(df: DataFrame, entity: str, period: str, value: str, lag: int) -> DataFrame:
    """Sum of everything at least so many rows ago."""
    return df.withColumn("endpoint", F.sum(value).over(order(entity, period).rowsBetween(W.unboundedPreceding, -lag)))


def group_anomaly(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value minus the mean of its group, which is combined before the shuffle and joined back."""
    means = df.groupBy(*[F.col(k).alias(f"_k{k}") for k in keys]).agg(F.avg(value).alias("_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys]
    return df.join(means, same).select(*df.columns, (F.col(value) - F.col("_mean")).alias("anomaly"))


def largest_step(df: DataFrame, entity: str, period: str, value: str, width: int, flag_over: float) -> DataFrame:
    """By entity the change of greatest size between the mean of the next and of the last `width` periods.

    Frames are by period, not by row; only periods with whole frames inside the
    table's range count; the earliest of equal steps wins. The step is rounded
    to two places before it is held against flag_over.
    """
    w = order(entity, period)
    ahead, back = F.avg(value).over(w.rangeBetween(0, width - 1)), F.avg(value).over(w.rangeBetween(-width, -1))
    ends = df.agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    steps = df.withColumn("_d", ahead - back).crossJoin(F.broadcast(ends)).where(F.col(period).between(F.col("_lo") + width, F.col("_hi") - width + 1))
    best = F.round(F.max_by("_d", F.struct(F.abs("_d"), -F.col(period))), 2)
    return steps.where("_d is not null").groupBy(entity).agg(best.alias("step")).withColumn("flagged", (F.abs("step") > flag_over).cast("int"))


def impute_children(df: DataFrame, key: str, parent_of: DataFrame) -> DataFrame:
    """Rows of parents copied under the keys of their children (child, parent), which have no rows of their own; imputed says which.

    A parent without rows is an error, raised when the rows are read.
    """
    columns = [c for c in df.columns if c != key]
    there = df.select(F.col(key).alias("parent")).distinct().withColumn("_there", F.lit(True))
    pairs = parent_of.join(there, "parent", "left")
    known = pairs.withColumn("child", F.when(F.col("_there"), F.col("child")).otherwise(F.raise_error(F.concat(F.lit("no rows of parent "), F.col("parent")))))
    copied = known.join(df, known["parent"] == df[key], "left").select(F.col("child").alias(key), *columns, F.lit(1).alias("imputed"))
    own = df.join(parent_of.select(F.col("child").alias(key)), key, "left_anti").withColumn("imputed", F.lit(0))
    return own.unionByName(copied)


def class_shares(df: DataFrame, keys: list[str], code: str, area: str, classes: dict[str, list[int]]) -> DataFrame:
    """Total area, area by set of class codes, and each set's percentage."""
    area_of = {n: F.sum(F.when(F.col(code).isin(c), F.col(area)).otherwise(0.0)) for n, c in classes.items()}
    out = df.groupBy(*keys).agg(F.sum(area).alias("total"), *[v.alias(n) for n, v in area_of.items()])
    return out.withColumns({f"{n}_pct": percent(F.col(n), F.col("total")) for n in classes})


def main_category(df: DataFrame, key: str, category: str, weight: str) -> DataFrame:
    """By key the category of greatest weight (the first by name at ties) and its share."""
    sums = df.groupBy(key, category).agg(F.sum(weight).alias("_w"))
    shares = sums.withColumn("_s", F.try_divide(F.col("_w"), F.sum("_w").over(W.partitionBy(key))))
    return shares.groupBy(key).agg(F.max(F.struct("_w", "_s")).alias("_m"), F.collect_set(F.struct("_w", category)).alias("_all")).select(
        key, F.array_min(F.transform(F.filter("_all", lambda x: x["_w"] == F.col("_m._w")), lambda x: x[category])).alias("main"), F.col("_m._s").alias("share"))


def unpivot_periods(df: DataFrame, keys: list[str], columns: dict[str, int], period: str, value: str) -> DataFrame:
    """Columns named for periods as rows; missing values stay as rows."""
    long = df.unpivot(keys, list(columns), "_name", value)
    return long.select(*keys, labelled(F.col("_name"), columns).alias(period), value)


def pivot_names(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Names as columns (means of repeats); keys without any value go."""
    out = df.groupBy(*keys).pivot(name, names).agg(F.avg(value))
    return out.where(" or ".join(f"`{n}` is not null" for n in names))


def first_by(df: DataFrame, keys: list[str], ordering: list[Column | str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*ordering))).where("_n = 1").drop("_n")


def pivot_unique(df: DataFrame, keys: list[str], name: str, value: str, names: list) -> DataFrame:
    """Names as columns, where a key and name that come twice are an error."""
    one = F.when(F.count(F.lit(1)) <= 1, F.first(value)).otherwise(F.raise_error(F.lit("repeated key in a pivot")).cast("double"))
    return df.groupBy(*keys).pivot(name, names).agg(one)


def pivot_sum(df: DataFrame, keys: list[str], name: str, value: str, names: list) -> DataFrame:
    """Names as columns with sums; zero where there are no rows."""
    return df.groupBy(*keys).pivot(name, names).agg(F.sum(value)).na.fill(0, [str(n) for n in names])


def unpivot_bands(df: DataFrame, keys: list[str], pattern: str = r"^(.*)_(\d{4})$") -> DataFrame:
    """Columns named variable_year as rows (keys, variable, period, value)."""
    import re

    found = {c: re.match(pattern, c) for c in df.columns if c not in keys}
    long = df.unpivot(keys, [c for c, m in found.items() if m], "_name", "value")
    return long.select(*keys, F.regexp_extract("_name", pattern, 1).alias("variable"), F.regexp_extract("_name", pattern, 2).cast("int").alias("period"), "value")


def keep_existing(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of order that the table has, in that order."""
    return df.select(*[c for c in order if c in df.columns])


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def lagged_join(df: DataFrame, other: DataFrame, keys: list[str], period: str, lag: int = 1) -> DataFrame:
    """df left-joined with other's columns of `lag` periods earlier."""
    names = {c: f"{c}_lag{lag}" for c in other.columns if c not in [*keys, period]}
    return df.join(other.withColumn(period, (F.col(period) + lag).cast(dict(df.dtypes)[period])).withColumnsRenamed(names), [*keys, period], "left")
