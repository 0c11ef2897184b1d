"""Fixed effects, least squares and covariances that allow for clusters and distance.

Only sums over rows (k by k numbers) reach the driver; the data stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unbalanced_groups(df: DataFrame, entity: str, group: str, period: str) -> DataFrame:
    """The groups that lack one of their entities in one of their periods, or have it twice."""
    n = df.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("e"), F.count_distinct(period).alias("p"))
    return n.where("n <> e * p").select(group)


def residuals_balanced(df: DataFrame, entity: str, group: str, period: str, columns: list[str]) -> DataFrame:
    """Closed form for entities nested in groups, balanced inside each: x - entity mean - (group, period) mean + group mean.

    Means are combined before they are shuffled, and joined back: no task sorts a group.
    """
    out = df
    for keys, name in (([group, entity], "_e"), ([group, period], "_t"), ([group], "_g")):
        means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"{name}{c}") for c in columns])
        out = out.join(means, keys)
    return out.select(*df.columns, *[(F.col(c) - F.col(f"_e{c}") - F.col(f"_t{c}") + F.col(f"_g{c}")).alias(f"{c}_res") for c in columns])


def residuals_iterated(df: DataFrame, entity: str, group: str, period: str, columns: list[str], rounds: int | None = None, tolerance: float = 1e-10) -> DataFrame:
    """Alternating projections inside each group, until a round moves nothing by more than tolerance, or a set number of rounds.

    Groups share no effect, so each is solved by itself; a group must fit a
    task, which nested groups of entities do.
    """
    extra = [f"{c}_res" for c in columns]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + "".join(f", `{c}` double" for c in extra)

    def solve(pdf):
        x = pdf[columns].to_numpy(float)
        x = x - x.mean(0)
        codes = [np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in (entity, period)]
        for _ in range(rounds or 10_000):
            old = x
            for code in codes:
                n = np.bincount(code)[:, None]
                means = np.stack([np.bincount(code, weights=x[:, k]) for k in range(x.shape[1])], 1) / n
                x = x - means[code]
            if rounds is None and np.abs(x - old).max() <= tolerance:
                break
        return pdf.assign(**{c: x[:, k] for k, c in enumerate(extra)})

    return df.groupBy(group).applyInPandas(solve, schema)


def residuals(df: DataFrame, entity: str, group: str, period: str, columns: list[str]) -> DataFrame:
    """By group the closed form where it is balanced, else the iteration."""
    df = df.na.drop(subset=columns)
    holes = unbalanced_groups(df, entity, group, period)
    if holes.isEmpty():
        return residuals_balanced(df, entity, group, period, columns)
    whole = residuals_balanced(df.join(holes, group, "left_anti").select(*df.columns), entity, group, period, columns)
    return whole.unionByName(residuals_iterated(df.join(holes, group, "left_semi").select(*df.columns), entity, group, period, columns))


def ols(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, inverse of X'X and rows, from one aggregation of the cross products."""
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    row = df.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs], *[F.sum(F.col(a) * F.col(y)).alias(f"{a}|y") for a in xs]).head()
    xx = np.array([[row[f"{a}|{b}"] if f"{a}|{b}" in row.asDict() else row[f"{b}|{a}"] for b in xs] for a in xs], float)
    inverse = np.linalg.inv(xx)
    return inverse @ np.array([row[f"{a}|y"] for a in xs], float), inverse, row["n"]


def scores(df: DataFrame, y: str, xs: list[str], beta: np.ndarray) -> DataFrame:
    error = F.col(y) - sum((float(b) * F.col(x) for b, x in zip(beta, xs, strict=True)), F.lit(0.0))
    return df.withColumn("_e", error).withColumns({f"u_{x}": F.col(x) * F.col("_e") for x in xs}).drop("_e")


def _outer(df: DataFrame, us: list[str], vs: list[str]) -> np.ndarray:
    row = df.agg(*[F.sum(F.col(u) * F.col(v)).alias(f"{i}_{j}") for i, u in enumerate(us) for j, v in enumerate(vs)]).head()
    return np.array([[row[f"{i}_{j}"] or 0.0 for j in range(len(vs))] for i in range(len(us))], float)


def entity_sums(u: DataFrame, entity: str, xs: list[str]) -> tuple[np.ndarray, int]:
    """Sum over entities of the outer products of their summed scores, and the entities, from one pass."""
    names = [f"u_{x}" for x in xs]
    sums = u.groupBy(entity).agg(*[F.sum(n).alias(n) for n in names])
    row = sums.agg(F.count("*").alias("g"), *[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]).head()
    return np.array([[row[f"{i}_{j}"] or 0.0 for j in range(len(xs))] for i in range(len(xs))], float), row["g"]


def cluster_covariance(u: DataFrame, entity: str, xs: list[str], inverse: np.ndarray) -> np.ndarray:
    """Sandwich with scores summed by entity, times G / (G - 1)."""
    meat, g = entity_sums(u, entity, xs)
    return inverse @ meat @ inverse * (g / (g - 1) if g > 1 else np.nan)


def conley_covariance(u: DataFrame, pairs: DataFrame, entity: str, period: str, xs: list[str], inverse: np.ndarray, by_entity: np.ndarray | None = None) -> np.ndarray:
    """Sandwich of scores of one period weighted by distance (pairs i, j, w; own weight 1), plus an entity's scores of different periods."""
    names = [f"u_{x}" for x in xs]
    left = u.select(F.col(entity).alias("i"), period, *names)
    right = u.select(F.col(entity).alias("j"), period, *[F.col(n).alias(f"r_{n}") for n in names])
    both = pairs.where("i <> j").join(left, "i").join(right, ["j", period]).withColumns({n: F.col(n) * F.col("w") for n in names})
    # an entity's own scores of one period are in its sums, too: they cancel
    meat = _outer(both, names, [f"r_{n}" for n in names]) + (entity_sums(u, entity, xs)[0] if by_entity is None else by_entity)
    return inverse @ meat @ inverse


def lag_summary(curve: DataFrame, keys: list[str], lag, cumulative: str) -> DataFrame:
    """By keys, of cumulative responses b_k over lags: mean lag sum k (b_k - b_k-1) / sum (null if they add up to nothing), whether the response never falls, the lag of its greatest size (the first at ties)."""
    b = F.array_sort(F.collect_list(F.struct(lag.alias("k"), F.col(cumulative).alias("b"))))
    rows = curve.groupBy(*keys).agg(b.alias("_b"), F.max_by(lag, F.struct(F.abs(cumulative), -lag)).alias("peak"))
    steps = F.transform("_b", lambda x, i: F.struct(x["k"].alias("k"), (x["b"] - F.when(i > 0, F.element_at("_b", F.greatest(i, F.lit(1)))["b"]).otherwise(0.0)).alias("d")))
    total = lambda f: F.aggregate("_d", F.lit(0.0), lambda s, x: s + f(x))
    rows = rows.withColumn("_d", steps).withColumn("_s", total(lambda x: x["d"]))
    mean = F.when(F.abs("_s") > 1e-12, total(lambda x: x["k"] * x["d"]) / F.col("_s"))
    rising = F.forall(F.slice("_d", F.lit(2), F.greatest(F.size("_d") - 1, F.lit(0))), lambda x: x["d"] >= 0)
    return rows.select(*keys, mean.alias("mean_lag"), rising.alias("monotone"), F.when(rising, mean).alias("mean_lag_if_monotone"), "peak")


def mean_lag(cumulative: list[float]) -> float | None:
    """Mean lag of a cumulative response: sum k b_k / sum b_k over its increments; None if they add up to nothing."""
    b = np.diff(np.array([0.0, *cumulative]))
    return float(np.arange(len(b)) @ b / b.sum()) if abs(b.sum()) > 1e-12 else None


@dataclass(frozen=True)
class Spec:
    """A model: its outcome, regressors, sample, years (both included) and the group whose periods are effects (None: the caller's)."""

    name: str
    y: str
    xs: tuple[str, ...]
    where: str = "true"
    years: tuple[int, int] | None = None
    group: str | None = None


def run_specs(df: DataFrame, specs: list[Spec], entity: str, group: str, period: str, pairs: DataFrame | None = None) -> DataFrame:
    """A row for each specification and regressor: model, y, variable, coef, se_cluster, t, se_conley (null without pairs or if negative), n_obs, n_entities.

    A specification that names a column which the table lacks is left out.
    """
    rows = []
    for s in specs:
        xs = list(s.xs)
        if not {s.y, *xs} <= set(df.columns):
            continue
        sample = df.where(s.where).where(F.col(period).between(*s.years)) if s.years else df.where(s.where)
        d = residuals(sample, entity, s.group or group, period, [s.y, *xs])
        d = d.select(entity, period, *[F.col(f"{c}_res").alias(c) for c in (s.y, *xs)]).persist()  # read by each aggregate below
        try:
            beta, inverse, n = ols(d, s.y, xs)
            u = scores(d, s.y, xs, beta)
            meat, g = entity_sums(u, entity, xs)
            cluster = np.diag(inverse @ meat @ inverse * (g / (g - 1) if g > 1 else np.nan))
            conley = np.diag(conley_covariance(u, pairs, entity, period, xs, inverse, meat)) if pairs is not None else np.full(len(xs), np.nan)
        finally:
            d.unpersist()
        for k, x in enumerate(xs):
            se, sc = (float(np.sqrt(v[k])) if v[k] >= 0 else None for v in (cluster, conley))
            rows.append((s.name, s.y, x, float(beta[k]), se, float(beta[k]) / se if se and se > 1e-9 else None, sc, n, g))
    return df.sparkSession.createDataFrame(rows, "model string, y string, variable string, coef double, se_cluster double, t double, se_conley double, n_obs long, n_entities long")
