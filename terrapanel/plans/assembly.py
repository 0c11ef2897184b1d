"""Queries that assemble the panel and the model: left chains, reshaping, the model's base, specifications, contrasts and lag curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import panel as P
from ..operators import regression as R
from ..operators import series as I
from ..operators import spatial as G
from ..sources.io import read_table, schema_of
from . import tables as T
from .queries import _PAIRS, D_, M_, P_, X_, _dry, _pairs, query, rounded

_BY = "OVER (PARTITION BY e ORDER BY t)"
_STEP = """, sr AS (SELECT *, avg(x) OVER (PARTITION BY e ORDER BY t RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) - avg(x) OVER (PARTITION BY e ORDER BY t RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS st FROM p)
, sb AS (SELECT e, round(first(st ORDER BY abs(st) DESC, t), 2) AS step FROM sr WHERE st IS NOT NULL AND t BETWEEN (SELECT min(t) + 2 FROM p) AND (SELECT max(t) - 1 FROM p) GROUP BY e)"""
_CLIMATE = ", d0 AS (SELECT g, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS v FROM lineitem JOIN s ON l_suppkey = e GROUP BY 1, 2), cl AS (SELECT g, CAST(year(day) AS INTEGER) AS t, round(avg(v), 6) AS clim FROM d0 WHERE year(day) < 2001 GROUP BY 1, 2)"


@query(P_ + _CLIMATE + _STEP + " SELECT p.e, p.t, y, clim, step, CAST(abs(step) > 150 AS INTEGER) AS flagged FROM p LEFT JOIN cl ON cl.g = p.g AND cl.t = p.t LEFT JOIN sb ON sb.e = p.e")
def panel_climate_steps(spark, d):
    """The panel with climate by two keys and steps by one, both left; years without climate stay."""
    p = T.panel(spark, d)
    clim = T.daily(spark, d).where("yr < 2001").groupBy("g", F.col("yr").alias("t")).agg(F.round(F.avg("v"), 6).alias("clim"))
    out = p.join(clim, ["g", "t"], "left").join(P.largest_step(p, "e", "t", "x", 2, 150.0), "e", "left")
    return out.select("e", "t", "y", "clim", "step", "flagged")


@query(M_ + """, yr AS (SELECT nation, yr, sum(v) AS total FROM m GROUP BY 1, 2), b AS (SELECT CAST(user_id % 25 AS INTEGER) AS nation, CAST(1995 + user_id % 7 AS INTEGER) AS yr, round(avg(value), 6) AS band FROM events GROUP BY 1, 2)
, c AS (SELECT nation, mo, sum(v) AS v FROM m GROUP BY 1, 2), w AS (SELECT a.nation, a.mo AS start, sum(b.v) AS s FROM c a JOIN c b ON a.nation = b.nation AND (b.mo - a.mo + 12) % 12 < 3 GROUP BY 1, 2), k AS (SELECT nation FROM c GROUP BY 1 HAVING count(*) = 12), f AS (SELECT nation, first(start ORDER BY s, start) AS start FROM w WHERE nation IN (SELECT nation FROM k) GROUP BY 1)
SELECT yr.nation, yr.yr, total, band, start FROM yr LEFT JOIN b ON b.nation = yr.nation AND b.yr = yr.yr LEFT JOIN f ON f.nation = yr.nation""")
def panel_bands_dry(spark, d):
    """The panel with satellite bands by two keys and the dry season's first month by one."""
    y = T.monthly(spark, d).groupBy("nation", "yr").agg(F.sum("v").alias("total"))
    b = read_table(spark, d, "events", ["user_id", "value"]).groupBy((F.col("user_id") % 25).cast("int").alias("nation"), (1995 + F.col("user_id") % 7).cast("int").alias("yr")).agg(F.round(F.avg("value"), 6).alias("band"))
    return y.join(b, ["nation", "yr"], "left").join(_dry(spark, d), "nation", "left").select("nation", "yr", "total", "band", "start")


@query(X_ + " SELECT s_suppkey AS e, n_name, r_name, x, y, n_parts FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 1) ON n_regionkey = r_regionkey LEFT JOIN pt ON pt.id = s_suppkey LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey")
def base_table(spark, d):
    """Entities with names, places and counts from four tables, each left-joined."""
    s = read_table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    n, r = read_table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"]), read_table(spark, d, "region", ["r_regionkey", "r_name"]).where("r_regionkey <> 1")
    c = read_table(spark, d, "lineitem", ["l_suppkey", "l_partkey", "l_quantity"]).where("l_quantity > 49").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts"))
    out = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    out = out.join(T.points(spark, d), out["s_suppkey"] == F.col("id"), "left").join(c, s["s_suppkey"] == c["l_suppkey"], "left")
    return out.select(F.col("s_suppkey").alias("e"), "n_name", "r_name", "x", "y", "n_parts")


_NEAR = ", nb AS (SELECT i AS e, t, sum(x) AS ring, count(*) AS n_ring FROM (SELECT i, j FROM pr WHERE i <> j AND d < 0.1) JOIN p ON p.e = j GROUP BY 1, 2)"
_MODEL = f"""{P_}, {T.POINTS_SQL}{_PAIRS}{_NEAR}, ch AS (SELECT *, x - lag(x) {_BY} AS dx FROM p), lg AS (SELECT *, CASE WHEN dx IS NOT NULL THEN greatest(-dx, 0) END AS loss, CASE WHEN dx IS NOT NULL THEN greatest(dx, 0) END AS gain FROM ch)
, mb AS (SELECT e, g, t, y, """ + ", ".join(f"lag(loss, {k}) {_BY} AS loss_{k}, lag(gain, {k}) {_BY} AS gain_{k}" for k in range(4)) + ", " + ", ".join(f"lead(loss, {k}) {_BY} AS lead_{k}" for k in range(1, 4)) + """,
 sum(loss) OVER (PARTITION BY e ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS endpoint, """ + ", ".join("+".join(f"lag(loss, {k}) {_BY}" for k in range(a, b + 1)) + f" AS band_{a}_{b}" for a, b in ((0, 2), (3, 5), (6, 10))) + " FROM lg)"


@query(_MODEL + " SELECT mb.*, s.nation, ring AS ring_lag1, n_ring AS n_ring_lag1 FROM mb LEFT JOIN s ON s.e = mb.e LEFT JOIN nb ON nb.e = mb.e AND nb.t = mb.t - 1")
def model_base(spark, d):
    """The model's table: losses and gains at four lags, leads, endpoint, three bands, the fixed category, and the neighbours' sums a period before."""
    p = T.panel(spark, d)
    c = P.changes(p, "e", "t", "x").drop("x", "z", "change")
    w = P.order("e", "t")
    lags = {f"{n}_{k}": F.lag(n, k).over(w) for n in ("loss", "gain") for k in range(4)} | {f"lead_{k}": F.lead("loss", k).over(w) for k in range(1, 4)}
    base = P.cumulative_endpoint(P.lag_bands(c.withColumns(lags), "e", "t", "loss", [(0, 2), (3, 5), (6, 10)]), "e", "t", "loss", 4).drop("loss", "gain")
    near = _pairs(spark, d).where("i <> j and d < 0.1").select(F.col("i"), F.col("j").alias("e")).join(p.select("e", "t", "x"), "e")
    near = near.groupBy(F.col("i").alias("e"), "t").agg(F.sum("x").alias("ring"), F.count("*").alias("n_ring"))
    return P.lagged_join(base.join(T.suppliers(spark, d).select("e", "nation"), "e", "left"), near, ["e"], "t")


def _res(name: str, where: str, group: str) -> str:
    r = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY e) - avg({c}) OVER (PARTITION BY {group}, t) + avg({c}) OVER (PARTITION BY {group}) AS {c}" for c in "yx")
    return f", {name}r AS (SELECT e, t, {r} FROM p WHERE {where}), {name}b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n FROM {name}r), {name}c AS (SELECT e, sum(x * (y - b * x)) AS u FROM {name}r, {name}b GROUP BY e), {name}o AS (SELECT b, sqrt((SELECT sum(u * u) * count(*) / (count(*) - 1) FROM {name}c)) / xx AS se, n, (SELECT count(*) FROM {name}c) AS g FROM {name}b)"


_MODELS = {"all": ("true", "g"), "late": ("t BETWEEN 1996 AND 2000", "g"), "two_groups": ("g IN (0, 1) AND t BETWEEN 1995 AND 1999", "g"), "one_effect": ("true", "one")}


@query(P_.replace("SELECT e, g, t, y, x, z FROM p0", "SELECT e, g, t, y, x, z, 1 AS one FROM p0") + "".join(_res(f"m{i}", w, g) for i, (w, g) in enumerate(_MODELS.values())) + " " + " UNION ALL ".join(f"SELECT '{n}' AS model, 'x' AS variable, round(b, 6) AS coef, round(se, 6) AS se_cluster, CASE WHEN se > 1e-9 THEN round(b / se, 5) END AS t, n AS n_obs, g AS n_entities FROM m{i}o" for i, n in enumerate(_MODELS)))
def spec_table(spark, d):
    """A declared list of models with samples, years and effect keys; the one that needs an absent column is left out."""
    p = T.panel(spark, d).withColumn("one", F.lit(1))
    specs = [R.Spec("all", "y", ("x",)), R.Spec("late", "y", ("x",), years=(1996, 2000)), R.Spec("two_groups", "y", ("x",), "g IN (0, 1)", (1995, 1999)), R.Spec("one_effect", "y", ("x",), group="one"), R.Spec("rings", "y", ("ring_share",))]
    return R.run_specs(p, specs, "e", "g", "t").select("model", "variable", F.round("coef", 6).alias("coef"), F.round("se_cluster", 6).alias("se_cluster"), F.round("t", 5).alias("t"), "n_obs", "n_entities")


_VERSIONS = P_ + f", v0 AS (SELECT e, g, t, x, z, y AS y_plain, lag(y) {_BY} AS y_lag, CASE WHEN z > 20 THEN y * 0.5 + x END AS y_mixed FROM p), v AS (SELECT * FROM v0 WHERE y_plain IS NOT NULL AND y_lag IS NOT NULL AND y_mixed IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL), l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS version, g, y_{n} AS y, x, z FROM v" for n in ("plain", "lag", "mixed")) + ")"


@query(_VERSIONS + ", c AS (SELECT version, g, count(*) AS n, stddev_samp(y) AS sd, corr(y, x) AS xy, corr(y, z) AS yz, corr(x, z) AS xz FROM l GROUP BY GROUPING SETS ((version, g), (version))) SELECT version, g, n, round(sd, 4) AS sd, round(xy, 6) AS r, round((xy - yz * xz) / sqrt((1 - yz * yz) * (1 - xz * xz)), 5) AS partial FROM c")
def contrast_table(spark, d):
    """Versions of the outcome, by region and over all, on the rows where every version is known: deviation, correlation and partial correlation."""
    p = T.panel(spark, d)
    v = p.withColumns({"y_plain": F.col("y"), "y_lag": F.lag("y").over(P.order("e", "t")), "y_mixed": F.when(F.col("z") > 20, F.col("y") * 0.5 + F.col("x"))}).na.drop(subset=["y_plain", "y_lag", "y_mixed", "x", "z"])
    long = v.unpivot(["g", "x", "z"], ["y_plain", "y_lag", "y_mixed"], "version", "yv").withColumn("version", F.substring("version", 3, 10))
    c = long.groupingSets([["version", "g"], ["version"]], "version", "g").agg(F.count("*").alias("n"), F.stddev_samp("yv").alias("sd"), S.guarded_corr("yv", "x").alias("xy"), S.guarded_corr("yv", "z").alias("yz"), S.guarded_corr("x", "z").alias("xz"))
    return c.select("version", "g", "n", F.round("sd", 4).alias("sd"), F.round("xy", 6).alias("r"), F.round(S.partial_corr(F.col("xy"), F.col("yz"), F.col("xz")), 5).alias("partial"))


@query(P_ + f", l AS (SELECT g, y, " + ", ".join(f"lag(x, {k}) {_BY} AS x{k}" for k in range(5)) + " FROM p), c AS (" + " UNION ALL ".join(f"SELECT g, {k} AS k, round(corr(y, x{k}), 9) AS b FROM l GROUP BY g" for k in range(5)) + """)
, i AS (SELECT *, b - coalesce(lag(b) OVER (PARTITION BY g ORDER BY k), 0) AS db FROM c), a AS (SELECT g, CASE WHEN abs(sum(db)) > 1e-12 THEN sum(k * db) / sum(db) END AS ml, bool_and(k = 0 OR db >= 0) AS mono, first(k ORDER BY abs(b) DESC, k) AS peak FROM i GROUP BY g)
SELECT g, round(ml, 5) AS mean_lag, mono AS monotone, CASE WHEN mono THEN round(ml, 5) END AS mean_lag_if_monotone, CAST(peak AS INTEGER) AS peak FROM a""")
def lag_curves(spark, d):
    """By group the response to each lag: mean lag, whether it never falls, and the lag where it is strongest."""
    p = P.lags_leads(T.panel(spark, d), "e", "t", "x", 4, 0)
    c = p.groupBy("g").agg(*[F.round(S.guarded_corr("y", f"lag_{k}"), 9).alias(str(k)) for k in range(5)]).unpivot(["g"], [str(k) for k in range(5)], "k", "b")
    return rounded(R.lag_summary(c, ["g"], F.col("k").cast("int"), "b"), 5)


@query("SELECT c_custkey // 100 AS code, round(avg(c_acctbal), 5) AS mean, count(*) AS n FROM customer GROUP BY 1")
def derived_code_mean(spark, d):
    c = read_table(spark, d, "customer", ["c_custkey", "c_acctbal"])
    return rounded(c.groupBy(F.expr("c_custkey div 100").alias("code")).agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n")), 5)


@query("SELECT p_brand, " + ", ".join(f"CAST(coalesce(sum(p_size) FILTER (WHERE p_container_kind = '{k}'), 0) AS BIGINT) AS {k}" for k in ("low", "high")) + " FROM (SELECT p_brand, p_size, CASE WHEN p_size <= 2 THEN 'low' WHEN p_size >= 49 THEN 'high' ELSE 'mid' END AS p_container_kind FROM part) GROUP BY 1")
def pivot_sum_zero(spark, d):
    p = read_table(spark, d, "part", ["p_brand", "p_size"]).withColumn("kind", F.when(F.col("p_size") <= 2, "low").when(F.col("p_size") >= 49, "high").otherwise("mid"))
    return P.pivot_sum(p, ["p_brand"], "kind", "p_size", ["low", "high"]).select("p_brand", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@query(P_ + " SELECT e, 'sat_' || variable AS variable, period, value FROM (SELECT e, 'y' AS variable, t AS period, y AS value FROM p WHERE t BETWEEN 1996 AND 1998 UNION ALL SELECT e, 'x', t, x FROM p WHERE t BETWEEN 1996 AND 1998)")
def wide_bands(spark, d):
    """Wide columns variable_year, made unique, read back as rows; names get a satellite's prefix."""
    p = T.panel(spark, d)
    wide = [P.pivot_unique(p, ["e"], "t", c, [1996, 1997, 1998]).withColumnsRenamed({str(t): f"{c}_{t}" for t in (1996, 1997, 1998)}) for c in ("y", "x")]
    long = P.unpivot_bands(wide[0].join(wide[1], "e"), ["e"])
    return long.select("e", F.concat(F.lit("sat_"), F.col("variable")).alias("variable"), "period", "value")


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def head_rows(spark, d):
    """An ordered projection of what exists, without a prefix' columns, sorted by two keys: the first twenty."""
    o = P.drop_prefixed(read_table(spark, d, "orders"), "o_order").columns
    rows = P.keep_existing(read_table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "absent", *[c for c in o if c == "o_custkey"]])
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT event_type, CAST(sum(CASE WHEN event_id % 8 IN (1, 3, 5) THEN 1 ELSE 0 END) AS BIGINT) AS coded, event_type || ': ' || count(*) || ' rows, ' || count(DISTINCT user_id) || ' users' AS line FROM events GROUP BY 1")
def code_report(spark, d):
    """Codes remapped to 0 and 1, and a formatted line for each group."""
    e = read_table(spark, d, "events", ["event_id", "event_type", "user_id"]).withColumn("one", (F.col("event_id") % 8).isin(1, 3, 5).cast("int"))
    return e.groupBy("event_type").agg(F.sum("one").alias("coded"), F.format_string("%s: %d rows, %d users", F.col("event_type"), F.count("*"), F.count_distinct("user_id")).alias("line"))


@query("SELECT column_name FROM (DESCRIBE SELECT * FROM lineitem)")
def table_columns(spark, d):
    return schema_of(read_table(spark, d, "lineitem")).select("column_name")


@query(D_ + " SELECT g, yr, round(stddev_samp(v), 5) AS sd FROM d WHERE g NOT IN (1, 2) OR g IS NULL GROUP BY 1, 2")
def not_in_groups(spark, d):
    """A NOT IN list that keeps rows without a key."""
    rows = T.daily(spark, d).where(~F.col("g").isin(1, 2) | F.col("g").isNull())
    return rounded(rows.groupBy("g", "yr").agg(F.stddev_samp("v").alias("sd")), 5)
