"""QUERIES and ORACLE_SQL by name. Floating results are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import panel as P
from ..operators import regression as R
from ..operators import series as I
from ..operators import spatial as G
from ..sources.io import read_table
from . import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df, places: int = 4):
    """Doubles rounded, other columns as they are; no negative zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


P_, M_, D_, X_ = (f"WITH {x}" for x in (T.PANEL_SQL, T.MONTHLY_SQL, T.DAILY_SQL, T.POINTS_SQL))
W_ = "OVER (PARTITION BY e ORDER BY t)"


@query(D_ + """, bar AS (SELECT g, quantile_cont(v, 0.9) AS p90 FROM d WHERE yr BETWEEN 1995 AND 1998 GROUP BY g)
SELECT g, yr, count(*) AS n_days, round(avg(v), 4) AS mean, round(avg(v) FILTER (WHERE q = 1), 4) AS mean_q1, round(avg(v) FILTER (WHERE q = 2), 4) AS mean_q2,
 round(avg(v) FILTER (WHERE q = 3), 4) AS mean_q3, round(avg(v) FILTER (WHERE q = 4), 4) AS mean_q4, round(max(v), 4) AS highest, round(quantile_cont(v, 0.95), 4) AS p95,
 CAST(count(*) FILTER (WHERE v > p90) AS BIGINT) AS days_over_p90, CAST(count(*) FILTER (WHERE v >= 30) AS BIGINT) AS days_over_limit FROM d JOIN bar USING (g) GROUP BY g, yr""")
def annual_indicators(spark, d):
    return rounded(I.annual_indicators(T.daily(spark, d), "g", "yr", "q", "v", (1995, 1998), 30.0))


@query(M_ + """, t AS (SELECT DISTINCT yr, mo FROM m) SELECT CAST(n_nationkey AS INTEGER) AS nation, t.yr, t.mo, v, CASE WHEN n_regionkey < 3 THEN coalesce(v, 0) ELSE v END AS filled
FROM nation CROSS JOIN t LEFT JOIN m ON m.nation = n_nationkey AND m.yr = t.yr AND m.mo = t.mo""")
def panel_skeleton(spark, d):
    m = T.monthly(spark, d)
    n = read_table(spark, d, "nation", ["n_nationkey", "n_regionkey"]).select(F.col("n_nationkey").cast("int").alias("nation"), "n_regionkey")
    out = P.skeleton(n, m.select("yr", "mo")).join(m, ["nation", "yr", "mo"], "left")
    return out.select("nation", "yr", "mo", "v", S.masked_fill(F.col("v"), F.col("n_regionkey") < 3).alias("filled"))


_AREA = "a AS (SELECT g, CAST(year(l_shipdate) AS INTEGER) AS t, CAST(p_size AS INTEGER) AS c, sum(l_quantity) AS a FROM lineitem JOIN part ON l_partkey = p_partkey JOIN s ON l_suppkey = e GROUP BY 1, 2, 3)"


def _areas(spark, d):
    li = read_table(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity"])
    pt = read_table(spark, d, "part", ["p_partkey", "p_size"])
    j = li.join(pt, li["l_partkey"] == pt["p_partkey"]).join(T.suppliers(spark, d), li["l_suppkey"] == F.col("e"))
    return j.groupBy("g", F.year("l_shipdate").alias("t"), F.col("p_size").cast("int").alias("c")).agg(F.sum("l_quantity").alias("a"))


@query(P_ + ", " + _AREA + """ SELECT g, t, sum(a) AS total, sum(CASE WHEN c IN (3, 4, 5, 6, 7, 49) THEN a ELSE 0 END) AS forest, sum(CASE WHEN c IN (11, 12, 13, 50) THEN a ELSE 0 END) AS open,
 round(100 * sum(CASE WHEN c IN (3, 4, 5, 6, 7, 49) THEN a ELSE 0 END) / nullif(sum(a), 0), 4) AS forest_pct, round(100 * sum(CASE WHEN c IN (11, 12, 13, 50) THEN a ELSE 0 END) / nullif(sum(a), 0), 4) AS open_pct FROM a GROUP BY g, t""")
def class_share(spark, d):
    return rounded(P.class_shares(_areas(spark, d), ["g", "t"], "c", "a", {"forest": [3, 4, 5, 6, 7, 49], "open": [11, 12, 13, 50]}))


@query(P_ + ", " + _AREA + ", b AS (SELECT g, c, sum(a) AS a FROM a GROUP BY 1, 2) SELECT g, first(c ORDER BY a DESC, c) AS main, round(max(a) / sum(a), 4) AS share FROM b GROUP BY g")
def category_share_argmax(spark, d):
    return rounded(P.main_category(_areas(spark, d), "g", "c", "a"))




@query(P_ + """ SELECT e, t.t AS t, p.y FROM (SELECT DISTINCT e FROM p) CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS INTEGER) AS t) t LEFT JOIN p USING (e, t)""")
def unpivot_years(spark, d):
    wide = P.pivot_unique(T.panel(spark, d), ["e"], "t", "y", list(range(1995, 2002)))
    wide = wide.withColumnsRenamed({str(t): f"y{t}" for t in range(1995, 2002)})
    return P.unpivot_periods(wide, ["e"], {c: S.year_column(c) for c in wide.columns if S.year_column(c)}, "t", "y")


@query(P_ + """ SELECT e, CAST(right(band, 4) AS INTEGER) AS t, avg(v) FILTER (WHERE left(band, length(band) - 5) = 'y') AS y, avg(v) FILTER (WHERE left(band, length(band) - 5) = 'x') AS x
FROM (SELECT e, 'y_' || t AS band, y AS v FROM p UNION ALL SELECT e, 'x_' || t, x FROM p) GROUP BY 1, 2""")
def band_pivot(spark, d):
    p = T.panel(spark, d)
    bands = p.select("e", F.concat(F.lit("y_"), F.col("t")).alias("band"), F.col("y").alias("v")).unionByName(p.select("e", F.concat(F.lit("x_"), F.col("t")).alias("band"), F.col("x").alias("v")))
    named = bands.select("e", F.expr("right(band, 4)").try_cast("int").alias("t"), F.expr("left(band, length(band) - 5)").alias("name"), "v")
    return P.pivot_names(named, ["e", "t"], "name", "v", ["y", "x"])


@query(P_ + " SELECT c_custkey, n_name, CAST(c_custkey // 10 AS BIGINT) AS key6, s.g FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON s.e = c_custkey // 10")
def derived_key_join(spark, d):
    c, n = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"]), read_table(spark, d, "nation", ["n_nationkey", "n_name"])
    c = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).withColumn("key6", F.expr("c_custkey div 10"))
    s = T.suppliers(spark, d)
    return c.join(s, c["key6"] == s["e"], "left").select("c_custkey", "n_name", "key6", "g")


@query(M_ + ", b AS (SELECT nation, sum(v) AS total FROM m GROUP BY 1) SELECT n_name, nation, total FROM (SELECT * FROM nation WHERE n_regionkey <> 2) RIGHT JOIN b ON n_nationkey = nation")
def right_join_names(spark, d):
    n = read_table(spark, d, "nation").where("n_regionkey <> 2")
    b = T.monthly(spark, d).groupBy("nation").agg(F.sum("v").alias("total"))
    return n.join(b, n["n_nationkey"] == b["nation"], "right").select("n_name", "nation", "total")


@query(P_ + " SELECT coalesce(a.e, b.e) AS e, a.y AS y1996, b.y AS y1999 FROM (SELECT * FROM p WHERE t = 1996 AND x > 200) a FULL JOIN (SELECT * FROM p WHERE t = 1999 AND x > 200) b ON a.e = b.e")
def full_outer_concat(spark, d):
    p = T.panel(spark, d).where("x > 200")
    return p.where("t = 1996").select("e", F.col("y").alias("y1996")).join(p.where("t = 1999").select("e", F.col("y").alias("y1999")), "e", "full_outer")


_SIDES = "WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 10), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-07-01')"


@query(_SIDES + " SELECT k, 'no_order' AS side FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'no_customer' FROM o WHERE k NOT IN (SELECT k FROM c)")
def anti_keys(spark, d):
    """Keys that only one side has: customers of some nations, and buyers of half a year (dates half open)."""
    c = read_table(spark, d, "customer", ["c_custkey", "c_nationkey"]).where("c_nationkey < 10").select(F.col("c_custkey").alias("k"))
    o = S.in_dates(read_table(spark, d, "orders", ["o_custkey", "o_orderdate"]), "o_orderdate", "1996-01-01", "1996-07-01").select(F.col("o_custkey").alias("k")).distinct()
    return c.join(o, "k", "left_anti").withColumn("side", F.lit("no_order")).unionByName(o.join(c, "k", "left_anti").withColumn("side", F.lit("no_customer")))


@query(P_ + " SELECT e, t, y, 0 AS imputed FROM p WHERE e NOT IN (3, 5) UNION ALL SELECT 3, t, y, 1 FROM p WHERE e = 2 UNION ALL SELECT 5, t, y, 1 FROM p WHERE e = 4")
def union_imputed(spark, d):
    children = spark.createDataFrame([(3, 2), (5, 4)], "child long, parent long")
    return P.impute_children(T.panel(spark, d).select("e", "t", "y"), "e", children)


@query("SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY 1")
def first_per_key(spark, d):
    return P.first_by(read_table(spark, d, "nation", ["n_regionkey", "n_name"]), ["n_regionkey"], ["n_name"])


@query(P_ + " SELECT e, t, y FROM p WHERE t = (SELECT max(t) FROM p)")
def latest_period(spark, d):
    p = T.panel(spark, d)
    return p.join(F.broadcast(p.agg(F.max("t").alias("t"))), "t", "left_semi").select("e", "t", "y")


@query(P_ + f", c AS (SELECT e, t, y - lag(y) {W_} AS change, y - lag(y, 5) {W_} AS change_5 FROM p) SELECT e, t, round(change, 4) AS change, round(CASE WHEN change IS NOT NULL THEN greatest(-change, 0) END, 4) + 0 AS loss, round(CASE WHEN change IS NOT NULL THEN greatest(change, 0) END, 4) AS gain, round(change_5, 4) AS change_5 FROM c")
def diff_loss_gain(spark, d):
    out = P.changes(T.panel(spark, d), "e", "t", "y").withColumn("change_5", F.col("y") - F.lag("y", 5).over(P.order("e", "t")))
    return rounded(out.select("e", "t", "change", "loss", "gain", "change_5"))


@query(P_ + " SELECT e, t, " + ", ".join(f"lag(x, {k}) {W_} AS lag_{k}" for k in range(11)) + ", " + ", ".join(f"lead(x, {k}) {W_} AS lead_{k}" for k in range(1, 4)) + " FROM p")
def lags_leads(spark, d):
    return P.lags_leads(T.panel(spark, d), "e", "t", "x", 10, 3).drop("g", "y", "x", "z")


@query(P_ + " SELECT e, t, " + ", ".join("+".join(f"lag(x, {k}) {W_}" for k in range(a, b + 1)) + f" AS band_{a}_{b}" for a, b in ((0, 2), (3, 5))) + " FROM p")
def lag_bands(spark, d):
    return P.lag_bands(T.panel(spark, d), "e", "t", "x", [(0, 2), (3, 5)]).drop("g", "y", "x", "z")


@query(P_ + " SELECT e, t, sum(x) OVER (PARTITION BY e ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS endpoint FROM p")
def cumulative_endpoint(spark, d):
    return P.cumulative_endpoint(T.panel(spark, d), "e", "t", "x", 3).select("e", "t", "endpoint")


@query(P_ + " SELECT e, t, round(y - avg(y) OVER (PARTITION BY g, t), 7) + 0 AS anomaly FROM p")
def group_anomaly(spark, d):
    return rounded(P.group_anomaly(T.panel(spark, d), ["g", "t"], "y").select("e", "t", "anomaly"), 7)


@query(P_ + """, r AS (SELECT *, avg(x) OVER (PARTITION BY e ORDER BY t RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) - avg(x) OVER (PARTITION BY e ORDER BY t RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS s FROM p)
, b AS (SELECT e, round(first(s ORDER BY abs(s) DESC, t), 2) AS step FROM r WHERE s IS NOT NULL AND t BETWEEN (SELECT min(t) + 2 FROM p) AND (SELECT max(t) - 1 FROM p) GROUP BY e) SELECT e, step, CAST(abs(step) > 150 AS INTEGER) AS flagged FROM b""")
def step_detection(spark, d):
    return P.largest_step(T.panel(spark, d), "e", "t", "x", 2, 150.0)


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 35 AND p_retailprice > 1000 THEN p_size END AS p_size, CASE WHEN p_size BETWEEN 5 AND 35 AND p_retailprice > 1000 THEN p_retailprice END AS p_retailprice FROM part")
def range_nulling(spark, d):
    return S.null_unless(read_table(spark, d, "part", ["p_partkey", "p_size", "p_retailprice"]), ["p_size", "p_retailprice"], F.col("p_size").between(5, 35) & (F.col("p_retailprice") > 1000))


@query(D_ + " SELECT g, yr, count(*) AS n, CASE WHEN count(*) >= 365 THEN round(avg(v), 4) END AS mean FROM d GROUP BY 1, 2")
def completeness_rule(spark, d):
    by = T.daily(spark, d).groupBy("g", "yr").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return rounded(S.null_unless(by, ["mean"], F.col("n") >= 365))


@query(P_ + ", c AS (SELECT lag(y, 2) " + W_ + " AS lag2, y FROM p) SELECT 'lag2' AS column_name, CAST(count(*) FILTER (WHERE lag2 IS NULL) AS BIGINT) AS nulls, round(avg(CASE WHEN lag2 IS NULL THEN 0 ELSE 1 END), 4) AS known FROM c UNION ALL SELECT 'y', CAST(count(*) FILTER (WHERE y IS NULL) AS BIGINT), round(avg(CASE WHEN y IS NULL THEN 0 ELSE 1 END), 4) FROM c")
def coverage_report(spark, d):
    return rounded(I.coverage(T.panel(spark, d).select(F.lag("y", 2).over(P.order("e", "t")).alias("lag2"), "y")))


@query("SELECT count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS low, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS high FROM (SELECT l_quantity AS v FROM lineitem)")
def describe(spark, d):
    return rounded(I.describe(read_table(spark, d, "lineitem", ["l_quantity"]), "l_quantity"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def distinct_counts(spark, d):
    return read_table(spark, d, "events", ["event_type", "user_id"]).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query("SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_key_check(spark, d):
    return I.repeated_keys(read_table(spark, d, "lineitem", ["l_partkey", "l_suppkey"]), ["l_partkey", "l_suppkey"])


@query(P_ + " SELECT e, max(x) - min(x) AS spread, CAST(max(x) - min(x) < 200 AS INTEGER) AS steady FROM p GROUP BY 1")
def area_constancy(spark, d):
    return T.panel(spark, d).groupBy("e").agg((F.max("x") - F.min("x")).alias("spread"), (F.max("x") - F.min("x") < 200).cast("int").alias("steady"))


@query(P_ + ", w AS (SELECT y, x, y - avg(y) OVER (PARTITION BY e) AS yw, x - avg(x) OVER (PARTITION BY e) AS xw FROM p) SELECT round(corr(y, x), 6) AS overall, round(corr(yw, xw), 6) AS within FROM w")
def corr_overall_within(spark, d):
    p = P.group_anomaly(T.panel(spark, d), ["e"], "y").withColumnRenamed("anomaly", "yw")
    p = P.group_anomaly(p, ["e"], "x").withColumnRenamed("anomaly", "xw")
    return rounded(p.agg(S.guarded_corr("y", "x").alias("overall"), S.guarded_corr("yw", "xw").alias("within")), 6)


@query(P_ + ", c AS (SELECT g, corr(y, x) AS xy, corr(y, z) AS yz, corr(x, z) AS xz FROM p GROUP BY g) SELECT g, round(xy, 6) AS plain, round((xy - yz * xz) / sqrt((1 - yz * yz) * (1 - xz * xz)), 5) AS partial FROM c")
def partial_corr(spark, d):
    c = T.panel(spark, d).groupBy("g").agg(S.guarded_corr("y", "x").alias("xy"), S.guarded_corr("y", "z").alias("yz"), S.guarded_corr("x", "z").alias("xz"))
    return c.select("g", F.round("xy", 6).alias("plain"), F.round(S.partial_corr(F.col("xy"), F.col("yz"), F.col("xz")), 5).alias("partial"))


@query(P_ + ", b AS (SELECT g, t, avg(y) AS y FROM p GROUP BY 1, 2) SELECT g, round(regr_slope(y, t) * 10, 4) AS per_decade FROM b GROUP BY g")
def trend_slope(spark, d):
    return rounded(T.panel(spark, d).groupBy("g", "t").agg(F.avg("y").alias("y")).groupBy("g").agg((F.regr_slope("y", "t") * 10).alias("per_decade")))


@query(P_ + " SELECT g, round(stddev_samp(y), 3) AS sd, round(corr(y, x), 3) AS r, count(*) AS n FROM p GROUP BY GROUPING SETS ((g), ())")
def contrast_grouping_sets(spark, d):
    p = T.panel(spark, d)
    return p.groupingSets([["g"], []], "g").agg(F.round(F.stddev_samp("y"), 3).alias("sd"), F.round(S.guarded_corr("y", "x"), 3).alias("r"), F.count("*").alias("n"))


@query(P_ + " SELECT t, round(avg(x - z), 2) AS gap FROM p GROUP BY t")
def yearly_gap(spark, d):
    return T.panel(spark, d).groupBy("t").agg(F.round(F.avg(F.col("x") - F.col("z")), 2).alias("gap"))


_EV = "ev AS (SELECT user_id, CAST(ts AS DATE) AS day, value * 0.02 AS v, event_id & 3 AS f, (event_id >> 6) & 3 AS er FROM events)"


def _events(spark, d):
    e = read_table(spark, d, "events", ["event_id", "user_id", "ts", "value"])
    f, er = S.bits(F.col("event_id"), 0, 3), S.bits(F.col("event_id"), 6, 3)
    wide, strict = S.quality_masks(f, er)
    return e.select("user_id", F.to_date("ts").alias("day"), (F.col("value") * 0.02).alias("v"), wide.alias("wide"), strict.alias("strict"))


@query("WITH " + _EV + " SELECT CAST(count(*) FILTER (WHERE f <= 1 AND er <= 1) AS BIGINT) AS wide, CAST(count(*) FILTER (WHERE f = 0 OR (f = 1 AND er = 0)) AS BIGINT) AS strict FROM ev")
def qc_mask(spark, d):
    return _events(spark, d).agg(F.count_if("wide").alias("wide"), F.count_if("strict").alias("strict"))


@query("WITH " + _EV + " SELECT user_id, round(avg(v) FILTER (WHERE f <= 1 AND er <= 1), 7) AS mean, CAST(count(v) FILTER (WHERE f <= 1 AND er <= 1) AS BIGINT) AS n_obs, round(max(v) FILTER (WHERE f <= 1 AND er <= 1), 7) AS highest, round(avg(CASE WHEN f <= 1 AND er <= 1 THEN 1 ELSE 0 END), 7) AS valid FROM ev GROUP BY 1")
def annual_composites(spark, d):
    v = F.when(F.col("wide"), F.col("v"))
    return rounded(_events(spark, d).groupBy("user_id").agg(F.avg(v).alias("mean"), F.count(v).alias("n_obs"), F.max(v).alias("highest"), F.avg(F.col("wide").cast("int")).alias("valid")), 7)


@query(M_ + ", n AS (SELECT nation, mo, avg(v) AS nv FROM m GROUP BY 1, 2), l AS (SELECT nation, avg(nv) AS lv FROM n GROUP BY 1) SELECT nation, yr, mo, round(v - nv, 5) + 0 AS anomaly, round(v - nv + lv, 5) AS deseasoned FROM m JOIN n USING (nation, mo) JOIN l USING (nation)")
def seasonal_anomaly(spark, d):
    return rounded(I.climatology_anomaly(T.monthly(spark, d), ["nation"], "mo", "v").select("nation", "yr", "mo", "anomaly", "deseasoned"), 5)


_DRY = M_ + """, c AS (SELECT nation, mo, sum(v) AS v FROM m GROUP BY 1, 2), w AS (SELECT a.nation, a.mo AS start, sum(b.v) AS s FROM c a JOIN c b ON a.nation = b.nation AND (b.mo - a.mo + 12) % 12 < 3 GROUP BY 1, 2)
, k AS (SELECT nation FROM c GROUP BY 1 HAVING count(*) = 12), f AS (SELECT nation, first(start ORDER BY s, start) AS start FROM w WHERE nation IN (SELECT nation FROM k) GROUP BY 1)"""


def _dry(spark, d):
    return I.driest_start(T.monthly(spark, d).groupBy("nation", "mo").agg(F.sum("v").alias("v")), "nation", "mo", "v")


@query(_DRY + " SELECT nation, start FROM f")
def dry_window(spark, d):
    return _dry(spark, d)


@query(_DRY + " SELECT nation, yr, round(avg(v), 5) AS mean, count(*) AS n FROM m JOIN f USING (nation) WHERE (mo - start + 12) % 12 < 3 GROUP BY 1, 2")
def dry_season_mean(spark, d):
    m = T.monthly(spark, d).join(_dry(spark, d), "nation").where(I.in_season(F.col("mo"), F.col("start")))
    return rounded(m.groupBy("nation", "yr").agg(F.avg("v").alias("mean"), F.count("*").alias("n")), 5)


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity) FILTER (WHERE l_discount IS NOT NULL), 0), 6) AS mean, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1")
def zonal_weighted_mean(spark, d):
    li = read_table(spark, d, "lineitem", ["l_returnflag", "l_discount", "l_quantity"])
    return rounded(li.groupBy("l_returnflag").agg(I.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("mean"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high")), 6)


@query("SELECT p_brand, first(p_size ORDER BY n DESC, p_size) AS mode FROM (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def zonal_mode(spark, d):
    return I.exact_mode(read_table(spark, d, "part", ["p_brand", "p_size"]), "p_brand", "p_size")


@query("WITH g AS (SELECT l_orderkey AS x, l_linenumber AS y, CASE WHEN l_returnflag <> 'N' THEN l_tax END AS v FROM lineitem) SELECT CAST(floor(x / 500.0) AS BIGINT) AS bx, CAST(floor(y / 500.0) AS BIGINT) AS by, round(avg(coalesce(v, 0)), 6) AS mean, count(*) AS cells FROM g GROUP BY 1, 2")
def block_downsample(spark, d):
    g = read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_tax"]).withColumn("v", F.when(F.col("l_returnflag") != "N", F.col("l_tax")))
    return rounded(I.block_means(g, "l_orderkey", "l_linenumber", 500.0, "v"), 6)


_RES = ", r AS (SELECT e, g, t, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY e) - avg({c}) OVER (PARTITION BY g, t) + avg({c}) OVER (PARTITION BY g) AS {c}" for c in "yxz") + " FROM p)"


@query(P_ + _RES + " SELECT e, t, round(y, 7) + 0 AS y_res FROM r")
def fe_residual_balanced(spark, d):
    return rounded(R.residuals(T.panel(spark, d), "e", "g", "t", ["y"]).select("e", "t", "y_res"), 7)


_HOLES = ", h AS (SELECT * FROM p WHERE (e * 7 + t * 3) % 11 <> 0), i0 AS (SELECT e, g, t, y - avg(y) OVER (PARTITION BY g) AS v FROM h)" + "".join(f", a{k} AS (SELECT e, g, t, v - avg(v) OVER (PARTITION BY g, e) AS v FROM i{k - 1}), i{k} AS (SELECT e, g, t, v - avg(v) OVER (PARTITION BY g, t) AS v FROM a{k})" for k in range(1, 4))


@query(P_ + _HOLES + " SELECT e, t, round(v, 4) + 0 AS y_res FROM i3")
def fe_residual_iterative(spark, d):
    holes = T.panel(spark, d).where("(e * 7 + t * 3) % 11 <> 0")
    return rounded(R.residuals_iterated(holes, "e", "g", "t", ["y"], rounds=3).select("e", "t", "y_res"))


_TWENTY = """, h AS (SELECT nation AS e, CAST(n_regionkey AS INTEGER) AS g, yr * 100 + mo AS t, v AS y FROM m JOIN nation ON n_nationkey = nation), i0 AS (SELECT e, g, t, y - avg(y) OVER (PARTITION BY g) AS v FROM h)""" + "".join(f", a{k} AS (SELECT e, g, t, v - avg(v) OVER (PARTITION BY g, e) AS v FROM i{k - 1}), i{k} AS (SELECT e, g, t, v - avg(v) OVER (PARTITION BY g, t) AS v FROM a{k})" for k in range(1, 21))


@query(M_ + _TWENTY + " SELECT e, t, round(v, 4) + 0 AS y_res FROM i20")
def fe_residual_unbalanced(spark, d):
    """The reference's 20 rounds over every row of nation by month, in which months without orders are absent."""
    n = read_table(spark, d, "nation", ["n_nationkey", "n_regionkey"]).select(F.col("n_nationkey").cast("int").alias("nation"), F.col("n_regionkey").cast("int").alias("g"))
    m = T.monthly(spark, d).join(F.broadcast(n), "nation").select(F.col("nation").alias("e"), "g", (F.col("yr") * 100 + F.col("mo")).alias("t"), F.col("v").alias("y"))
    return rounded(R.residuals_iterated(m, "e", "g", "t", ["y"], rounds=20).select("e", "t", "y_res"))


def _specs(spark, d, specs, pairs=None):
    return R.run_specs(T.panel(spark, d), specs, "e", "g", "t", pairs)


_OLS2 = P_ + _RES + ", k AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy FROM r), b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM k)"


@query(_OLS2 + " SELECT 'x' AS variable, round(bx, 6) AS coef FROM b UNION ALL SELECT 'z', round(bz, 6) FROM b")
def fe_ols(spark, d):
    return rounded(_specs(spark, d, [R.Spec("two", "y", ("x", "z"))]).select("variable", "coef"), 6)


_ONE = P_ + _RES + ", b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx FROM r), u AS (SELECT e, t, x * (y - b * x) AS u FROM r, b), c AS (SELECT e, sum(u) AS u FROM u GROUP BY e)"


@query(_ONE + " SELECT round(b, 6) AS coef, round(sqrt((SELECT sum(u * u) * count(*) / (count(*) - 1) FROM c)) / xx, 6) AS se_cluster, (SELECT count(*) FROM r) AS n_obs, (SELECT count(*) FROM c) AS n_entities FROM b")
def cluster_cov(spark, d):
    return rounded(_specs(spark, d, [R.Spec("one", "y", ("x",))]).select("coef", "se_cluster", "n_obs", "n_entities"), 6)


_PAIRS = ", pr AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pt a JOIN pt b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01)"


@query(_ONE + ", " + T.POINTS_SQL + _PAIRS + """, v AS (SELECT (SELECT sum(u1.u * u2.u * (1 - d / 0.1)) FROM pr JOIN u u1 ON u1.e = i JOIN u u2 ON u2.e = j AND u2.t = u1.t WHERE i <> j) AS sp, (SELECT sum(u * u) FROM c) AS se)
SELECT round(b, 6) AS coef, CASE WHEN coalesce(sp, 0) + se >= 0 THEN round(sqrt(coalesce(sp, 0) + se) / xx, 6) END AS se_conley FROM b, v""")
def conley_meat(spark, d):
    return rounded(_specs(spark, d, [R.Spec("one", "y", ("x",))], G.bartlett_pairs(T.points(spark, d), 0.1)).select("coef", "se_conley"), 6)


@query(P_ + _RES + ", q AS (SELECT 'all' AS model, x, y FROM r) SELECT model, 'x' AS variable, round(sum(x * y) / sum(x * x), 6) AS coef, count(*) AS n_obs FROM q GROUP BY 1 UNION ALL SELECT 'group_0', 'x', round(sum(x * y) / sum(x * x), 6), count(*) FROM r WHERE g = 0")
def spec_runner(spark, d):
    return rounded(_specs(spark, d, [R.Spec("all", "y", ("x",)), R.Spec("group_0", "y", ("x",), "g = 0")]).select("model", "variable", "coef", "n_obs"), 6)


@query(P_ + ", c AS (SELECT t - 1995 AS k, sum(x) AS b FROM p GROUP BY 1), i AS (SELECT k, b - coalesce(lag(b) OVER (ORDER BY k), 0) AS b FROM c) SELECT round(sum(k * b) / nullif(sum(b), 0), 6) AS mean_lag FROM i")
def mean_lag(spark, d):
    curve = T.panel(spark, d).groupBy("t").agg(F.sum("x").alias("b"))
    return rounded(R.lag_summary(curve, [], F.col("t") - 1995, "b").select("mean_lag"), 6)


@query(P_ + ", c AS (SELECT g, t - 1998 AS rel, avg(y) AS coef, stddev_samp(y) / sqrt(count(*)) AS se FROM p GROUP BY 1, 2) SELECT g, CAST(rel AS INTEGER) AS rel, round(coef, 4) AS coef, round(coef - 1.96 * se, 4) AS ci_low, round(coef + 1.96 * se, 4) AS ci_high FROM c")
def response_curve(spark, d):
    c = T.panel(spark, d).groupBy("g", (F.col("t") - 1998).alias("rel")).agg(F.avg("y").alias("coef"), (F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("se"))
    return rounded(c.select("g", "rel", "coef", (F.col("coef") - 1.96 * F.col("se")).alias("ci_low"), (F.col("coef") + 1.96 * F.col("se")).alias("ci_high")))


def _pairs(spark, d):
    p = T.points(spark, d)
    return G.near_pairs(p.withColumnRenamed("id", "i"), p.withColumnRenamed("id", "j"), 0.1)


@query(X_ + _PAIRS + " SELECT i, j, round(d, 6) AS d FROM pr")
def distance_pairs(spark, d):
    return rounded(_pairs(spark, d), 6)


_RING = ", v AS (SELECT s_suppkey AS j, s_nationkey AS part, 25 AS whole FROM supplier)"


@query(X_ + _PAIRS + _RING + ", q AS (SELECT i, CASE WHEN d < 0.025 THEN 0 WHEN d < 0.05 THEN 1 ELSE 2 END AS ring, part, whole FROM pr JOIN v USING (j) WHERE i <> j AND d < 0.1) SELECT i, ring, CAST(sum(part) AS BIGINT) AS part, CAST(sum(whole) AS BIGINT) AS whole, round(100.0 * sum(part) / nullif(sum(whole), 0), 4) AS pct FROM q GROUP BY 1, 2")
def ring_shares(spark, d):
    v = read_table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]).select(F.col("s_suppkey").alias("j"), F.col("s_nationkey").alias("part"), F.lit(25).alias("whole"))
    return rounded(G.ring_shares(_pairs(spark, d), v, [0.0, 0.025, 0.05, 0.1]))


@query(X_ + _PAIRS + " SELECT i, first(j ORDER BY d, j) AS j, round(min(d), 6) AS d FROM pr WHERE i <> j GROUP BY i")
def nearest_point(spark, d):
    return rounded(G.nearest(_pairs(spark, d).where("i <> j")), 6)


@query(X_ + _PAIRS + _RING + " SELECT i, round(sum(part * exp(-20 * d)), 4) AS access FROM pr JOIN v USING (j) WHERE i <> j GROUP BY 1")
def access_index(spark, d):
    v = read_table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]).select(F.col("s_suppkey").alias("j"), F.col("s_nationkey").alias("part"))
    return rounded(G.access_index(_pairs(spark, d), v, 20.0))


@query(X_ + " SELECT id, round(2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians(y * 90) / 2), 2) + cos(radians(y * 90)) * power(sin(radians(x * 180) / 2), 2)))), 3) AS km FROM pt")
def haversine(spark, d):
    zero = F.lit(0.0)
    return rounded(T.points(spark, d).select("id", S.haversine_km(zero, zero, F.col("y") * 90, F.col("x") * 180).alias("km")), 3)


from . import assembly, climate, grid  # noqa: E402, F401 - they register queries of their own
