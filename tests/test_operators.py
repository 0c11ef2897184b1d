"""Properties and edge cases of the panel operators, on hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.functions import scalars as S
from terrapanel.operators import panel as P
from terrapanel.operators import regression as R
from terrapanel.operators import series as I
from terrapanel.operators import spatial as G
from terrapanel.sources import io


def _panel(spark, holes):
    rng = np.random.default_rng(3)
    rows = [(e, e % 2, t, float(2 * a - b + 5 * e + 3 * t * (e % 2 + 1)), float(a), float(b)) for e in range(12) for t in range(8) for a, b in [rng.normal(size=2)] if not (holes and rng.random() < 0.3)]
    return spark.createDataFrame(rows, "e long, g int, t int, y double, a double, b double")


def test_planted_coefficients(spark):
    for holes in (False, True):
        out = R.run_specs(_panel(spark, holes), [R.Spec("m", "y", ("a", "b"))], "e", "g", "t").collect()
        assert np.allclose([r.coef for r in out], [2, -1], atol=1e-6)


def test_residuals_have_zero_means(spark):
    d = R.residuals(_panel(spark, True), "e", "g", "t", ["y"])
    for keys in (["e"], ["g", "t"]):
        assert max(abs(r[0]) for r in d.groupBy(*keys).agg(F.avg("y_res")).select("avg(y_res)").collect()) < 1e-8


def test_unbalanced_query_keeps_every_row_and_converges(spark):
    from terrapanel.plans import queries, tables

    d = "/root/testdata/sf0.001"
    m = {(r.nation, r.yr * 100 + r.mo): r.v for r in tables.monthly(spark, d).collect()}
    region = {r.e: r.g for r in spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey AS e", "n_regionkey AS g").collect()}
    got = {(r.e, r.t): r.y_res for r in queries.QUERIES["fe_residual_unbalanced"](spark, d).collect()}
    assert got.keys() == m.keys() and len(m) < len({e for e, _ in m}) * len({t for _, t in m})  # whole, and unbalanced
    for g in set(region.values()):
        keys = sorted(k for k in m if region[k[0]] == g)
        dummies = np.array([[k[0] == e for e in sorted({k[0] for k in keys})] + [k[1] == t for t in sorted({k[1] for k in keys})] for k in keys], float)
        y = np.array([m[k] for k in keys])
        exact = y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]
        assert np.abs(np.array([got[k] for k in keys]) - exact).max() < 1e-3 * y.std()


def test_own_pairs_only_is_cluster_without_factor(spark):
    d = _panel(spark, False)
    beta, inverse, _ = R.ols(d, "y", ["a"])
    u = R.scores(d, "y", ["a"], beta)
    none = spark.createDataFrame([], "i long, j long, w double")
    g = 12
    assert np.allclose(R.conley_covariance(u, none, "e", "t", ["a"], inverse) * g / (g - 1), R.cluster_covariance(u, "e", ["a"], inverse))


def test_null_change_stays_null(spark):
    d = spark.createDataFrame([(1, 1, None), (1, 2, 3.0), (1, 3, 1.0)], "e int, t int, x double")
    rows = P.changes(d, "e", "t", "x").orderBy("t").collect()
    assert [(r.loss, r.gain) for r in rows] == [(None, None), (None, None), (2.0, 0.0)]


def test_bands_need_all_lags(spark):
    d = spark.createDataFrame([(1, t, float(t)) for t in range(4)], "e int, t int, x double")
    assert [r[0] for r in P.lag_bands(d, "e", "t", "x", [(0, 2)]).orderBy("t").select("band_0_2").collect()] == [None, None, 3.0, 6.0]


def test_step_ties_and_rounding(spark):
    d = spark.createDataFrame([(1, t, [0.0, 0.0, 1.504, 1.504, 0.0, 0.0][t]) for t in range(6)] + [(2, t, [0.0, 0.0, 1.506, 1.506, 1.506, 1.506][t]) for t in range(6)], "e int, t int, x double")
    assert {r.e: (r.step, r.flagged) for r in P.largest_step(d, "e", "t", "x", 2, 1.5).collect()} == {1: (1.5, 0), 2: (1.51, 1)}


def test_dry_window_wraps(spark):
    d = spark.createDataFrame([(1, m, 1.0 if m in (12, 1, 2) else 9.0) for m in range(1, 13)], "k int, m int, v double")
    assert I.driest_start(d, "k", "m", "v").collect()[0].start == 12


def test_quality_bits(spark):
    d = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 65, 129, 193)], "q int")
    wide, strict = S.quality_masks(S.bits(F.col("q"), 0, 3), S.bits(F.col("q"), 6, 3))
    assert [tuple(r) for r in d.select(wide, strict).collect()] == [(True, True), (True, True), (False, False), (False, False), (True, False), (False, False), (False, False)]


def test_three_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 250.0, 0.0)], "id long, x double, y double")
    assert {(r.i, r.j): round(r.w, 6) for r in G.bartlett_pairs(p, 200.0).collect() if r.i < r.j} == {(1, 2): 0.5, (2, 3): 0.25}
    plan = G.bartlett_pairs(p, 200.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_guards(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert d.agg(S.guarded_corr("x", "y")).head()[0] is None
    assert d.select(S.percent(F.lit(1.0), F.lit(0.0))).head()[0] is None
    assert S.year_column("yy1999") == 1999 and S.year_column("y1899") is None and S.year_column("area") is None
    assert R.mean_lag([1.0, 1.0, 1.0]) == 0.0 and R.mean_lag([1.0, -0.0 - 0.0, 0.0]) is None


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, float("nan"), "é"), (2, 2.5, None)], "k int, v double, s string")
    assert io.nan_to_null(d).where("v is null").count() == 1
    io.write_csv(d, f"file://{tmp_path}/a", bom=True)
    back = io.read_csv(spark, f"file://{tmp_path}/a", "k int, v double, s string")
    assert back.where("s = 'é'").count() == 1
    (tmp_path / "b.csv").write_text("k;v;s\n1;2.5;x\n")
    assert io.read_csv(spark, f"file://{tmp_path}/b.csv", "k int, v double, s string").head()[1] == 2.5
    assert io.table_or_none(spark, f"file://{tmp_path}/none") is None


def test_lags_share_one_sort(spark):
    d = spark.createDataFrame([(1, 1, 1.0)], "e int, t int, x double")
    plan = P.lags_leads(d, "e", "t", "x", 10, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_entities_without_reference_years_have_no_indicators(spark):
    d = spark.createDataFrame([(1, 1995, 1, 2.0), (1, 1999, 1, 9.0), (2, 1999, 1, 9.0)], "e int, yr int, q int, v double")
    assert {r.e for r in I.annual_indicators(d, "e", "yr", "q", "v", (1995, 1996), 5.0).collect()} == {1}


def test_missing_parent_is_an_error(spark):
    d = spark.createDataFrame([(1, 1, 2.0)], "e long, t int, y double")
    good, bad = (spark.createDataFrame([p], "child long, parent long") for p in ((7, 1), (7, 8)))
    assert [tuple(r) for r in P.impute_children(d, "e", good).orderBy("e").collect()] == [(1, 1, 2.0, 0), (7, 1, 2.0, 1)]
    with pytest.raises(Exception, match="no rows of parent 8"):
        P.impute_children(d, "e", bad).collect()


def test_repeated_key_in_a_pivot_is_an_error(spark):
    d = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0)], "e long, t int, y double")
    assert tuple(P.pivot_unique(d, ["e"], "t", "y", [1, 2, 3]).head()) == (1, 2.0, 3.0, None)
    with pytest.raises(Exception, match="repeated key in a pivot"):
        P.pivot_unique(d.union(d), ["e"], "t", "y", [1, 2]).collect()


def test_only_unbalanced_groups_are_iterated(spark):
    full, holes = _panel(spark, False).where("g = 0"), _panel(spark, True).where("g = 1")
    both = {(r.e, r.t): r.y_res for r in R.residuals(full.union(holes), "e", "g", "t", ["y"]).collect()}
    apart = {(r.e, r.t): r.y_res for x in (full, holes) for r in R.residuals(x, "e", "g", "t", ["y"]).collect()}
    assert both.keys() == apart.keys() and max(abs(both[k] - apart[k]) for k in both) < 1e-6


def test_lag_summary(spark):
    d = spark.createDataFrame([("up", 0, 1.0), ("up", 1, 2.0), ("up", 2, 2.0), ("back", 0, 1.0), ("back", 1, -3.0), ("none", 0, 1.0), ("none", 1, 0.0)], "m string, k int, b double")
    got = {r.m: tuple(r)[1:] for r in R.lag_summary(d, ["m"], F.col("k"), "b").collect()}
    assert got["up"] == (0.5, True, 0.5, 1) and got["back"][1:] == (False, None, 1) and got["none"] == (None, False, None, 0)
    assert R.mean_lag([1.0, 2.0, 2.0]) == 0.5


def test_csv_files_with_other_headers(spark, tmp_path):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    (tmp_path / "a.csv").write_text("k,v\n01,1.5\n")
    (tmp_path / "b.csv").write_text("v;s;other\n2.5;x;9\n")
    schema = StructType([StructField("k", StringType()), StructField("v", DoubleType()), StructField("s", StringType()), StructField("gone", LongType())])
    got = io.read_csv_files(spark, [f"file://{tmp_path}/{n}.csv" for n in "ab"], schema)
    assert [tuple(r) for r in got.orderBy("v").collect()] == [("01", 1.5, None, None), (None, 2.5, "x", None)]


def test_lots_are_written_once_and_versions_never_over(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.0)], "k int, v double")
    path = f"file://{tmp_path}/lot"
    assert io.write_once(d, path) and not io.write_once(d.limit(0), path) and spark.read.parquet(path).count() == 1
    first = io.write_version(d, f"file://{tmp_path}/t", 1)
    assert spark.read.parquet(io.write_version(spark.read.parquet(first), f"file://{tmp_path}/t", 2)).count() == 1


def test_discovery_by_name_and_content(spark):
    d = spark.createDataFrame([("1100015", 1.0, "x"), ("1100023", None, "5")], "Cod_IBGE string, area double, note string")
    assert S.find_column(d, ["codigo", "cod_"]) == "Cod_IBGE" and S.find_column(d, ["year"]) is None
    assert S.share_matching(d, 1e6, 9_999_999) == {"Cod_IBGE": 1.0, "area": 0.0, "note": 0.0}
    assert d.select(S.relative_humidity(F.lit(1.0), F.lit(3.0))).head()[0] == 25.0


def test_geodesic_and_projection(spark):
    d = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (-10.0, -50.0, -20.0, -40.0), (1.0, 2.0, 1.0, 2.0)], "a double, b double, c double, d double")
    km = [r[0] for r in d.select(S.geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert abs(km[0] - 111.3195) < 0.02 and abs(km[1] - 1542) < 5 and km[2] == 0.0
    east, north = S.albers(F.lit(-12.0), F.lit(-54.0), -12.0, -54.0, -2.0, -22.0)
    assert max(abs(x) for x in d.select(east, north).head()) < 1e-6
