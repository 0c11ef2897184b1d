"""Column expressions with missing values as null and no error on zero or bad input."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(100.0 * part, F.when(whole != 0, whole))


def losses(change: Column) -> Column:
    """How far a change is below zero; null stays null."""
    return F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))


def gains(change: Column) -> Column:
    return F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))


def labelled(code: Column, labels: dict) -> Column:
    """The label of a code; null for others."""
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code]


def null_unless(df: DataFrame, columns: list[str], valid: Column) -> DataFrame:
    """Columns set to null where valid isn't true (null counts as not)."""
    return df.withColumns({c: F.when(F.coalesce(valid, F.lit(False)), F.col(c)) for c in columns})


def masked_fill(value: Column, where: Column, fill=0.0) -> Column:
    return F.when(where, F.coalesce(value, F.lit(fill))).otherwise(value)


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def quality_masks(flag: Column, error: Column) -> tuple[Column, Column]:
    """Wide: both at most 1. Strict: flag 0, or flag 1 with error 0."""
    return (flag <= 1) & (error <= 1), (flag == 0) | ((flag == 1) & (error == 0))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson's r over rows where both are known; null without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.try_divide(F.covar_samp(a, b), F.when(spread > 0, spread))


def partial_corr(xy: Column, yz: Column, xz: Column) -> Column:
    """Correlation of x and y with z held fixed, from the three plain ones."""
    rest = F.sqrt(F.greatest((1 - yz * yz) * (1 - xz * xz), F.lit(0.0)))
    return F.try_divide(xy - yz * xz, F.when(rest > 0, rest))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def relative_humidity(vapour: Column, deficit: Column) -> Column:
    return F.try_divide(100.0 * vapour, vapour + deficit)


def year_column(name: str, first: int = 1985, last: int = 2035) -> int | None:
    """The year that a column is named for (y1999 or 1999), if any."""
    m = re.fullmatch(r"y*((?:19|20)\d\d)", name.strip().lower())
    return int(m[1]) if m and first <= int(m[1]) <= last else None


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first column whose lower-cased name contains a candidate."""
    return next((c for c in df.columns if any(x in c.lower() for x in candidates)), None)


def share_matching(df: DataFrame, low: float, high: float) -> dict[str, float]:
    """Of each column the share of known values that are numbers in a range, in one pass over the table."""
    tests = [F.avg(F.coalesce(F.col(c).cast("string").try_cast("double").between(low, high), F.lit(False)).cast("int")).alias(c) for c in df.columns]
    return {k: v or 0.0 for k, v in df.agg(*tests).head().asDict().items()}


def in_dates(df: DataFrame, column: str, begin: str, end: str) -> DataFrame:
    """Rows with begin <= column < end; the bounds reach the scan."""
    return df.where((F.col(column) >= F.lit(begin).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp")))


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, a: float = 6378.137, f: float = 1 / 298.257223563) -> Column:
    """Distance on the WGS84 ellipsoid by Lambert's formula for long lines (errors of some metres)."""
    b1, b2 = (F.atan((1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    s = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q) / F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q) / F.sin(s / 2), 2)
    return F.when(s > 0, a * (s - f / 2 * (x + y))).otherwise(0.0)


def albers(lat: Column, lon: Column, lat0: float, lon0: float, south: float, north: float, a: float = 6378137.0, f: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """Equal-area conic coordinates (x, y) in metres on an ellipsoid, by the closed form."""
    import math

    e2 = 2 * f - f * f
    e = math.sqrt(e2)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    m_of = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    p0, p1, p2 = (math.radians(x) for x in (lat0, south, north))
    n = (m_of(p1) ** 2 - m_of(p2) ** 2) / (q_of(math.sin(p2)) - q_of(math.sin(p1)))
    c = m_of(p1) ** 2 + n * q_of(math.sin(p1))
    rho0 = a * math.sqrt(c - n * q_of(math.sin(p0))) / n
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = a * F.sqrt(c - n * q) / n, n * F.radians(lon - lon0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a simple polygon: an odd number of its edges is crossed to the right."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            over = (F.lit(ay) > y) != (F.lit(by) > y)
            crossed = crossed + (over & (x < ax + (y - ay) * ((bx - ax) / (by - ay)))).cast("int")
    return crossed % 2 == 1
