"""Column expressions and small frames that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A variance below this share of the mean square counts as none.
TINY = 1e-12


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums over complete pairs; null for under two pairs or a constant side."""
    vx, vy, cov = sxx / n - (sx / n) * (sx / n), syy / n - (sy / n) * (sy / n), sxy / n - (sx / n) * (sy / n)
    usable = (n >= 2) & (vx > TINY * F.greatest(sxx / n, F.lit(1.0))) & (vy > TINY * F.greatest(syy / n, F.lit(1.0)))
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(vx * vy)))))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate form of :func:`pearson_from_sums`; rows with a null on either side do not count."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.nullif(F.count(a), F.lit(0))
    return pearson_from_sums(n, F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b))


def pearson_over(x: Column, y: Column, window: Window) -> Column:
    """Window form of :func:`pearson_from_sums`."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.nullif(F.count(a).over(window), F.lit(0))
    return pearson_from_sums(n, *[F.sum(c).over(window) for c in (a, b, a * a, b * b, a * b)])


def average_rank(value: Column, partition: list[str | Column]) -> Column:
    """Rank with ties at their mean; nulls rank last and should be filtered before."""
    first = F.rank().over(Window.partitionBy(*partition).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return first + (ties - 1) / 2.0


def percent_rank_average(value: Column, partition: list[str | Column]) -> Column:
    """Average rank as a share of the group's rows."""
    return average_rank(value, partition) / F.count(value).over(Window.partitionBy(*partition))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often and deep the body uses it."""
    return F.transform(F.array(value), body)[0]


def array_ranks(values: Column) -> Column:
    """Ranks of an array's elements, ties at their mean; no element may be null."""
    ordered = F.array_sort(values)
    names = F.struct(values.alias("v"), ordered.alias("up"), F.reverse(ordered).alias("down"))
    return let(names, lambda w: F.transform(w["v"], lambda x: (F.array_position(w["up"], x) + F.size(w["v"]) - F.array_position(w["down"], x) + 1) / 2.0))


def array_pearson(x: Column, y: Column) -> Column:
    """:func:`pearson_from_sums` of two arrays without nulls."""
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def add(acc: Column, z: Column) -> Column:
        a, b = z["x"], z["y"]
        return F.struct(*[(acc[k] + v).alias(k) for k, v in zip(names, (F.lit(1.0), a, b, a * a, b * b, a * b), strict=True)])

    pairs = F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    return let(F.aggregate(pairs, zero, add), lambda t: F.when(t["n"] > 0, pearson_from_sums(*[t[k] for k in names])))


def array_mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.nullif(F.size(values), F.lit(0)))


def quantile(value: Column | str, q: float | Column, accuracy: int | None = None) -> Column:
    """Linear interpolation between order statistics.

    An exact quantile keeps a count of every distinct value until the last task has them
    all.  With ``accuracy`` it is an approximate one of bounded size instead, whose rank is
    off by at most one part in ``accuracy`` and which does not interpolate.
    """
    at = F.lit(q) if isinstance(q, float) else q
    return F.percentile(value, at) if accuracy is None else F.percentile_approx(value, at, accuracy)


def fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once, by what Dekker's product and Knuth's sum lose; where that overflows, rounded twice."""

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (a1, a2), (b1, b2) = halves(a), halves(b)
    product, total = a * b, a * b + c
    added = total - product
    lost = (a1 * b1 - product) + a1 * b2 + a2 * b1 + a2 * b2 + ((product - (total - added)) + (c - added))
    return F.when(F.isnan(lost), total).otherwise(total + lost)


def interpolated(values: Column, q: float) -> Column:
    """Quantile of a sorted array as ``low * (1 - share) + high * share``, where only the second product is rounded before the sum.

    So does SQL; where ``low`` and ``high`` are next to each other, each rounding more can put the quantile on the other side of a value.
    """

    def ends(ordered: Column) -> Column:
        at = (F.size(ordered) - 1) * F.lit(q)
        return F.struct(F.get(ordered, F.floor(at).cast("int")).alias("low"), F.get(ordered, F.ceil(at).cast("int")).alias("high"), (at - F.floor(at)).alias("share"))

    return let(let(values, ends), lambda e: F.when(e["share"] == 0, e["low"]).otherwise(fused(e["low"], 1 - e["share"], e["high"] * e["share"])))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres if all coordinates are degrees, else plain distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    km = 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
    degrees = (F.abs(lat1) <= 90) & (F.abs(lat2) <= 90) & (F.abs(lon1) <= 180) & (F.abs(lon2) <= 180)
    return F.when(degrees, km).otherwise(F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)))


def compare(value: Column, threshold: Column | float, direction: str) -> Column:
    """A comparison in which a missing value is false."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    ops = {">": value > t, ">=": value >= t, "<": value < t, "<=": value <= t}
    if direction not in ops:
        raise ValueError(f"direction is one of {sorted(ops)}")
    return F.coalesce(ops[direction], F.lit(False))


def days(text: str | int | None) -> int | None:
    """A span such as 30, '30D' or '1Y' in days; a year has 365."""
    if text is None or isinstance(text, int):
        return text
    unit = text[-1].upper()
    if unit not in "DY" or not text[:-1].isdigit():
        raise ValueError(f"{text!r} is no number of days or years")
    return int(text[:-1]) * (365 if unit == "Y" else 1)


def steps(span: str | int, times: DataFrame) -> int:
    """A span as a number of time steps, at least one: a number as it is, 'nD' or 'nY' by the median step."""
    if isinstance(span, int):
        if span < 1:
            raise ValueError("a lag is at least one step")
        return span
    gaps = times.select("time").distinct().select(F.datediff("time", F.lag("time").over(Window.orderBy("time"))).alias("gap"))
    median = gaps.agg(F.percentile("gap", F.lit(0.5))).first()[0] or 1.0
    return max(1, round(days(span) / median))
