"""How far a population's structure exceeds chance: nulls, stability, coverage, matching.

Statistics of a frame come from one aggregation of sums of products; what a null model
permutes or draws goes by hashes, so that replicates are rows of one frame and reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .models import _matrix, gram, standardised


def spectrum(shares: np.ndarray) -> dict[str, float]:
    """Share of the first component and of five, participation ratio, and components for 95 % of the variance."""
    total = np.cumsum(shares)
    return {"pc1": float(shares[0]), "cumvar_pc1_5": float(total[min(4, len(total) - 1)]), "participation_ratio": float(1 / (shares**2).sum()), "dim95": int(np.searchsorted(total, 0.95) + 1)}


def _shares(g: np.ndarray) -> np.ndarray:
    values = np.sort(np.maximum(np.linalg.eigvalsh(g), 0))[::-1]
    return values / values.sum()


def spectra(df: DataFrame, columns: list[str], by: str) -> list[tuple]:
    """(group, pc1, cumvar_pc1_5, participation_ratio, dim95) of standardised columns, all groups from one aggregation each of medians, spreads and products."""
    med = df.groupBy(by).agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    filled = df.join(F.broadcast(med), by).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns})
    w = filled.groupBy(by).agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = filled.join(F.broadcast(w), by).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns})
    grams: dict = {}
    for r in gram(scaled, columns, [by]).collect():
        grams.setdefault(r[by], []).append(r)
    return [(k, *spectrum(_shares(_matrix(rows, columns))).values()) for k, rows in sorted(grams.items())]


def sample_by_hash(df: DataFrame, id_column: str, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of their id, the same in every run; it is what a null model needs of a large population."""
    return df.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(n)


def permuted(df: DataFrame, id_column: str, columns: list[str], reps: int) -> DataFrame:
    """Replicates in which every column is permuted on its own: (rep, place, columns).

    A column's values are numbered by a hash of id, replicate and column, and columns meet
    by number.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(F.col(id_column).alias("id"), entries.alias("_all")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    rows = rows.select("id", "rep", F.explode("_all").alias("_e")).select("id", "rep", "_e.*")
    key = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("rep").cast("string"), "column"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("rep", "column").orderBy(key, "id")))
    return placed.groupBy("rep", "place").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def permutation_null(df: DataFrame, id_column: str, columns: list[str], reps: int, sample: int = 12_000) -> DataFrame:
    """Spectra of the observed rows (replicate -1) and of replicates whose columns are permuted on their own."""
    rows = sample_by_hash(df, id_column, sample)
    observed = rows.select(F.lit(-1).alias("rep"), *[F.col(c).cast("double").alias(c) for c in columns])
    found = spectra(observed.unionByName(permuted(rows, id_column, columns, reps).select("rep", *columns)), columns, "rep")
    return df.sparkSession.createDataFrame(found, "replicate int, pc1 double, cumvar_pc1_5 double, participation_ratio double, dim95 int")


def shuffled_growth(slices: DataFrame, rep: int = 0) -> DataFrame:
    """A null of growth: each entity's amounts in another order, by a hash; duration, total and amounts stay."""
    w = Window.partitionBy("fire_id")
    at = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.col("fire_id").cast("string"), F.col("slice_index").cast("string"), F.lit(str(rep))))))
    dealt = slices.select("fire_id", "ring_area_km2", (at - 1).cast("long").alias("slice_index"))
    times = slices.select("fire_id", "slice_index", "timestamp")
    return _cumulated(dealt.join(times, ["fire_id", "slice_index"]))


def _cumulated(dealt: DataFrame) -> DataFrame:
    run = Window.partitionBy("fire_id").orderBy("slice_index").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("ring_area_km2").over(Window.partitionBy("fire_id"))
    cumulative = F.sum("ring_area_km2").over(run)
    return dealt.select("fire_id", "slice_index", "timestamp", "ring_area_km2", cumulative.alias("cumulative_area_km2"), F.sqrt(F.try_divide(cumulative, F.nullif(total, F.lit(0.0)))).alias("normalized_vase_width"))


def _uniform(*parts: Column | str) -> Column:
    named = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in named])), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


NULL_GROWTH = ("shuffled order", "dirichlet", "zero-preserving dirichlet", "duration-bin donor", "duration-bin mean profile")


def null_growth(slices: DataFrame, kind: str, bins: Column | None = None, rep: int = 0) -> DataFrame:
    """Slices of each entity under a null model that keeps its total and its number of slices.

    ``dirichlet``: flat random shares; ``zero-preserving``: of as many positive slices, at
    random places; ``duration-bin donor``: the shares of another entity of the same bin of
    durations (1, 2-3, 4-7, 8+), stretched to the number of slices; ``mean profile``: the
    bin's mean shares, with weak noise.
    """
    if kind not in NULL_GROWTH:
        raise ValueError(f"kind is one of {NULL_GROWTH}")
    if kind == NULL_GROWTH[0]:
        return shuffled_growth(slices, rep)
    w = Window.partitionBy("fire_id")
    n, total = F.count(F.lit(1)).over(w), F.sum("ring_area_km2").over(w)
    base = slices.select("fire_id", "slice_index", "timestamp", "ring_area_km2", n.alias("n"), total.alias("total"))
    base = base.withColumn("bin", F.when(F.col("n") <= 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 7, "4-7").otherwise("8+"))
    u = _uniform(F.col("fire_id"), F.col("slice_index"), f"{kind}:{rep}")
    if kind in NULL_GROWTH[1:3]:
        draw = -F.log(u)
        if kind == NULL_GROWTH[2]:
            active = F.greatest(F.lit(1), F.sum((F.col("ring_area_km2") > 0).cast("int")).over(w))
            place = F.row_number().over(w.orderBy(_uniform(F.col("fire_id"), F.col("slice_index"), f"place:{rep}")))
            base = base.withColumns({"_active": active, "_place": place})
            draw = F.when(F.col("_place") <= F.col("_active"), draw).otherwise(F.lit(0.0))
        base = base.withColumn("_d", draw)
        share = F.col("_d") / F.sum("_d").over(w)
    else:
        shares = base.groupBy("fire_id", "bin").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("slice_index", F.try_divide("ring_area_km2", F.nullif("total", F.lit(0.0))).alias("f")))).alias("_s"))
        shares = shares.select("fire_id", "bin", F.transform("_s", lambda e: F.coalesce(e["f"], F.lit(0.0))).alias("f"))
        if kind == NULL_GROWTH[3]:
            by_bin = Window.partitionBy("bin")
            ring = by_bin.orderBy(_uniform(F.col("fire_id"), f"donor:{rep}"), "fire_id")
            donors = shares.withColumn("_f", F.coalesce(F.lead("f").over(ring), F.first("f").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("fire_id", F.col("_f").alias("f"))
            joined = base.join(donors, "fire_id")
        else:
            grid = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda g: _interpolated(F.col("f"), g / 10.0))
            points = shares.select("bin", F.posexplode(grid).alias("g", "y")).groupBy("bin", "g").agg(F.avg("y").alias("y"))
            mean = points.groupBy("bin").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "y"))), lambda e: e["y"]).alias("f"))
            joined = base.join(F.broadcast(mean), "bin")
        at = F.when(F.col("n") > 1, F.col("slice_index") / (F.col("n") - 1)).otherwise(F.lit(0.0))
        value = _interpolated(F.col("f"), at)
        if kind == NULL_GROWTH[4]:
            normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * _uniform(F.col("fire_id"), F.col("slice_index"), f"angle:{rep}"))
            value = value / F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x) + 0.02 * normal
        base = joined.withColumn("_d", F.greatest(F.lit(0.0), value))
        share = F.when(F.sum("_d").over(w) > 0, F.col("_d") / F.sum("_d").over(w)).otherwise(1 / F.col("n"))
    return _cumulated(base.select("fire_id", "slice_index", "timestamp", (share * F.col("total")).alias("ring_area_km2")))


def _interpolated(values: Column, at: Column) -> Column:
    """Linear interpolation of an array over [0, 1]."""
    x = at * (F.size(values) - 1)
    low = F.floor(x).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, F.size(values)))
    return a + (x - low) * (b - a)


def logdet_covariance(df: DataFrame, columns: list[str]) -> float:
    """Logarithm of the determinant of the sample covariance, with a grain of ridge."""
    row = df.agg(F.count(F.lit(1)), *[F.covar_samp(a, b) for i, a in enumerate(columns) for b in columns[i:]]).first()
    k, out = iter(row[1:]), np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            out[i, j] = out[j, i] = next(k) or 0.0
    return float(np.linalg.slogdet(out + 1e-9 * np.eye(len(columns)))[1])


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlations of all pairs of columns, gaps filled by medians; none counts as 0."""
    med = df.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(med)).select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)).alias(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = filled.agg(*[pearson(F.col(columns[i]), F.col(columns[j])).alias(f"_{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = np.eye(len(columns))
    for (i, j), r in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = r or 0.0
    return out


def representative_columns(correlation: np.ndarray, columns: list[str], threshold: float = 0.85) -> list[str]:
    """One column of each cluster of correlated ones: each time that with the most others at or above the threshold, which go with it."""
    strong = np.abs(correlation) >= threshold
    np.fill_diagonal(strong, True)
    left, chosen = list(range(len(columns))), []
    while left:
        best = max(left, key=lambda i: (sum(strong[i, j] for j in left), -i))
        chosen.append(columns[best])
        left = [j for j in left if not strong[best, j]]
    return chosen


def ablation(df: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Share of the first component and of five for each named set of columns; all sets from one matrix of products."""
    columns = sorted({c for s in sets.values() for c in s})
    g = _matrix(gram(standardised(df, columns), columns).collect(), columns)
    rows = []
    for name, chosen in sets.items():
        at = [columns.index(c) for c in chosen]
        s = spectrum(_shares(g[np.ix_(at, at)]))
        rows.append((name, len(chosen), s["pc1"], s["cumvar_pc1_5"]))
    return df.sparkSession.createDataFrame(rows, "feature_set string, n_features int, pc1 double, cumvar_pc1_5 double")


def duration_sensitivity(df: DataFrame, columns: list[str], duration: str, thresholds: tuple[int, ...] = (0, 2, 4, 8, 10), least: int = 500) -> DataFrame:
    """Spectra of the rows that last at least so long, for thresholds with enough rows."""
    cases = df.withColumn("_t", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where((F.col("_t") == 0) | (F.col(duration) >= F.col("_t")))
    counts = {r["_t"]: r["n"] for r in cases.groupBy("_t").agg(F.count(F.lit(1)).alias("n")).collect()}
    enough = [t for t in thresholds if counts.get(t, 0) >= least]
    found = spectra(cases.where(F.col("_t").isin(enough)), columns, "_t") if enough else []
    return df.sparkSession.createDataFrame([(int(t), counts[t], p, c) for t, p, c, _, _ in found], "threshold int, n long, pc1 double, cumvar_pc1_5 double")


def medoid_coverage(df: DataFrame, representatives: DataFrame, columns: list[str], counts: tuple[int, ...] = (4, 8, 12, 16, 24, 30, 36)) -> DataFrame:
    """How near the rows lie to the first k of ``representatives(representative_id, columns)``: median, ninth decile, share within 1.

    Representatives are few and travel to the rows.
    """
    reps = representatives.agg(F.transform(F.sort_array(F.collect_list(F.struct("representative_id", F.array(*columns).alias("p")))), lambda e: e["p"]).alias("_reps"))
    point = F.array(*[F.col(c).cast("double") for c in columns])
    distance = lambda q: F.sqrt(F.aggregate(F.zip_with("_p", q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))
    rows = df.select(point.alias("_p")).crossJoin(F.broadcast(reps)).select(F.transform("_reps", distance).alias("_d"))
    cases = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("n_medoids"), F.array_min(F.slice("_d", 1, k)).alias("d")) for k in counts])).alias("_e")).select("_e.*")
    return cases.groupBy("n_medoids").agg(F.percentile("d", F.lit(0.5)).alias("median_nearest_distance"), F.percentile("d", F.lit(0.9)).alias("p90_nearest_distance"), F.avg((F.col("d") <= 1.0).cast("double")).alias("mass_within_1sd"))


def matched_population(neighbors: DataFrame, other: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """Distances in another space of pairs matched in one, beside those of random pairs.

    ``neighbors(query_id, neighbor_id, distance)`` with one neighbour each; random partners
    follow each other in the order of a hash of the id.
    """
    point = F.array(*[F.col(c).cast("double") for c in columns])
    at = other.select(F.col(id_column).alias("id"), point.alias("p"))
    distance = F.sqrt(F.aggregate(F.zip_with("p", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))
    matched = neighbors.join(at.select(F.col("id").alias("query_id"), "p"), "query_id").join(at.select(F.col("id").alias("neighbor_id"), F.col("p").alias("q")), "neighbor_id").select("distance", distance.alias("other"))
    bucket = F.substring(F.md5(F.col("id").cast("string")), 1, 2)
    ring = Window.partitionBy("_b").orderBy(F.md5(F.col("id").cast("string")), "id")
    chance = at.withColumn("_b", bucket).withColumn("q", F.lead("p").over(ring)).where(F.col("q").isNotNull()).select(distance.alias("d"))
    a = matched.agg(F.count(F.lit(1)).alias("n_pairs"), F.percentile("distance", F.lit(0.5)).alias("matched_distance"), F.percentile("other", F.lit(0.5)).alias("other_distance"))
    b = chance.agg(F.percentile("d", F.lit(0.5)).alias("random_other_distance"), F.stddev_pop("d").alias("_sd"))
    return a.crossJoin(b).withColumn("standardized_effect", F.try_divide(F.col("other_distance") - F.col("random_other_distance"), F.nullif("_sd", F.lit(0.0)))).drop("_sd")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def correlation_p_value(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation of ``n`` pairs by Student's t."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho**2 * (n - 2) / (1 - rho**2)
    return _beta_fraction((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def with_p_values(effects: DataFrame) -> DataFrame:
    """``effects(predictor, response, n, rho)`` with p-values; a row for each pair of columns, worked out on the driver."""
    rows = [(*r, correlation_p_value(r["rho"], r["n"])) for r in effects.select("predictor", "response", "n", "rho").collect()]
    return effects.sparkSession.createDataFrame(rows, "predictor string, response string, n long, rho double, p_value double")
