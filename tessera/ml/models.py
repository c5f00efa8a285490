"""Linear statistics by sufficient sums: principal components, least squares, neighbours.

All rows go once into sums of products per group (a partial aggregation of fixed size);
only those matrices, whose size is the number of columns squared, reach the driver.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dealing import dealt, distance_sums, near_pairs, points, squares
from ..functions.stats import quantile


def standardised(df: DataFrame, columns: list[str], center: str = "median", accuracy: int | None = None) -> DataFrame:
    """Columns imputed by the median, centred by median or mean, and scaled by the population deviation (1 if that is 0)."""
    med = df.agg(*[quantile(c, 0.5, accuracy).alias(f"_m_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns})
    spread = filled.agg(*[e for c in columns for e in (F.stddev_pop(c).alias(f"_s_{c}"), F.avg(c).alias(f"_a_{c}"))])
    mid = "_m_" if center == "median" else "_a_"
    scaled = filled.crossJoin(F.broadcast(spread)).withColumns({c: (F.col(c) - F.col(f"{mid}{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns})
    return scaled.select(*df.columns)


def gram(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of products of all pairs of columns: (by, i, j, value), i <= j, by one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.groupBy(*(by or [])).agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"_{k}") for k, (i, j) in enumerate(pairs)])
    return sums.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"_{k}").alias("value")) for k, (i, j) in enumerate(pairs)])).alias("_g")).select(*(by or []), "_g.*")


def _matrix(rows: list, columns: list[str]) -> np.ndarray:
    at = {c: k for k, c in enumerate(columns)}
    g = np.zeros((len(columns), len(columns)))
    for r in rows:
        g[at[r["i"]], at[r["j"]]] = g[at[r["j"]], at[r["i"]]] = r["value"]
    return g


def pca(df: DataFrame, columns: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shares of variance, loadings) of columns centred by their medians, without centring by means."""
    values, vectors = np.linalg.eigh(_matrix(gram(standardised(df, columns), columns).collect(), columns))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))])
    return values[:k] / values.sum(), vectors[:, :k] * signs[:k]


def pca_scores(df: DataFrame, columns: list[str], loadings: np.ndarray) -> DataFrame:
    z = standardised(df, columns)
    score = lambda j: sum((F.col(c) * float(loadings[i, j]) for i, c in enumerate(columns)), F.lit(0.0))
    return z.select("*", *[score(j).alias(f"PC{j + 1}") for j in range(loadings.shape[1])])


def fold_of(id_column: str, folds: int) -> Column:
    """A fold from a hash of the id, the same everywhere."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(id_column).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def blocked_cv(df: DataFrame, x: list[str], y: str, block: str, alpha: float = 0.0) -> DataFrame:
    """R squared on each held-out block of least squares (ridge if ``alpha`` > 0, intercept free) on the others.

    The sums of each block are gathered once; a fold's training sums are the total less its own.
    """
    spark = df.sparkSession
    columns = ["_one", *x, y]
    rows = gram(df.withColumn("_one", F.lit(1.0)).where(F.col(y).isNotNull()), columns, [block]).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r[block], []).append(r)
    grams = {k: _matrix(v, columns) for k, v in by.items()}
    total, p = sum(grams.values()), len(x) + 1
    out = []
    for k, held in sorted(grams.items(), key=lambda e: str(e[0])):
        train = total - held
        penalty = alpha * np.eye(p)
        penalty[0, 0] = 0
        beta = np.linalg.lstsq(train[:p, :p] + penalty, train[:p, p], rcond=None)[0]
        n, sy, syy = held[0, 0], held[0, p], held[p, p]
        sse = syy - 2 * beta @ held[:p, p] + beta @ held[:p, :p] @ beta
        sst = syy - sy**2 / n
        out.append((str(k), int(n), float(1 - sse / sst) if n > 1 and sst > 1e-9 * syy else None))
    return spark.createDataFrame(out, "block string, n long, r2 double")


def ridge_cv(df: DataFrame, x: list[str], y: str, fold: Column, alpha: float = 1.0, log: bool = False, least: int = 200) -> tuple[int, float | None]:
    """(rows predicted, R squared over all of them) of ridge regression on the other folds; predictors are scaled by each training part.

    ``log``: the response is log(1 + y).  Folds whose training part is too small are left
    out.  Sums of products by fold are all that is gathered.
    """
    columns = ["_one", *x, y]
    full = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS DOUBLE)) AND abs(CAST(`{c}` AS DOUBLE)) < double('infinity')" for c in (*x, y)))
    full = full.withColumns({"_one": F.lit(1.0), y: F.log1p(F.col(y).cast("double")) if log else F.col(y).cast("double"), "_fold": fold})
    by: dict = {}
    for r in gram(full, columns, ["_fold"]).collect():
        by.setdefault(r["_fold"], []).append(r)
    grams = {k: _matrix(v, columns) for k, v in by.items()}
    if sum(g[0, 0] for g in grams.values()) < least:
        return int(sum(g[0, 0] for g in grams.values())), None
    total, p = sum(grams.values()), len(x) + 1
    n = sse = sy = syy = 0.0
    for held in grams.values():
        train = total - held
        if train[0, 0] < len(x) + 10:
            continue
        mean = train[0, 1:p] / train[0, 0]
        sd = np.sqrt(np.maximum(np.diag(train)[1:p] / train[0, 0] - mean**2, 0))
        sd[sd == 0] = 1.0
        scale = np.zeros((p, p))
        scale[0, 0] = 1
        scale[1:, 1:] = np.diag(1 / sd)
        scale[0, 1:] = -mean / sd
        penalty = alpha * np.eye(p)
        penalty[0, 0] = 0
        beta = scale @ (np.linalg.pinv(scale.T @ train[:p, :p] @ scale + penalty) @ (scale.T @ train[:p, p]))
        n, sy, syy = n + held[0, 0], sy + held[0, p], syy + held[p, p]
        sse += held[p, p] - 2 * beta @ held[:p, p] + beta @ held[:p, :p] @ beta
    sst = syy - sy**2 / n if n else 0.0
    return int(n), float(1 - sse / sst) if sst > 0 else None


def holdout_r2(df: DataFrame, x: list[str], y: str, id_column: str, parts: int = 4) -> DataFrame:
    """R squared of least squares on one part in ``parts`` (a hash of the id), fitted on the rest; predictors are standardised over all rows."""
    z = standardised(df, x, "mean").withColumn("_part", F.when(fold_of(id_column, parts) == 0, "test").otherwise("train"))
    return blocked_cv(z, x, y, "_part").where("block = 'test'").select(F.col("n").alias("n_test"), "r2")


def knn(queries: DataFrame, points: DataFrame, id_column: str, vector: str, k: int, block: str | None = None) -> DataFrame:
    """The ``k`` nearest points of each query by squared distance, other ids only, ties to the smaller id; inside blocks if given."""
    q = queries.select(F.col(id_column).alias("query_id"), F.col(vector).cast("array<double>").alias("_q"), *([block] if block else []))
    p = points.select(F.col(id_column).alias("neighbor_id"), F.col(vector).cast("array<double>").alias("_p"), *([block] if block else []))
    pairs = (q.join(p, block) if block else q.crossJoin(p)).where(F.col("query_id") != F.col("neighbor_id"))
    d2 = F.aggregate(F.zip_with("_q", "_p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    near = pairs.select("query_id", "neighbor_id", d2.alias("d2"))
    w = Window.partitionBy("query_id").orderBy(F.round("d2", 9), "neighbor_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.sqrt("d2").alias("distance"))


def knn_columns(queries: DataFrame, rows: DataFrame, id_column: str, columns: list[str], k: int) -> DataFrame:
    """:func:`knn` of points with a few columns."""
    w = Window.partitionBy("query_id").orderBy(F.round("d2", 9), "neighbor_id")
    near = near_pairs(queries, rows, id_column, columns, [], k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return near.select("query_id", "rank", "neighbor_id", F.sqrt("d2").alias("distance"))


def label_purity(neighbors: DataFrame, labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """Share of neighbours that carry the query's label, by label."""
    a = neighbors.join(labels.select(F.col(id_column).alias("query_id"), F.col(label).alias("_l")), "query_id")
    b = a.join(labels.select(F.col(id_column).alias("neighbor_id"), F.col(label).alias("_m")), "neighbor_id")
    return b.groupBy(F.col("_l").alias(label)).agg(F.avg((F.col("_l") == F.col("_m")).cast("double")).alias("purity"), F.count(F.lit(1)).alias("n"))


def farthest_first(df: DataFrame, id_column: str, columns: list[str], k: int) -> list:
    """Representatives: the row nearest the mean, then each time the row farthest from those chosen; ties to the smaller id."""
    chosen: list = []
    point = F.array(*[F.col(c).cast("double") for c in columns])
    # The rows chosen so far are one literal: the expression does not grow with them.
    gap = lambda points: F.array_min(F.transform(F.from_json(F.lit(json.dumps(points)), "array<array<double>>"), lambda q: F.aggregate(F.zip_with(point, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)))
    mean = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    chosen.append(df.select(id_column, *columns, gap([[float(mean[c]) for c in columns]]).alias("_d")).orderBy(F.round("_d", 9), id_column).first())
    while len(chosen) < k:
        nxt = df.select(id_column, *columns, gap([[float(r[c]) for c in columns] for r in chosen]).alias("_d")).orderBy(F.round("_d", 9).desc(), id_column).first()
        if nxt is None or nxt["_d"] == 0:
            break
        chosen.append(nxt)
    return [r[id_column] for r in chosen]


def assigned(df: DataFrame, representatives: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(id, representative, distance): each row with its nearest of a few representatives, which travel to the rows; ties to the smaller id."""
    point = lambda: F.array(*[F.col(c).cast("double") for c in columns])
    reps = representatives.agg(F.collect_list(F.struct(F.col(id_column).alias("id"), point().alias("p"))).alias("_reps"))
    distance = lambda q: F.sqrt(F.aggregate(F.zip_with("_p", q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))
    near = F.array_min(F.transform("_reps", lambda r: F.struct(F.round(distance(r["p"]), 9).alias("d"), r["id"].alias("id"))))
    return df.select(F.col(id_column), point().alias("_p")).crossJoin(F.broadcast(reps)).select(id_column, near.alias("_n")).select(id_column, F.col("_n.id").alias("representative"), F.col("_n.d").alias("distance"))


def bootstrap_pca(df: DataFrame, columns: list[str], id_column: str, reps: int, k: int = 5) -> DataFrame:
    """Share of the first ``k`` components in Poisson bootstrap replicates, all from one aggregation."""
    z = standardised(df, columns).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    u = (F.pmod(F.xxhash64(id_column, "rep"), F.lit(1_000_003)) + 0.5) / 1_000_003
    weight = sum((F.when(u > c, 1.0).otherwise(0.0) for c in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634)), F.lit(0.0))
    weighted = z.withColumn("_w", F.sqrt(weight)).withColumns({c: F.col(c) * F.col("_w") for c in columns})

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(np.maximum(np.linalg.eigvalsh(_matrix(pdf.to_dict("records"), columns)), 0))[::-1]
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "share": [values[:k].sum() / values.sum()]})

    return gram(weighted, columns, ["rep"]).groupBy("rep").applyInPandas(shares, "rep int, share double")


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Ward clustering of a few points: labels from 0 in the order of first members."""
    n = len(points)
    members = {i: [i] for i in range(n)}
    centers = {i: points[i].astype(float) for i in range(n)}
    while len(members) > k:
        ids = sorted(members)
        c, s = np.array([centers[i] for i in ids]), np.array([len(members[i]) for i in ids], float)
        cost = ((c[:, None] - c[None]) ** 2).sum(-1) * (s[:, None] * s[None]) / (s[:, None] + s[None])
        cost[np.tril_indices(len(ids))] = np.inf
        a, b = np.unravel_index(cost.argmin(), cost.shape)
        i, j = ids[a], ids[b]
        centers[i] = (centers[i] * s[a] + centers[j] * s[b]) / (s[a] + s[b])
        members[i] += members.pop(j)
        del centers[j]
    out = np.empty(n, int)
    for label, key in enumerate(sorted(members, key=lambda m: min(members[m]))):
        out[members[key]] = label
    return out


#: Clusters of like size and place that are searched together.
LEAF = 64


def _leaves(centers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Clusters in groups of like size and place: members, where each group starts, its bounds and its least size."""
    kind = np.frexp(sizes)[1]
    todo, found = [np.flatnonzero(kind == c) for c in np.unique(kind)], []
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            found.append(part)
            continue
        p, half = centers[part], len(part) // 2
        at = np.argpartition(p[:, np.ptp(p, axis=0).argmax()], half)
        todo += [part[at[:half]], part[at[half:]]]
    members, starts = np.concatenate(found), np.cumsum([0, *map(len, found)])
    return members, starts, np.minimum.reduceat(centers[members], starts[:-1]), np.maximum.reduceat(centers[members], starts[:-1]), np.minimum.reduceat(sizes[members], starts[:-1])


def _nearest(centers: np.ndarray, sizes: np.ndarray, asked: np.ndarray, members: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, least_size: np.ndarray, start: int, stop: int) -> dict:
    """Least Ward cost and its partner, ties to the first, of the clusters ``asked`` for in the groups from ``start`` to ``stop``.

    The gap between two groups' bounds and their least sizes give a cost that none of their
    pairs is below; groups beyond the costs found so far are left out, and nothing is missed.
    """
    who, best, least = [], [], []

    def search(own: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        others = np.sort(np.concatenate([members[starts[g] : starts[g + 1]] for g in groups]))
        partner, cost = np.full(len(own), -1), np.full(len(own), np.inf)
        step = max(1, 250_000 // len(own))
        for k in range(0, len(others), step):
            there = others[k : k + step]
            c = squares(centers[own].T, centers[there].T) * (sizes[own, None] * sizes[None, there]) / (sizes[own, None] + sizes[None, there])
            c[own[:, None] == there[None]] = np.inf
            at = c.argmin(axis=1)
            found = c[np.arange(len(own)), at]
            better = found < cost
            partner[better], cost[better] = there[at[better]], found[better]
        return partner, cost

    for g in range(start, stop):
        own = members[starts[g] : starts[g + 1]]
        own = own[asked[own]]
        if not len(own):
            continue
        gap = np.maximum(0.0, np.maximum(low - centers[own].max(axis=0), centers[own].min(axis=0) - high))
        size = sizes[own].min()
        bound = (gap * gap).sum(axis=1) * (size * least_size) / (size + least_size)
        first = np.argpartition(bound, 8)[:8] if len(bound) > 8 else np.arange(len(bound))
        most = search(own, first)[1].max()
        partner, cost = search(own, np.flatnonzero(bound * (1 - 1e-9) <= most))
        who.append(own)
        best.append(partner)
        least.append(cost)
    empty = [np.empty(0)]
    return {"i": np.concatenate(who or empty).astype(np.int64), "best": np.concatenate(best or empty).astype(np.int64), "least": np.concatenate(least or empty)}


def _search(spark: SparkSession, centers: np.ndarray, sizes: np.ndarray, asked: np.ndarray, local: int) -> tuple[np.ndarray, ...]:
    """:func:`_nearest` of all clusters asked for, by tasks where more than ``local`` clusters are left."""
    groups = _leaves(centers, sizes)
    n, arrays = len(groups[1]) - 1, (centers, sizes, asked, *groups)
    if len(sizes) <= local:
        found = _nearest(*arrays, 0, n)
        return found["i"], found["best"], found["least"]
    t = dealt(spark, n, arrays, _nearest, "i long, best long, least double", 0).toArrow()
    return t["i"].to_numpy(), t["best"].to_numpy(), t["least"].to_numpy()


def ward_clusters(df: DataFrame, id_column: str, columns: list[str], k: int, local: int = 4096) -> DataFrame:
    """(id, cluster) of every row of ``df`` by Ward clustering, labels from 0 in the order of smallest ids.

    Equal rows merge first, at no cost.  Then each round merges all pairs that are each
    other's nearest.  A merged cluster is never nearer to others than its parts, so the tree
    is that of merging one pair at a time (as :func:`ward` does), and only clusters whose
    nearest has merged look for another; the ``n - k`` lowest merges give the clusters.  The
    nearest are searched by tasks while more than ``local`` clusters are left: exact, by
    bounds of groups, which takes about (n / 64)² steps and near groups' pairs; the driver
    holds one centre per row.
    """
    spark = df.sparkSession
    rows = df.select(id_column, *[F.col(c).cast("double") for c in columns]).toArrow()
    rows = rows.take(pc.sort_indices(rows[id_column]))
    n = len(rows)
    values = np.stack([rows[c].to_numpy() for c in columns], axis=1) if n else np.empty((0, len(columns)))
    _, first, same, sizes = np.unique(values, axis=0, return_index=True, return_inverse=True, return_counts=True)
    owner = first[same.reshape(-1)]
    order = np.argsort(first)
    first, sizes = first[order], sizes[order].astype(float)
    centers, height = values[first], np.zeros(len(first))
    copies = np.flatnonzero(owner != np.arange(n))
    merges: list[tuple[np.ndarray, ...]] = [(np.zeros(len(copies)), np.zeros(len(copies), int), owner[copies], copies)]
    best, least, asked = np.full(len(first), -1), np.full(len(first), np.inf), np.ones(len(first), bool)
    while len(first) > 1:
        m = len(first)
        i, partner, cost = _search(spark, centers, sizes, asked, local)
        best[i], least[i] = partner, cost
        i = np.flatnonzero((best[best] == np.arange(m)) & (best > np.arange(m)))
        if not len(i):
            # Ties can leave a ring of nearest ones; looked for anew, the first of a tie counts for all.
            if asked.all():
                raise ValueError("values are missing")
            asked[:] = True
            continue
        j = best[i]
        height[i] = np.maximum(least[i], np.maximum(height[i], height[j]))
        merges.append((height[i].copy(), np.full(len(i), len(merges)), first[i], first[j]))
        centers[i] = (centers[i] * sizes[i, None] + centers[j] * sizes[j, None]) / (sizes[i] + sizes[j])[:, None]
        sizes[i] += sizes[j]
        moved = np.zeros(m, bool)
        moved[i] = moved[j] = True
        asked = moved | moved[best]
        keep = np.ones(m, bool)
        keep[j] = False
        best = (np.cumsum(keep) - 1)[best]
        centers, sizes, first, height, best, least, asked = (v[keep] for v in (centers, sizes, first, height, best, least, asked))
    into = np.arange(n)
    h, at, i, j = (np.concatenate(x) for x in zip(*merges, strict=True))
    lowest = np.lexsort((j, i, at, h))[: max(0, n - k)]
    into[j[lowest]] = i[lowest]
    for x in range(n):
        into[x] = into[into[x]]
    labels = np.unique(into, return_inverse=True)[1]
    return spark.createDataFrame(pa.table({id_column: rows[id_column], "cluster": pa.array(labels.astype(np.int64))}))


def silhouettes(df: DataFrame, id_column: str, columns: list[str], label: str) -> DataFrame:
    """(id, label, silhouette) of each row: how much nearer its own cluster is than the next one; 0 for a cluster of one.

    All distances are needed.  Rows travel to the tasks as arrays in the order of their
    clusters; a task adds up distances of its rows tile by tile, so no pair becomes a row.
    """
    spark = df.sparkSession
    t = df.select(F.col(id_column).alias("id"), F.col(label).alias("own"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)]).toArrow()
    known = t.filter(pc.is_valid(t["own"])).sort_by([("own", "ascending"), ("id", "ascending")])
    codes = known["own"].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    n = len(known)
    at = points(known, [f"_{k}" for k in range(len(columns))])
    sums = dealt(spark, n, (at, starts, False), distance_sums, "i long, g long, d double", n * n)
    groups = spark.createDataFrame(pa.table({"g": np.arange(len(starts)), "size": np.diff(starts, append=n)}))
    size, mine = F.col("size"), F.col("g") == F.col("own")
    rows = spark.createDataFrame(pa.table({"i": pa.array(np.arange(n)), "own": pa.array(codes.astype(np.int64)), "id": known["id"], "name": known["own"]}))
    by = sums.join(F.broadcast(groups), "g").join(rows, "i").groupBy("i", "id", "name").agg(F.max(F.when(mine, F.try_divide("d", F.nullif(size - 1, F.lit(0))))).alias("a"), F.min(F.when(~mine, F.col("d") / size)).alias("b"))
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.nullif(F.greatest("a", "b"), F.lit(0.0))), F.lit(0.0))
    out = by.select(F.col("id").alias(id_column), F.col("name").alias(label), score.alias("silhouette"))
    return out.unionByName(df.where(F.col(label).isNull()).select(id_column, label, F.lit(0.0).alias("silhouette")))


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(labels)) != i)
        a = d[i, same].mean() if same.any() else 0.0
        b = min(d[i, labels == other].mean() for other in set(labels.tolist()) - {own})
        scores.append((b - a) / max(a, b) if same.any() else 0.0)
    return float(np.mean(scores))
