"""Pairs of pixels and how far their states and events coincide."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dealing import dealt
from ..functions.numbering import numbered
from ..functions.scratch import cut
from ..functions.stats import array_mean, array_pearson, array_ranks, days, haversine, pearson_from_sums
from ..plans.cube import KEYS, PIXEL, Cube
from ..plans.pipe import verb
from .events import greedy_rounds
from .rolling import windows

#: Most words of 64 times that a pair keeps in columns.
WORDS = 16
#: Tasks that share the pixels of a square.
DEAL = 8
#: Targets of a tile of pairs.
TILE = 256
MODES = ("reference", "neighbors", "all_pairs", "regional", "blocks")


def pixel_ids(cube: Cube) -> DataFrame:
    """(pixel, y, x, y_idx, x_idx): pixels numbered row by row; as many rows as pixels."""
    return numbered(cube.pixels(), "y_idx", ["x_idx"], "pixel", start=0)


def _distance(a: str, b: str) -> Column:
    f = lambda s, c: F.col(f"{s}_{c}").cast("double")
    return haversine(f(a, "y"), f(a, "x"), f(b, "y"), f(b, "x"))


def _side(p: DataFrame, name: str) -> DataFrame:
    return p.select(F.col("pixel").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in p.columns if c != "pixel"])


def _label(side: str) -> Column:
    return F.concat(F.lit("y="), F.col(f"{side}_y").cast("string"), F.lit(",x="), F.col(f"{side}_x").cast("string"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(source, target, their labels, no distance): all pairs of the blocks of ``blocks(block, ...)`` in the order of their names."""
    names = blocks.select("block").distinct().withColumn("pixel", (F.row_number().over(Window.orderBy("block")) - 1).cast("long"))
    a, b = (names.select(F.col("pixel").alias(s), F.col("block").alias(f"{s}_label")) for s in ("source", "target"))
    return a.join(b, F.col("source") < F.col("target")).select("source", "target", F.lit(None).cast("double").alias("distance"), "source_label", "target_label")


def spatial_pairs(cube: Cube | DataFrame, mode: str = "reference", reference: tuple[int, int] | int | None = None, radius_km: float | None = None, k: int | None = None, series: DataFrame | None = None) -> DataFrame:
    """Pixel pairs (pair, source, target, their coordinates, distance).

    ``reference``: every pixel, itself included, with one pixel (a flat number, a (row,
    column) position, or the centre if None).  ``neighbors``: i < j within ``radius_km``, or
    the union of each pixel's ``k`` nearest (ties to the lower number), or all.  ``blocks``:
    pairs of named blocks, see :func:`block_pairs`.  The other modes: all i < j.  A radius
    meets only pixels of neighbouring grid squares, and so do nearest pixels, in squares that
    grow until each has enough of them.  Columns of ``series(y, x, ...)`` go along with the
    pixels, so that no pair has to be joined with them.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "blocks":
        return block_pairs(cube)
    p = pixel_ids(cube)
    if series is not None:
        p = p.join(series, [*PIXEL])
    if mode == "reference":
        if isinstance(reference, int):
            chosen = p.where(F.col("pixel") == reference)
        elif reference is not None:
            chosen = p.where((F.col("y_idx") == reference[0]) & (F.col("x_idx") == reference[1]))
        else:
            mid = p.agg(F.floor((F.max("y_idx") + 1) / 2).cast("int").alias("_cy"), F.floor((F.max("x_idx") + 1) / 2).cast("int").alias("_cx"))
            chosen = p.join(F.broadcast(mid), (F.col("y_idx") == F.col("_cy")) & (F.col("x_idx") == F.col("_cx"))).drop("_cy", "_cx")
        pairs = _side(p, "source").crossJoin(F.broadcast(_side(chosen, "target")))
    elif mode == "neighbors" and k is not None:
        near = _nearest(p.select("pixel", *PIXEL, "y_idx", "x_idx"), k, radius_km)
        pairs = near.join(_side(p, "source"), "source").join(_side(p, "target"), "target")
    elif mode == "neighbors" and radius_km is not None:
        pairs = _near(p, p, radius_km).where(F.col("source") < F.col("target"))
    else:
        pairs = _every(p)
    pairs = pairs.withColumn("distance", _distance("source", "target"))
    if mode == "neighbors" and radius_km is not None:
        pairs = pairs.where(F.col("distance") <= radius_km)
    carried = [] if series is None else [f"{s}_{c}" for s in ("source", "target") for c in series.columns if c not in PIXEL]
    return pairs.select("source", "target", *[f"{s}_{c}" for s in ("source", "target") for c in PIXEL], "distance", _label("source").alias("source_label"), _label("target").alias("target_label"), *carried)


def _every(p: DataFrame) -> DataFrame:
    """All pairs source < target, tile by tile: some sources, each with the same block of targets.

    The pairs are as many as they are, but what a source's rows hold recurs with the next
    source, near enough for a page of a file to be compressed: places recur as they are, and
    distances shifted, for which every eighth source comes next (encoded values are packed by
    eights).  Few pixels make many pairs, so tiles are dealt to tasks by number, not by the
    bytes read.
    """
    n = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * p.sparkSession.sparkContext.defaultParallelism)
    size = F.max("pixel").cast("double") + 1
    few = F.least(F.lit(2 * TILE), F.ceil(size * size / (32 * n * F.least(F.lit(float(TILE)), size)) / 8) * 8)
    sides = p.agg(few.alias("_few"), F.floor(F.max("pixel") / TILE).alias("_end"))
    blocks = p.crossJoin(F.broadcast(sides)).withColumns({"_own": F.expr("pixel div _few"), "_block": F.floor(F.col("pixel") / TILE)})
    struct = F.struct("pixel", *[c for c in p.columns if c != "pixel"])

    def rows(packed: DataFrame, name: str) -> DataFrame:
        return packed.select("_block", F.explode("_rows").alias("_r")).select("_block", *[F.col(f"_r.{c}").alias(name if c == "pixel" else f"{name}_{c}") for c in p.columns])

    # Arrays keep their order where a sort below a join would be dropped.
    targets = rows(blocks.groupBy("_block").agg(F.sort_array(F.collect_list(struct)).alias("_rows")), "target")
    sources = blocks.groupBy("_own").agg(F.min("_block").alias("_first"), F.max("_end").alias("_end"), F.sort_array(F.collect_list(F.struct((F.col("pixel") % 8).alias("_by"), struct.alias("_s"))))["_s"].alias("_rows"))
    tiles = sources.select("_own", "_rows", F.explode(F.sequence("_first", "_end")).alias("_block")).repartition(n, "_own", "_block")
    return rows(tiles, "source").join(F.broadcast(targets), "_block").where(F.col("source") < F.col("target")).drop("_block")


def _near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pixels of ``a`` with others of ``b`` in the same or neighbouring squares with a side of at least the radius.

    For degrees a square spans the radius along the meridian, and in longitude as much as
    the radius spans at the pixel farthest from the equator.
    """
    box = b.agg(F.max(F.abs(F.col("y").cast("double"))).alias("_ymax"), F.max(F.abs(F.col("x").cast("double"))).alias("_xmax"))
    degrees = (F.col("_ymax") <= 90) & (F.col("_xmax") <= 180)
    dy = F.when(degrees, F.lit(radius / 111.0)).otherwise(F.lit(radius))
    dx = F.when(degrees, F.lit(radius / 111.0) / F.greatest(F.cos(F.radians(F.least(F.col("_ymax") + F.lit(radius / 111.0), F.lit(89.9)))), F.lit(1e-3))).otherwise(F.lit(radius))
    squared = lambda p: p.crossJoin(F.broadcast(box)).withColumns({"_cy": F.floor(F.col("y") / dy), "_cx": F.floor(F.col("x") / dx)}).drop("_ymax", "_xmax")
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = _side(squared(a), "source").withColumnsRenamed({"source__cy": "_cy", "source__cx": "_cx"})
    right = _side(squared(b), "target").withColumn("_o", offsets).withColumns({"_cy": F.col("target__cy") + F.col("_o.i"), "_cx": F.col("target__cx") + F.col("_o.j")}).drop("_o", "target__cy", "target__cx")
    # Squares can be few: the pixels of one are dealt to several tasks, whose number does not go by the bytes read but by the pairs made.
    keys, n = ["_cy", "_cx", "_deal"], int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("_deal", F.pmod("source", F.lit(DEAL)).cast("int")).repartition(n, *keys)
    right = right.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))).repartition(n, *keys)
    return left.join(right, keys).where(F.col("source") != F.col("target")).drop(*keys)


def _nearest(p: DataFrame, k: int, radius_km: float | None) -> DataFrame:
    """(source, target), source < target: the union of each pixel's ``k`` nearest, none beyond the radius.

    The squares' side begins at about the distance that holds k pixels and doubles for the
    pixels that have not found as many yet.
    """
    n, y0, y1, x0, x1, far = p.agg(F.count(F.lit(1)), *[f(F.col(c).cast("double")) for c in ("y", "x") for f in (F.min, F.max)], F.max(F.abs(F.col("y").cast("double")))).first()
    ends = p.select(F.lit(None).cast("long").alias("source"), F.lit(None).cast("long").alias("target")).limit(0)
    if not n or k < 1:
        return ends
    degrees = far <= 90 and max(abs(x0), abs(x1)) <= 180
    high, wide = ((y1 - y0) * 111.0, (x1 - x0) * 111.0 * max(0.05, math.cos(math.radians(min(far, 89.0))))) if degrees else (y1 - y0, x1 - x0)
    whole = max(20_100.0 if degrees else math.hypot(high, wide), 1e-9) * 1.01
    side = min(whole, max(whole * 1e-6, math.sqrt(max(high, whole * 1e-3) * max(wide, whole * 1e-3) * (k + 1) / n)))
    left, found = p, []
    while True:
        last = side >= min(whole, radius_km or whole)
        side = min(side, radius_km or whole) if last else side
        # Only what lies within the side is sure to be complete.
        near = _near(left, p, side) if side < whole else _side(left, "source").join(_side(p, "target"), F.col("source") != F.col("target"))
        near = near.withColumn("distance", _distance("source", "target")).where(F.col("distance") <= (radius_km if last and radius_km else side if not last else float("inf")))
        ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy("source").orderBy(F.round("distance", 9), "target"))).where(F.col("_rank") <= k).select("source", "target", "_rank")
        ranked = cut(ranked)
        done = ranked.where(F.col("_rank") == k).select("source")
        found.append(ranked.select("source", "target") if last else ranked.join(done, "source", "left_semi").select("source", "target"))
        if last:
            break
        left = cut(left.join(done, left["pixel"] == done["source"], "left_anti"))
        if left.isEmpty():
            break
        side *= 2
    every = functools.reduce(DataFrame.unionByName, found)
    return every.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def _bitmaps(states: Cube) -> DataFrame:
    """One row per pixel with its states as words of 64 times: ``on`` where the state holds, ``known`` where there is one."""
    bit = F.expr("shiftleft(1L, t_idx % 64)")
    word = F.floor(F.col("t_idx") / 64).cast("int").alias("word")
    zero = F.lit(0).cast("long")
    words = states.df.groupBy(*PIXEL, word).agg(F.bit_or(F.when(F.col("state"), bit).otherwise(zero)).alias("on"), F.bit_or(F.when(F.col("state").isNotNull(), bit).otherwise(zero)).alias("known"))
    return words.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("word", "on", "known"))).alias("words"))


def _masks(cube: Cube, window: str | int | None, stride: int) -> DataFrame:
    """(window_end, mask): the times of each window as words of 64."""
    last = cube.times().agg(F.max("t_idx").alias("_last"))
    bounds = _window_bounds(cube, window, stride).crossJoin(F.broadcast(last))
    part = "shiftleft(-1L, greatest(_w0 - 64 * k, 0)) & shiftrightunsigned(-1L, 63 - least(_w1 - 64 * k, 63))"
    return bounds.select("window_end", F.expr(f"transform(sequence(0, cast(floor(_last / 64) AS int)), k -> CASE WHEN _w1 >= 64 * k AND _w0 <= 64 * k + 63 THEN {part} ELSE 0L END)").alias("mask"))


def _series(cube: Cube, columns: list[str]) -> DataFrame:
    """One row per pixel with its cells packed into an array by time: pairs then hold series, not cells."""
    return cube.df.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("t_idx", *columns))).alias("cells"))


def _window_bounds(cube: Cube, window: str | int | None, stride: int) -> DataFrame:
    return windows(cube, window, None, stride).groupBy("window_end").agg(F.min("t_idx").alias("_w0"), F.max("t_idx").alias("_w1"))


@verb
def occurrence_synchrony(states: Cube, mode: str = "reference", window: str | int | None = None, stride: int = 1, **pairing) -> DataFrame:
    """Jaccard, joint probability and phi of the states of each pair, by window.

    A pixel's states are a few words of bits, so a pair's counts are bit counts of words,
    and a window is a mask over them.
    """
    pairs = spatial_pairs(states, mode, series=_bitmaps(states), **pairing)
    plain = [c for c in pairs.columns if not c.endswith("_words")]
    names = ("joint", "union", "n", "na", "nb")

    def parts(a: Column, b: Column) -> list[Column]:
        return [a["on"].bitwiseAND(b["on"]), a["on"].bitwiseOR(b["on"]), a["known"].bitwiseAND(b["known"]), a["on"].bitwiseAND(b["known"]), b["on"].bitwiseAND(a["known"])]

    # Words of a pair are columns, so that windows over them need no array functions, which Spark interprets; only longer series go on in arrays.
    last = states.times().agg(F.max("t_idx")).first()[0]
    size = 1 if last is None else last // 64 + 1
    words = min(size, WORDS)
    first = [x.alias(f"_{name}{k}") for k in range(words) for name, x in zip(names, parts(F.get("source_words", F.lit(k)), F.get("target_words", F.lit(k))), strict=True)]
    masks = _masks(states, window, stride)
    masks = masks.select("window_end", *[F.get("mask", F.lit(k)).alias(f"_m{k}") for k in range(words)], *([F.slice("mask", words + 1, F.size("mask")).alias("_rest_mask")] if size > words else []))
    rest = [F.arrays_zip(*[F.slice(f"{s}_words", words + 1, F.size(f"{s}_words")).alias(s[0]) for s in ("source", "target")]).alias("_rest")] if size > words else []
    both = pairs.select(*plain, *first, *rest).crossJoin(F.broadcast(masks))

    def count(i: int, name: str) -> Column:
        near = sum((F.coalesce(F.bit_count(F.col(f"_{name}{k}").bitwiseAND(F.col(f"_m{k}"))), F.lit(0)) for k in range(words)), F.lit(0))
        if size > words:
            near += F.aggregate(F.zip_with("_rest", "_rest_mask", lambda z, m: F.bit_count(parts(z["s"], z["t"])[i].bitwiseAND(m))), F.lit(0), lambda acc, c: acc + c)
        return near.cast("double").alias(name)

    c = both.select("window_end", *plain, *[count(i, name) for i, name in enumerate(names)])
    n, a, b, j = (F.col(x) for x in ("n", "na", "nb", "joint"))
    denominator = F.sqrt(a * (n - a) * b * (n - b))
    return c.withColumns({"jaccard": F.try_divide(j, F.nullif("union", F.lit(0.0))), "joint_probability": F.try_divide(j, F.nullif(n, F.lit(0.0))), "phi": F.try_divide(n * j - a * b, F.nullif(denominator, F.lit(0.0)))}).drop("na", "nb")


@verb
def severity_synchrony(states: Cube, mode: str = "reference", method: str = "spearman", min_joint: int = 10, window: str | int | None = None, stride: int = 1, **pairing) -> DataFrame:
    """Correlation of magnitudes where both states hold; null below ``min_joint`` such times.

    A pair and window is one row: the times at which both hold are filtered, ranked and
    summed up inside arrays.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError("method is spearman or pearson")
    pairs = spatial_pairs(states, mode, series=_series(states, ["state", "magnitude"]), **pairing)
    plain = [c for c in pairs.columns if not c.endswith("_cells")]
    usable = lambda z: z["p"]["state"] & z["q"]["state"] & z["p"]["magnitude"].isNotNull() & z["q"]["magnitude"].isNotNull()
    joint = F.transform(F.filter(F.arrays_zip(F.col("source_cells").alias("p"), F.col("target_cells").alias("q")), usable), lambda z: F.struct(z["p"]["t_idx"].alias("t"), z["p"]["magnitude"].alias("x"), z["q"]["magnitude"].alias("y")))
    both = pairs.select(*plain, joint.alias("_z")).crossJoin(F.broadcast(_window_bounds(states, window, stride)))
    both = both.withColumn("_z", F.filter("_z", lambda z: z["t"].between(F.col("_w0"), F.col("_w1"))))
    x, y, n = F.col("_z.x"), F.col("_z.y"), F.size("_z")
    score = array_pearson(array_ranks(x), array_ranks(y)) if method == "spearman" else array_pearson(x, y)
    return both.select(
        "window_end", *plain, n.cast("long").alias("n_joint"), F.when(n >= min_joint, score).alias("severity"),
        array_mean(x).alias("mean_source"), array_mean(y).alias("mean_target"), array_mean(F.transform("_z", lambda z: F.abs(z["x"] - z["y"]))).alias("mean_abs_difference"),
    )


#: What a pair carries to where its events are matched; labels and distance follow from it again.
_ENDS = ("source", "target", "source_y", "source_x", "target_y", "target_x")


def _match_pairs(catalog: DataFrame, pairs: DataFrame, tolerance: str | int | None, result: Callable[..., dict], columns: str, unmatched: bool) -> DataFrame:
    """What ``result(pair, lag, a, b, events, n_source, n_target)`` makes of the matches of a batch of pairs: greedy, by (absolute lag, source id, target id).

    The catalog travels to the pairs as arrays, so that neither candidates nor matches are
    shuffled or sorted.  ``pair`` is the place in the batch, ``a`` and ``b`` are places in
    ``events`` (event_id, duration).  A result has either one row for each pair, or for each
    match with the pair's place as ``_at``.  ``unmatched``: pairs without events, too.
    """
    spark, tol = pairs.sparkSession, days(tolerance) or 0
    t = catalog.select(*PIXEL, "event_id", F.datediff("start", F.lit("1970-01-01")).alias("day"), "duration").toArrow().sort_by([("y", "ascending"), ("x", "ascending"), ("event_id", "ascending")])
    fresh = np.ones(len(t), bool)
    fresh[1:] = (np.diff(t["y"].to_numpy()) != 0) | (np.diff(t["x"].to_numpy()) != 0)
    first = np.flatnonzero(fresh)
    # The place of a pixel without events, -1, has none.
    sent = spark.sparkContext.broadcast((np.append(first, 0), np.append(np.diff(first, append=len(t)), 0), t["day"].to_numpy().astype(np.int32), t["event_id"].to_numpy(), t["duration"].to_numpy()))
    places = spark.createDataFrame(pa.table({"y": t["y"].take(first), "x": t["x"].take(first), "at": np.arange(len(first))}), catalog.select(*PIXEL).schema.add("at", "long"))
    kept = pairs.select(*_ENDS)
    for s in ("source", "target"):
        kept = kept.join(F.broadcast(places.select(F.col("y").alias(f"{s}_y"), F.col("x").alias(f"{s}_x"), F.col("at").alias(f"_{s}"))), [f"{s}_y", f"{s}_x"], "left" if unmatched else "inner")
    kept = kept.select(*_ENDS, *[F.coalesce(f"_{s}", F.lit(-1)).alias(f"_{s}") for s in ("source", "target")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count, day, ids, duration = sent.value
        for batch in batches:
            s, u = (batch.column(c).to_numpy() for c in ("_source", "_target"))
            ks, kt = (int(count[x].max(initial=0)) for x in (s, u))
            rows = [day[np.minimum(first[x][:, None] + np.arange(k), len(day) - 1)] if k else np.empty((len(x), 0), np.int32) for x, k in ((s, ks), (u, kt))]
            pair, i, j = greedy_rounds(rows[0], count[s], rows[1], count[u], tol)
            order = np.argsort(pair, kind="stable")
            pair, a, b = pair[order], (first[s[pair]] + i)[order], (first[u[pair]] + j)[order]
            made = result(pair, day[b] - day[a], a, b, (ids, duration), count[s], count[u])
            ends = batch.select(list(_ENDS))
            if "_at" in made:
                ends = ends.take(pa.array(made.pop("_at")))
            yield pa.RecordBatch.from_arrays([*ends.columns, *[pa.array(v) for v in made.values()]], names=[*_ENDS, *made])

    kinds = dict(kept.dtypes)
    out = kept.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in _ENDS) + ", " + columns)
    return out.withColumns({"distance": _distance("source", "target"), "source_label": _label("source"), "target_label": _label("target")})


def _matched(catalog: DataFrame, pairs: DataFrame, tolerance: str | int | None) -> DataFrame:
    def result(pair, lag, a, b, events, n_source, n_target) -> dict:
        ids, duration = events
        return {"_at": pair, "source_event_id": ids[a], "target_event_id": ids[b], "source_duration": duration[a], "target_duration": duration[b], "lag_days": lag.astype(np.int32), "abs_lag_days": np.abs(lag).astype(np.int32)}

    return _match_pairs(catalog, pairs, tolerance, result, "source_event_id long, target_event_id long, source_duration long, target_duration long, lag_days int, abs_lag_days int", False)


def _mean(pair: np.ndarray, values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Means by pair; null for none."""
    return pa.array(np.bincount(pair, values, len(n)) / np.maximum(n, 1), mask=n == 0)


@verb
def timing_synchrony(states: Cube, catalog: DataFrame, mode: str = "neighbors", tolerance: str | int = "7D", kernel: str = "exponential", tau: float = 7.0, **pairing) -> DataFrame:
    """Mean closeness in time of matched events of each pair, with lags and events left unmatched."""
    scale = days(tau) if isinstance(tau, str) else tau

    def result(pair, lag, a, b, events, n_source, n_target) -> dict:
        gap = np.abs(lag).astype(float)
        n = np.bincount(pair, minlength=len(n_source))
        ordered = gap[np.lexsort((gap, pair))]
        begin = np.cumsum(n) - n
        middle = lambda k: ordered[np.minimum(begin + k, max(len(ordered) - 1, 0))] if len(ordered) else np.zeros(len(n))
        median = pa.array((middle(np.maximum(n - 1, 0) // 2) + middle(n // 2)) / 2, mask=n == 0)
        score = np.exp(-gap / scale) if kernel == "exponential" else 1 / (1 + gap)
        return {"timing": _mean(pair, score, n), "mean_lag": _mean(pair, lag, n), "median_abs_lag": median, "n_matched": n, "unmatched_source": n_source - n, "unmatched_target": n_target - n}

    return _match_pairs(catalog, spatial_pairs(states, mode, **pairing), tolerance, result, "timing double, mean_lag double, median_abs_lag double, n_matched long, unmatched_source long, unmatched_target long", True)


@verb
def duration_synchrony(states: Cube, catalog: DataFrame, mode: str = "neighbors", tolerance: str | int = "7D", min_matches: int = 3, **pairing) -> DataFrame:
    """Agreement of the durations of matched events of each pair."""

    def result(pair, lag, a, b, events, n_source, n_target) -> dict:
        x, y = (events[1][k].astype(float) for k in (a, b))
        n = np.bincount(pair, minlength=len(n_source))
        sums = {name: np.bincount(pair, v, len(n)) for name, v in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))}
        return {"n_matched": n, **sums, "similarity": _mean(pair, 1 - np.abs(x - y) / np.maximum(np.maximum(x, y), 1), n), "mean_difference": _mean(pair, x - y, n)}

    out = _match_pairs(catalog, spatial_pairs(states, mode, **pairing), tolerance, result, "n_matched long, sx double, sy double, sxx double, syy double, sxy double, similarity double, mean_difference double", True)
    r = pearson_from_sums(F.nullif("n_matched", F.lit(0)), *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")])
    return out.withColumn("correlation", F.when(F.col("n_matched") >= min_matches, r)).drop("sx", "sy", "sxx", "syy", "sxy")


@verb
def sync_with(left: Cube, right: Cube, lags: list[int]) -> DataFrame:
    """Jaccard of left[t] with right[t + lag] at each pixel and lag; times without a partner do not count."""
    both = left.df.select(*KEYS, F.col("state").alias("a")).join(right.df.select(*KEYS, F.col("state").alias("b")), [*KEYS])
    w = Window.partitionBy(*PIXEL).orderBy("time")
    shifted = both.select(*PIXEL, "a", *[F.lead("b", lag).over(w).alias(f"b{i}") if lag >= 0 else F.lag("b", -lag).over(w).alias(f"b{i}") for i, lag in enumerate(lags)])
    count = lambda c: F.count(F.when(c, 1)).cast("double")
    scores = []
    for i in range(len(lags)):
        b = F.col(f"b{i}")
        valid = F.col("a").isNotNull() & b.isNotNull()
        scores.append(F.try_divide(count(valid & F.col("a") & b), F.nullif(count(valid & (F.col("a") | b)), F.lit(0.0))).alias(f"s{i}"))
    wide = shifted.groupBy(*PIXEL).agg(*scores)
    return wide.select(*PIXEL, F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(lag).alias("lag"), F.col(f"s{i}").alias("score")) for i, lag in enumerate(lags)])).alias("_e")).select(*PIXEL, "_e.*")


def best_lag(scores: DataFrame) -> DataFrame:
    """The first lag with the greatest score of each pixel; null scores do not count."""
    top = scores.groupBy(*PIXEL).agg(F.max_by("lag", F.when(F.col("score").isNotNull(), F.struct("score", -F.col("ord")))).alias("best_lag"), F.max("score").alias("best_score"))
    return top


def edge_to_map(edges: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """Each pixel's mean of every metric over its edges; a pair of a pixel with itself counts once."""
    end = lambda s: F.struct(F.col(f"{s}_y").alias("y"), F.col(f"{s}_x").alias("x"))
    ends = edges.withColumn("_p", F.explode(F.array_distinct(F.array(end("source"), end("target")))))
    return ends.groupBy(*(by or []), F.col("_p.y").alias("y"), F.col("_p.x").alias("x")).agg(*[F.avg(m).alias(m) for m in metrics])


def reference_map(edges: DataFrame, metric: str) -> DataFrame:
    """In reference mode each source pixel has a single value."""
    keys = [c for c in ("window_end",) if c in edges.columns]
    return edges.select(*keys, F.col("source_y").alias("y"), F.col("source_x").alias("x"), metric)


def regional_occurrence(states: Cube, window: str | int | None = None, stride: int = 1) -> DataFrame:
    """:func:`regional_summary` of the Jaccard scores of all pairs of pixels, without a row for each pair.

    In a window, pixels with the same states are alike: pairs of patterns stand for pairs of
    pixels and count as often.  A window of n times has 2^n patterns at most, and never more
    than pixels.  The mean distance takes all pairs of pixels, as arrays.  All pixels of a
    dense cube have a state at every time.
    """
    spark = states.df.sparkSession
    packed = _bitmaps(states).select(F.col("words.on").alias("on"))
    masks = _masks(states, window, stride)
    seen = packed.groupBy("on").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(masks)).select("window_end", F.zip_with("on", "mask", lambda a, m: a.bitwiseAND(m)).alias("on"), "n")
    patterns = seen.groupBy("window_end", "on").agg(F.sum("n").alias("n"))
    # Blocks of patterns meet in the tasks; each pair of patterns once, a pattern with itself as often as two of its pixels.
    blocks = 8
    dealt_out = patterns.withColumn("_b", F.pmod(F.xxhash64("on"), F.lit(blocks)).cast("int"))
    block = dealt_out.groupBy("window_end", "_b").agg(F.collect_list("on").alias("on"), F.collect_list("n").alias("n"))
    a, b = (block.select("window_end", *[F.col(c).alias(f"{s}_{c}") for c in ("_b", "on", "n")]) for s in ("p", "q"))
    met = a.join(b, "window_end").where(F.col("p__b") <= F.col("q__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].values for c in ("p_on", "q_on", "p_n", "q_n")}
                p, q = (np.array(r[c].to_pylist(), np.int64).reshape(len(r[c]), -1).view(np.uint64) for c in ("p_on", "q_on"))
                n, m = (r[c].to_numpy() for c in ("p_n", "q_n"))
                same, counts = batch.column("p__b")[k].as_py() == batch.column("q__b")[k].as_py(), {}
                for i in range(0, len(p), step := max(1, 500_000 // max(1, len(q)))):
                    rows = slice(i, i + step)
                    joint = sum((np.bitwise_count(p[rows, w, None] & q[None, :, w]).astype(np.int64) for w in range(p.shape[1])))
                    union = sum((np.bitwise_count(p[rows, w, None] | q[None, :, w]).astype(np.int64) for w in range(p.shape[1])))
                    times = n[rows, None] * m[None]
                    if same:
                        at = np.arange(len(p))[rows, None]
                        own = n[rows, None] * (n[rows, None] - 1) // 2
                        times = np.where(at < np.arange(len(q))[None], times, np.where(at == np.arange(len(q))[None], own, 0))
                    wide = int(union.max(initial=0)) + 1
                    key, back = np.unique((joint * wide + union).ravel(), return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, back, times.ravel())
                    for c, t in zip(key.tolist(), total.tolist(), strict=True):
                        counts[divmod(c, wide)] = counts.get(divmod(c, wide), 0) + t
                kept = [(j, u, t) for (j, u), t in counts.items() if t]
                yield pa.RecordBatch.from_arrays([batch.column("window_end").take(pa.array([k] * len(kept), pa.int64())), *[pa.array([x[c] for x in kept], pa.int64()) for c in range(3)]], names=["window_end", "joint", "union", "n"])

    kind = dict(met.dtypes)["window_end"]
    scores = met.mapInArrow(run, f"window_end {kind}, joint long, union long, n long").groupBy("window_end", "joint", "union").agg(F.sum("n").alias("n"))
    jaccard, n = F.try_divide("joint", F.nullif("union", F.lit(0))), F.col("n")
    summed = scores.withColumn("jaccard", jaccard).groupBy("window_end").agg(
        F.try_divide(F.sum(F.col("jaccard") * n), F.sum(F.when(F.col("jaccard").isNotNull(), n))).alias("mean_jaccard"),
        F.percentile("jaccard", F.lit(0.5), n).alias("median_jaccard"), F.sum("n").alias("n_pairs"),
    )
    return summed.crossJoin(F.broadcast(_mean_distance(spark, states)))


def _mean_distance(spark: SparkSession, cube: Cube) -> DataFrame:
    """(mean_distance): that of all pairs of pixels."""
    t = cube.pixels().select(*[F.col(c).cast("double") for c in PIXEL]).toArrow()
    y, x = (t[c].to_numpy() for c in PIXEL)
    n = len(y)

    def add(y: np.ndarray, x: np.ndarray, start: int, stop: int) -> dict:
        total = 0.0
        with np.errstate(invalid="ignore"):
            degrees = (np.abs(y) <= 90) & (np.abs(x) <= 180)
            for i in range(start, stop):
                d = np.sqrt((y[i + 1 :] - y[i]) ** 2 + (x[i + 1 :] - x[i]) ** 2)
                if degrees[i]:
                    at = np.flatnonzero(degrees[i + 1 :])
                    p, q = np.radians(y[i]), np.radians(y[i + 1 :][at])
                    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(x[i + 1 :][at] - x[i]) / 2) ** 2
                    d[at] = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, a)))
                total += float(d.sum())
        return {"d": [total]}

    pairs = n * (n - 1) // 2
    return dealt(spark, n, (y, x), add, "d double", n * n).agg((F.sum("d") / F.nullif(F.lit(pairs), F.lit(0))).alias("mean_distance"))


def regional_summary(edges: DataFrame, metric: str) -> DataFrame:
    """Mean and median over pairs, pairs (those without a value too) and mean distance, by window."""
    keys = [c for c in ("window_end",) if c in edges.columns]
    return edges.groupBy(*keys).agg(F.avg(metric).alias(f"mean_{metric}"), F.percentile(metric, F.lit(0.5)).alias(f"median_{metric}"), F.count(F.lit(1)).alias("n_pairs"), F.avg("distance").alias("mean_distance"))
