"""Events: runs of a state in time, their catalog, their cells, and one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.stats import days
from ..plans.cube import KEYS, PIXEL, Cube
from ..plans.pipe import verb


def _islands(states: Cube, max_gap: int) -> DataFrame:
    """All cells, numbered by the run that began last; up to ``max_gap`` other steps do not end a run."""
    w = states.along_time()
    before = F.last(F.when(F.col("state"), F.col("t_idx")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("state") & (before.isNull() | (F.col("t_idx") - before - 1 > max_gap))
    marked = states.df.withColumn("_new", F.when(fresh, 1).otherwise(0))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("island") > 0).drop("_new")


@verb
def detect_events(states: Cube, min_duration: int = 1, max_gap: int = 0) -> DataFrame:
    """The catalog of runs with at least ``min_duration`` active steps.

    ``duration`` counts active steps only; peak, mean and integral take in the magnitudes of
    bridged gap steps too.  Ids run by row, column and time from 1.  Everything per pixel
    shares one partitioning by pixel, and cells are read once: a run's last active step tells
    which of its cells count.
    """
    run = [*PIXEL, "island"]
    last = F.max(F.when(F.col("state"), F.col("t_idx"))).over(Window.partitionBy(*run))
    cells = _islands(states, max_gap).withColumn("t1", last).where(F.col("t_idx") <= F.col("t1"))
    active = lambda c: F.when(F.col("state"), F.col(c))
    events = cells.groupBy(*run, "y_idx", "x_idx", "t1").agg(
        F.min(active("t_idx")).alias("t0"), F.min(active("time")).alias("start"), F.max(active("time")).alias("end"), F.count(active("t_idx")).alias("duration"),
        F.max("magnitude").alias("peak"), F.avg("magnitude").alias("mean"), F.sum("magnitude").alias("integral"),
    ).where(F.col("duration") >= min_duration)
    by_pixel = Window.partitionBy(*PIXEL).orderBy("t0")
    events = events.withColumns({"sequence_index": F.row_number().over(by_pixel), "time_since_previous_event": F.datediff("start", F.lag("end").over(by_pixel)).cast("double")})
    return numbered(events, "y_idx", ["x_idx", "t0"], "event_id").select(
        "event_id",
        *PIXEL,
        F.col("y_idx").alias("y_index"),
        F.col("x_idx").alias("x_index"),
        "t0",
        "t1",
        "start",
        "end",
        "duration",
        "peak",
        "mean",
        "integral",
        "sequence_index",
        "time_since_previous_event",
    )


def event_cube(states: Cube, catalog: DataFrame) -> DataFrame:
    """Each cell with the event it lies in, gap steps included; ``event_active`` is the raw state inside events."""
    fields = ["event_id", "start", "end", "duration", "peak", "mean", "integral", "sequence_index", "time_since_previous_event"]
    spans = catalog.select(*PIXEL, F.explode(F.sequence("t0", "t1")).alias("t_idx"), (F.col("t0")).alias("_t0"), *fields)
    out = states.df.join(spans, [*PIXEL, "t_idx"], "left")
    named = [F.col(f).alias(f if f == "event_id" or f.startswith(("sequence", "time")) else f"event_{f}") for f in fields]
    inside = F.col("event_id").isNotNull()
    return out.select(*KEYS, (inside & F.col("state")).alias("event_active"), *named, (F.col("t_idx") - F.col("_t0")).alias("event_age"))


@verb
def event_centered(cube: Cube, catalog: DataFrame, before: int, after: int) -> DataFrame:
    """Values at lags -before..after around each event's start."""
    lags = catalog.select("event_id", *PIXEL, F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("lag"), F.col("t0"))
    return lags.withColumn("t_idx", F.col("t0") + F.col("lag")).join(cube.df.select(*PIXEL, "t_idx", cube.variable), [*PIXEL, "t_idx"]).select("event_id", "lag", F.col(cube.variable).alias("value"))


def greedy(candidates: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """One-to-one choice from (distance, source, target) in that order."""
    used_s, used_t, out = set(), set(), []
    for _, s, t in sorted(candidates):
        if s not in used_s and t not in used_t:
            used_s.add(s)
            used_t.add(t)
            out.append((s, t))
    return out


def greedy_rounds(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`greedy` of many pairs of series at once: (pair, place in ``a``, place in ``b``) of each match.

    ``a`` and ``b`` hold a row of days for each pair, of which the first ``na`` and ``nb``
    count.  A round takes the best candidate left of every pair.  Long series go pair by pair.
    """
    ks, kt, none = a.shape[1], b.shape[1], np.empty(0, np.int64)
    if not len(a) or not ks or not kt:
        return none, none, none
    if ks * kt > 1024:
        parts = []
        for p in range(len(a)):
            d = np.abs(b[p, None, : nb[p]] - a[p, : na[p], None])
            i, j = np.nonzero(d <= tolerance)
            parts += [(p, *m) for m in greedy(list(zip(d[i, j].tolist(), i.tolist(), j.tolist(), strict=True)))]
        found = np.array(parts, np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]
    cells = np.arange(ks * kt, dtype=a.dtype).reshape(ks, kt, 1)
    key = np.abs(b.T[None] - a.T[:, None])
    out = (key > tolerance) | (np.arange(ks)[:, None, None] >= na) | (np.arange(kt)[None, :, None] >= nb)
    big = np.iinfo(key.dtype).max
    key = np.where(out, big, np.where(out, 0, key) * (ks * kt) + cells)
    found = []
    while True:
        best = key.min(axis=(0, 1))
        pair = np.flatnonzero(best < big)
        if not len(pair):
            break
        i, j = np.divmod(best[pair] % (ks * kt), kt)
        found.append((pair, i, j))
        key[i, :, pair] = big
        key[:, j, pair] = big
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def candidate_matches(source: DataFrame, target: DataFrame, on: list[str], tolerance: str | int | None = None, anchor: str = "start") -> DataFrame:
    """Pairs of events of one group whose anchors are at most the tolerance apart.

    Anchors are dealt into spans of the tolerance's length, and only neighbouring spans meet.
    """
    if anchor not in ("start", "end"):
        raise ValueError("anchor is start or end")
    tol = days(tolerance) or 0
    width = max(tol, 1)
    cell = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    fields = ("event_id", "start", "end", "duration")
    s = source.select(*on, *[F.col(f).alias(f"source_{f}") for f in fields], cell(anchor).alias("_cell"))
    t = target.select(*on, *[F.col(f).alias(f"target_{f}") for f in fields], F.explode(F.array(*[cell(anchor) + d for d in (-1, 0, 1)])).alias("_cell"))
    lag = F.datediff(f"target_{anchor}", f"source_{anchor}")
    return s.join(t, [*on, "_cell"]).withColumn("lag_days", lag).withColumn("abs_lag_days", F.abs("lag_days")).where(F.col("abs_lag_days") <= tol).drop("_cell")


def match_events(source: DataFrame, target: DataFrame, on: list[str], tolerance: str | int | None = None, anchor: str = "start") -> DataFrame:
    """Greedy one-to-one matches by (absolute lag, source id, target id) inside each group ``on``.

    Candidates are sorted by group in their partitions and read once; a task holds what the
    group at hand has used, whatever the number and size of groups.
    """
    pairs = candidate_matches(source, target, on, tolerance, anchor)
    order = [*on, "abs_lag_days", "source_event_id", "target_event_id"]
    narrow = pairs.select(*order).repartition(*on).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used_s, used_t = None, set(), set()
        for batch in batches:
            names = zip(*(batch.column(c).to_pylist() for c in on), strict=True)
            keep = []
            for i, (g, s, t) in enumerate(zip(names, batch.column("source_event_id").to_pylist(), batch.column("target_event_id").to_pylist(), strict=True)):
                if g != group:
                    group, used_s, used_t = g, set(), set()
                if s not in used_s and t not in used_t:
                    used_s.add(s)
                    used_t.add(t)
                    keep.append(i)
            yield batch.select([*on, "abs_lag_days", "source_event_id", "target_event_id"]).take(pa.array(keep, pa.int64()))

    kinds = dict(narrow.dtypes)
    chosen = narrow.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in order)).drop("abs_lag_days")
    return pairs.join(chosen, [*on, "source_event_id", "target_event_id"])
