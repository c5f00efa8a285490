"""Cubes from streams: watermarked windows of statistics and states, and open runs of a state.

These go beyond batch cubes: late cells are taken until the watermark has passed, and
results of a window appear once it cannot change any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stats import compare


def read_cells(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Cells as Parquet files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_stats(cells: DataFrame, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Count, mean and population variance per pixel and window of event time."""
    w = F.window("time", window, slide) if slide else F.window("time", window)
    return cells.withWatermark("time", late).groupBy(w, "y", "x").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "y", "x", "n", "mean", "variance")


def windowed_states(cells: DataFrame, threshold: float, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """How many cells reach a threshold, per window."""
    hit = compare(F.col("value"), threshold, ">=")
    return cells.withWatermark("time", late).groupBy(F.window("time", window)).agg(F.count_if(hit).alias("n_active"), F.count("value").alias("n")).select(F.col("window.start").alias("start"), "n_active", "n")


RUNS = "y long, x long, start timestamp, end timestamp, duration long, peak double, open boolean"
OPEN_RUN = "start timestamp, end timestamp, duration long, peak double"


def track_runs(cells: DataFrame, threshold: float, max_gap_days: int = 0, late: str = "2 days") -> DataFrame:
    """Runs of cells at or above a threshold, pixel by pixel, across batches.

    A run is reported with ``open`` when it has grown, and once more when a later cell has
    closed it.  The state of a pixel is its open run alone, however long the stream lasts.
    A late cell inside the open run counts towards it and moves neither end; one close enough
    before it moves the start; one further back is a run of its own, reported as closed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = list(state.get) if state.exists else None
        out = []
        cells = pd.concat(list(batches)).sort_values("time")
        for time, value in zip(cells["time"], cells["value"], strict=True):
            if value is None or not value >= threshold:
                continue
            alone = [time, time, 1, float(value)]
            if current is not None and (current[0] - time).days - 1 > max_gap_days:
                out.append((*key, *alone, False))
                continue
            if current is not None and (time - current[1]).days - 1 > max_gap_days:
                out.append((*key, *current, False))
                current = None
            current = alone if current is None else [min(current[0], time), max(current[1], time), current[2] + 1, max(current[3], float(value))]
        if current is not None:
            state.update(tuple(current))
            out.append((*key, *current, True))
        yield pd.DataFrame(out, columns=["y", "x", "start", "end", "duration", "peak", "open"])

    return cells.withWatermark("time", late).groupBy("y", "x").applyInPandasWithState(run, RUNS, OPEN_RUN, "append", GroupStateTimeout.NoTimeout)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream as Parquet; what is committed is not written twice after a restart."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
