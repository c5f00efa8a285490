"""Intermediate data in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate data: ``spark.checkpoint.dir``.

    Only on a single machine (tests) it may be unset; a folder beside the warehouse's
    tables is taken then, and removed at exit.  On a cluster that is an error, for executors
    would write to folders of their own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch-{sc.applicationId}"
            atexit.register(shutil.rmtree, urlsplit(named).path, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
