"""Tables that are derived once and then scanned: kept as clustered Parquet in the cluster's shared folder for the session's lifetime."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import files

FOLDER = "spark.checkpoint.dir"
_made: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and the master is one machine, a temporary one that goes at exit."""
    there = spark.conf.get(FOLDER, None)
    if not there:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {FOLDER} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        there = f"file://{folder}"
        spark.conf.set(FOLDER, there)
    return there.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The table ``name``, written by ``make`` at the first call of this application, sorted by ``by`` for pruning."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        path = fresh(spark, "table")
        files.write_clustered(make(), path, by)
        _made[key] = path
    return spark.read.parquet(_made[key])
