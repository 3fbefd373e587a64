"""What driver and executors share: the package itself, and tables written once to cut lineage."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executor is
    the driver itself gets a temporary one; any other is refused, as its executors could not see such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loamgrid-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: When memory was last released, and the least seconds between two times.
_RELEASED, _EVERY = [0.0], 5.0


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner find shuffles that no plan needs any more, whose files it would keep until the driver's memory fills."""
    if time.monotonic() - _RELEASED[0] > _EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _RELEASED[0] = time.monotonic()


def stored(df: DataFrame, freeing: Iterable[DataFrame] = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The files of ``freeing``, stored tables that nothing but ``df`` reads, go at
    once; its own go when the session ends, or when they are freed in turn.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loamgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _located(spark, path)
    fs.deleteOnExit(at)
    for old in freeing:
        free(old)
    _release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _located(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def free(df: DataFrame) -> None:
    """Deletes the files of a table that stored() gave; nothing may read it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        fs, at = _located(df.sparkSession, path)
        fs.delete(at, True)
        df._stored_at = None


_SHIPPED: set[str] = set()


#: Bytes of rows that Spark hands to a Python worker at once; its default of 64 MB is held several times over in each.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, for those that do not have it installed, and bounds Python's batches."""
    spark.conf.set(_BATCH[0], str(_BATCH[1]))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="loamgrid-")  # Spark serves the file from here to the end
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "loamgrid"), "zip", root, "loamgrid"))
        _SHIPPED.add(sc.applicationId)
