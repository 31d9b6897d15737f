"""What every operator needs from the session: shipped code, a shared folder, cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker, where the session doesn't say.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python workers, once an application.

    Sets the session's bound on the bytes of an Arrow batch, unless it has one: the default
    bounds rows only, so that long texts make batches of any size.
    """
    sc = spark.sparkContext
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    target = os.path.join(tempfile.mkdtemp(), "quadrat_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the session names in spark.checkpoint.dir; only where that is unset
    (local tests) a temporary folder is made and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isDefined():
            named = option.get()
        else:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quadrat-"))
            named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/") + "/quadrat"


def _clean(spark: SparkSession, path: str) -> None:
    """Delete what an application has put into the shared folder; nothing if it is gone already."""
    if path.startswith(("file:", "/")):  # also where the session was stopped before
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # at exit: the session may have been stopped
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, in a folder of this application that goes when it ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_clean, spark, folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and return the table.

    Cuts the lineage as checkpoint() does, but computes df once and survives lost executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
