"""Session helpers: the shared folder for published tables and checkpoints."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach, as named by ``spark.checkpoint.dir``.

    Only where that setting is missing (tests on one machine) is a local folder made and set.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        at = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        sc.setCheckpointDir(at)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_made: dict[str, list[str]] = {}  # by application


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; see :func:`drop_scratch`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this application has written to the shared folder. Results that are still to be read need it: call this
    when they have been."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    The files of the shuffles behind it are of no more use; Spark removes them once the collector has seen that nothing
    refers to them, so the driver is asked to collect.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python stages can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("blockloom", os.path.relpath(full, root)))
    to = f"{shared_dir(spark)}/blockloom-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, False)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
