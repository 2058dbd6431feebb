"""What the operators need from a cluster: the package on every executor and a shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    path = os.path.join(tempfile.mkdtemp(), "tessera_package.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    sc.addPyFile(path)
    sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: the cluster's own cleaning of the folder remains
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def handing_back(batches: Iterator) -> Iterator:
    """The batches; once they are through, what they took goes back to the system, as Spark keeps a worker for later tasks."""
    try:
        yield from batches
    finally:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps it
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh_names(*names: str) -> list[str]:
    """Column names that no table has."""
    return [f"_{x}_{uuid.uuid4().hex}" for x in names]


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that have been written as tables: Spark deletes them once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
