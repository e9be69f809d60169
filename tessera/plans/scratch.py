"""Durable intermediate tables.

Lineage is cut by writing Parquet under the folder that ``spark.checkpoint.dir``
names, which every executor and the driver share.  Losing an executor therefore
costs a re-read, never a recomputation of the steps before.

Operators ``discard`` a table as soon as the tables made from it are written.  What a lazy result
still reads stays until the session's owner calls ``clear`` or empties the folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; a folder of our own only in local mode where the session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(_remove, _OWN[app])
    return _OWN[app]


def _remove(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the files (column order and types are kept).

    The copy has no known partitioning, so a later join deals both sides anew and
    adaptive execution can split a skewed key.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables in the session's folder; results that were not written yet are lost."""
    _delete(spark, f"{shared_dir(spark)}/tessera")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
