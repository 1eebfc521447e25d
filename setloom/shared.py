"""Tables in the folder that the cluster shares.

A table written here cuts lineage, outlives a lost executor and is read in parts of its own, so a join with it can be
split where a key is frequent. The folder is the one named by ``spark.checkpoint.dir``; only a local session without that
setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that are there.
written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="setloom-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/setloom/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, only: list[str] | None = None) -> None:
    """Delete every table that :func:`stash` wrote, or those at the paths in ``only``. Results that still read them stop working."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in list(written if only is None else only):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in written:
            written.remove(name)
    if only is not None:
        only.clear()
