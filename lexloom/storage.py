"""Cutting lineage in the shared folder that the cluster names."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: set[str] = set()


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + os.path.abspath(_own[0])


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once, as a table under ``spark.checkpoint.dir``, so that it survives lost executors and the planner knows its
    size. Only a session on one machine may leave the folder unset and gets a temporary one."""
    path = f"{_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to some tasks a core: a small file is one task's, however long its rows are worked on."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def clean(spark: SparkSession) -> None:
    """Delete the tables of this process. Results that read them can't be used any more."""
    for path in list(_written):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.discard(path)
