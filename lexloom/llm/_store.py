"""Intermediate tables in the shared folder that the cluster names.

A written table cuts the lineage and survives the loss of executors. The folder comes from ``spark.checkpoint.dir``; only a session
on one machine (tests) may leave it unset and gets a temporary folder. Tables are dropped as soon as nothing reads them; those that
a returned result reads stay until ``clean``.
"""

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_kept: set[str] = set()
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("2147483647", str(16 << 20))}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate files; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + os.path.abspath(_own[0])


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _kept.add(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop(spark: SparkSession, *tables) -> None:
    """Delete intermediate tables (results of ``staged``, or paths) on whatever file system holds them."""
    jvm = spark._jvm
    for t in tables:
        path = t if isinstance(t, str) else t._staged
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _kept.discard(path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process. Results that read them can't be used any more."""
    drop(spark, *list(_kept))


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: bound Arrow batches in rows and bytes, unless the session has limits of its own."""
    for name, (usual, ours) in _BATCH.items():
        if spark.conf.get(name, usual) in (usual, "-1"):
            spark.conf.set(name, ours)


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL; made on the driver, and sent with a task's function."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_texts(df: DataFrame, kept: list[str], added: str, work, arrow: bool = False) -> DataFrame:
    """``kept`` columns of ``df`` as they are, and the columns of the DDL ``added`` that ``work`` makes of its texts.

    ``work`` is called once a partition and gives a function from a list (or Arrow array) of texts to an iterator of (slice,
    {column: values}) that cover it in order. It may give a second function, which is called at the partition's end. Other
    columns never pass through Python values, so nulls and large numbers stay exact.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(added).fields
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    def run(batches):
        import pyarrow as pa

        each = work()
        each, end = each if isinstance(each, tuple) else (each, None)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            texts = texts if arrow else texts.to_pylist()
            for part, values in each(texts):
                n = part.stop - part.start
                columns = {c: batch.column(batch.schema.get_field_index(c)).slice(part.start, n) for c in kept}
                columns |= {c: v if isinstance(v, pa.Array) else pa.array(v, t) for (c, t), v in zip(types.items(), (values[c] for c in types))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        if end:
            end()
        # Workers outlive tasks: give back what allocators keep.
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    schema = StructType([df.schema[c] for c in kept] + fields)
    return df.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)
