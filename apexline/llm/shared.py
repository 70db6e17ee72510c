"""Tables in the folder that the driver and every executor share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="apexline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/apexline/{uuid.uuid4().hex}/{name}"


#: Rows and bytes that a Python worker gets at once while a table is written: documents may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Writes inside hand few rows at once to Python, or as few as the session says; its settings are as before afterwards."""
    before = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, v in BATCH.items():
            if not (before[k].isdigit() and 0 < int(before[k]) < int(v)):
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete a table made by :func:`kept` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lean(run):
    """``run``, a function for ``mapInArrow``, that gives its memory back to the machine when its task ends.

    Python workers are used again by later stages; what an allocator keeps for
    itself would add up over them.
    """

    def task(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        from . import words

        try:
            yield from run(batches)
        finally:
            words.forget()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def with_struct(df: DataFrame, name: str, struct: T.StructType, task) -> DataFrame:
    """``df`` and a struct column; keeps all columns.

    ``task()`` gives the function of one task, which turns a record batch into a dict of arrays.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = list(to_arrow_schema(struct))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = task()
        for batch in batches:
            made = function(batch)
            arrays = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in fields]
            column = pa.StructArray.from_arrays([a.cast(f.type) for a, f in zip(arrays, fields, strict=True)], fields=fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(name, struct)]))
