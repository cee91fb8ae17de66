"""Shared pieces of the corpus operators: scratch tables, Arrow maps, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a worker keeps from task to task; a task that doesn't keep it lets it go before it begins.
KEPT: dict = {}
#: Java and RE2 class of the bytes that separate words.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and the
    executors are threads of the driver (tests) a temporary folder is made and
    set. On a cluster an unset folder is an error: local disks aren't shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files go when the write is done: what reads the table needs none of them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts lineage in files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, key: str, *parts: str) -> DataFrame:
    """A table in the warehouse in buckets by ``key``: joins on it move only the other side. It is partitioned by ``parts``."""
    spark = df.sparkSession
    name = f"scratch_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_end(spark):
        df.write.format("parquet").partitionBy(*parts).bucketBy(n, key).saveAsTable(name)
    out = spark.table(name)
    out._scratch_table = name
    return out


def emptied(df: DataFrame, part: str) -> None:
    """Remove the rows of one partition of a table made by ``bucketed``; ``part`` is its SQL, like ``kind = 1``."""
    spark = df.sparkSession
    column = part.split("=")[0].strip()
    rest = ", ".join(f"CAST(NULL AS {kind}) AS `{c}`" for c, kind in df.dtypes if c != column)
    spark.sql(f"INSERT OVERWRITE TABLE {df._scratch_table} PARTITION ({part}) SELECT {rest} WHERE false")
    spark.catalog.refreshTable(df._scratch_table)


def dropped(df: DataFrame) -> None:
    """Drop a table made by ``bucketed`` that nothing reads any more."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._scratch_table}")


def discard(df: DataFrame) -> None:
    """Remove a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as tell it from the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _give_back() -> None:
    """Return a worker's free memory to the machine: idle workers stay, beside the executor's own heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _let_go() -> None:
    """Empty what earlier tasks of this worker left for their like; workers outlive a job."""
    if KEPT:
        KEPT.clear()
        _give_back()


def arrow_map(
    df: DataFrame,
    rows: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]],
    schema: str,
    keeps: bool = False,
) -> DataFrame:
    """``mapInArrow`` for a generator that yields dicts of equally long columns.

    ``schema`` is Spark DDL; the columns are cast to it. Tasks with ``keeps``
    find what earlier ones of the worker left in ``KEPT``, others empty it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        if not keeps:
            _let_go()
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                    for f in target
                ],
                schema=target,
            )
            columns = None
        _give_back()

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]

