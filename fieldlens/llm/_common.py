"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fieldlens-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Paths of the tables that each open ``noted`` has seen written, innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: later stages survive the loss of an executor without
    recomputing what came before, and joins start from exchanges of their own,
    which adaptive execution can split when a key is hot.  The table stays as long
    as the folder, unless a caller has it ``noted`` and discards it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldlens/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables from the shared folder."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def noted() -> Iterator[list[str]]:
    """Gets the paths of the tables that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.pop()
        if _open:
            _open[-1].extend(paths)


def kept_table(spark: SparkSession, make, name: str) -> DataFrame:
    """The table that ``make()`` gives, stored; what was stored on the way is removed."""
    path = f"{shared_dir(spark)}/fieldlens/{name}-{uuid.uuid4().hex}"
    with noted() as paths:
        df = make()
        schema = df.schema
        df.write.parquet(path)
    discard(spark, paths)
    return spark.read.schema(schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores put in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_or_empty(name: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def binary_list(column) -> list:
    """An Arrow text column as bytes, nulls as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session.

    Texts have no bounded length, and ten thousand of them at once, the default,
    make buffers that neither Python nor the JVM's allocators give back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def lean(run):
    """A mapInArrow function that gives memory back to the system at its end.

    Python workers are used again by later tasks, and what the allocators keep
    of one task's peak would add up over the stages of a job.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not in this C library
        pass


def slices(batch, rows: int = 500):
    """A batch in parts of at most ``rows`` rows, without copies."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))
