"""What the corpus operators share: words, keys, and tables written to the cluster's shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables written within `temporary`.
MADE: ContextVar[list[DataFrame] | None] = ContextVar("MADE", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so lost executors cost no recomputation."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    if (made := MADE.get()) is not None:
        made.append(table)
    return table


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `written` makes within are deleted at the end, but those given to what this yields."""
    made: list[DataFrame] = []
    token = MADE.set(made)

    def keep(table: DataFrame) -> DataFrame:
        made[:] = [x for x in made if x is not table]
        return table

    try:
        yield keep
    finally:
        MADE.reset(token)
        removed(spark, *made)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a frame whose counted rows are within limit; beyond it, Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def arrow_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> None:
    """Bounds the rows and bytes of the session's Arrow batches, so that batches with very long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, and after it freed memory goes back to the system: Python workers are used again by later stages."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for table in tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def split_of(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def prefix_for(columns: list[str]) -> str:
    """Underscores that none of the columns begins with: for names that can't clash."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
