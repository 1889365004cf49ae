"""Helpers that the operators share: scratch tables in the shared folder, table reading."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
TEXT_ROWS = 1000
#: Rows to a partition of packed().
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset and the master is local, as
    in tests, a temporary folder is made and set; on a cluster an unset folder is an error.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/maskframe/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in as few partitions as they fill, but one a core: a table written by each of many
    tasks is many small files, and without Hadoop's native library executors start two processes for each. Only for
    what is light after its last shuffle."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width; bucket counts follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, tag: str, cols_hint: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as a table bucketed by ``key`` in the warehouse, so that later joins on ``key``
    do not shuffle it again. Returns the table and its name (drop it when done)."""
    spark = df.sparkSession
    name = f"maskframe_{tag}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(cols_hint or partitions(spark), key).saveAsTable(name)
    return spark.table(name), name


def drop(spark: SparkSession, *names: str) -> None:
    """Drop scratch tables that nothing lazy depends on any more."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text binary) for Arrow functions. Texts are long, so the session's Arrow batches are held to
    ``TEXT_ROWS`` rows: a batch and its copies must fit beside the executor's heap."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def give_back() -> None:
    """What this process has freed goes back to the system; allocators keep it else."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function on a task's batches that gives back at its end what it has freed: Python workers stay, and
    beside the executor's heap the idle ones of earlier stages take room from those at work."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def id_ddl(df: DataFrame, col: str) -> str:
    """The type of a column as DDL."""
    return df.schema[col].dataType.simpleString()


def mark(text_col: str = "text") -> Column:
    """128 bits that tell the texts of rows with one id apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a decision about a row is keyed by: rows without an id come last, rows of one id are told
    apart by their texts."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), mark(text_col).alias("mark"))


def without(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose row_key() is not among the ``key`` of ``rejected``; columns unchanged. A
    row without an id is judged by its text, and a row that shares its id with a rejected one stays."""
    gone = rejected.select(F.col("key.id").alias("__id"), F.col("key.mark").alias("__mark")).distinct()
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (mark(text_col) == F.col("__mark")), "left_anti")


def join_split(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, spread: Column) -> DataFrame:
    """``rows`` left-joined to ``lookup`` (a row a key) on ``key``, with the rows of hot keys dealt out.

    ``counts`` is (key, n). A key is hot if it has over one of the shuffle's partitions of all rows, so there
    are fewer hot keys than partitions, and only they are broadcast; their lookup rows are repeated for each
    partition, and ``spread`` deals out their rows."""
    parts = partitions(rows.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(materialize(counts.where(F.col("n") * parts > total).select(F.col(key).alias("__hot")), "hot"))
    some = F.col("__hot").isNotNull()
    left = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(some, F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int")).drop("__hot")
    right = lookup.join(hot, F.col(key) == F.col("__hot"), "left")
    right = right.withColumn("__salt", F.explode(F.when(some, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return left.join(right, [key, "__salt"], "left").drop("__salt")
