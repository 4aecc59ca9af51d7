"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.session import checkpoint_dir, ship_package

#: Rows and bytes of one Arrow batch sent to a Python worker; bound the worker's memory (a
#: longer text makes a batch of its own).
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 8 << 20
#: Characters of text that a worker turns into words at a time.
CHARS_PER_CHUNK = 2_000_000


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, package on the workers, bounded Arrow batches."""
    checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name and first position: extra columns whose names
    clash (other case, repeated) are left behind instead of making a reference ambiguous."""
    cols = df.columns
    return (df.toDF(*[f"c{i}" for i in range(len(cols))])
            .select(*[F.col(f"c{cols.index(n)}").alias(n) for n in names]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text (fold 0)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col) == 0


_TABLES: dict = {}  # of a worker process: tables that outlive a task
_GC = gc.get_threshold()


def keep_tables(key, make: Callable):
    """``make()``, kept in this worker process for later tasks that ask for the same ``key``.  Only
    one lives at a time, and only until a task of an operator without tables runs here: a
    worker serves all operators of an application and would hold what each of them left."""
    if key not in _TABLES:
        drop_tables()
        _TABLES[key] = make()
        gc.collect()
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)
    return _TABLES[key]


def drop_tables() -> None:
    if _TABLES:
        _TABLES.clear()
        gc.unfreeze()  # states point at each other: only the collector frees them
        gc.set_threshold(*_GC)
        gc.collect()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str, tables: bool = False) -> DataFrame:
    """``fn`` over Arrow batches; ``tables``: it asks for :func:`keep_tables`."""
    prepare(df.sparkSession)

    def run(batches):
        drop_tables()
        yield from fn(batches)

    return df.mapInArrow(fn if tables else run, schema)


def chunks(rows: Iterable, size: Callable, limit: int = CHARS_PER_CHUNK) -> Iterator[list]:
    """Lists of consecutive rows of about ``limit`` characters; a longer row stands alone."""
    part, n = [], 0
    for r in rows:
        s = size(r)
        if part and n + s > limit:
            yield part
            part, n = [], 0
        part.append(r)
        n += s
    if part:
        yield part


def bounded_sample(labels: DataFrame, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` rows, chosen by a hash of the id: the same rows on every run
    and at any partitioning (before the final limit, which only trims chance excess)."""
    n = labels.count()
    if n <= max_rows:
        return labels
    share = int(1_000_000 * max_rows * 0.97 / n)
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000))
    return labels.where(u < share).orderBy(u, id_col).limit(max_rows)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of a bounded sample of labelled rows outside the held-out fold.

    Only the sampled ids are joined, so whole texts are read but not shuffled.
    """
    lab = (pick(labels, "doc_id", label).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()
                                               & ~held_out())
           .groupBy("doc_id").agg(F.max(label).cast("double").alias("y")))
    lab = bounded_sample(lab, max_rows)
    return (pick(docs, "doc_id", "text").where(~held_out())
            .join(F.broadcast(lab), "doc_id")  # at most max_rows rows of two numbers
            .select("doc_id", "text", "y"))
