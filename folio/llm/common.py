"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``body``: the text as bytes, null as empty; other columns and their names play no part."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("body"))


def row_key(docs: DataFrame) -> DataFrame:
    """Add ``k1``, ``k2``: a key of (doc_id, body) for joins.

    Rows that share it are copies of one row and get one result; a null ``doc_id`` is an ordinary value.
    """
    return docs.withColumns({"k1": F.coalesce("doc_id", F.lit(-1)).cast("bigint"), "k2": F.xxhash64("body")})


def tasks(spark: SparkSession) -> int:
    """Partition count of the shuffles, as the session names it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most`` bytes, one row at least; a null has none."""
    for batch in batches:
        start, used = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            if used and used + n > most:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if start < batch.num_rows:
            yield batch.slice(start)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after the last one the worker gives free memory back, as it lives on beside later tasks."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


BUCKETS = 1 << 20


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")


def parted(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` may be among ``keys``, and rows for which that is ruled out.

    Only the hash buckets that ``keys`` fall into are broadcast, ``BUCKETS`` numbers at most, so long rows that have no
    partner need no shuffle; when the keys fill all buckets, every row is in the first part.  Null keys have no partner.
    """
    hit = F.broadcast(keys.where(F.col(key).isNotNull()).select(_bucket(key)).distinct())
    rows = df.withColumn("_bucket", F.when(F.col(key).isNotNull(), _bucket(key)))
    return rows.join(hit, "_bucket", "left_semi").drop("_bucket"), rows.join(hit, "_bucket", "left_anti").drop("_bucket")
