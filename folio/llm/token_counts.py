"""Token counts of documents in flat, unindexed token files.

Method: separator scan.  A file is a run of ids in which an end-of-document id closes each document.  Blocks of it are
searched for that id as arrays; a document cut by block edges is stitched by a prefix scan over one summary row a
block: where the block lies in its file, how many documents ended before it, and where the last one ended.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import blocks, register, table, texts
from folio.operators.ordering import with_running
from folio.session import materialise

SEPARATOR = 50256
DTYPE = "<u2"
FILE_BLOCK = 1 << 20
BLOCK_BYTES = 4_000_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_blocks(docs: DataFrame, path: str, pattern: str, *, separator: int = SEPARATOR, dtype: str = DTYPE, size: int = FILE_BLOCK) -> DataFrame:
    """Flat token files of ``docs``, one a partition, in blocks of ``size`` bytes cut without regard to documents.

    (file, block, data, doc_ids): ``doc_ids`` lists the documents whose text was encoded while the block filled, in the
    order of the file; it is the writer's record and no part of the file.
    """

    def run(batches):
        enc, file = _encoding(path, pattern), TaskContext.get().partitionId()
        end = np.array([separator], dtype).tobytes()
        held, ids, block = bytearray(), [], 0

        def out(data, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([bytes(data)], pa.binary()), pa.array([ids], pa.list_(pa.int64()))],
                names=["file", "block", "data", "doc_ids"])

        for b in blocks(batches, "body", BLOCK_BYTES):
            for doc_id, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                held += np.array(enc.encode_ordinary(body.decode()), dtype).tobytes() + end
                ids.append(doc_id)
                while len(held) >= size:
                    yield out(held[:size], ids)
                    held, ids, block = held[size:], [], block + 1
        if held or ids:
            yield out(held, ids)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "file bigint, block bigint, data binary, doc_ids array<bigint>")


def read_token_files(spark: SparkSession, path: str, size: int = FILE_BLOCK) -> DataFrame:
    """(file, block, data) of binary token files (each below 2 GB, as one row must hold it)."""
    found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    cut = F.expr(f"explode(sequence(0L, greatest(0L, (length - 1) div {size})))")
    return found.select("file", cut.alias("block"), "content").select("file", "block", F.expr(f"substring(content, int(block * {size} + 1), {size})").alias("data"))


def token_counts(files: DataFrame, *, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): every document of ``files`` (file, block, data) in the order of the file.

    ``n_tokens`` leaves the separator out; two separators in a row close an empty document.  Ids after the last
    separator are a document that is not ``closed``.  Null or empty blocks hold nothing; an empty table gives no rows.
    A block must hold whole ids (else the task fails).  Blocks of a file are ordered by ``block`` and may be numbered with gaps.
    """
    width = np.dtype(dtype).itemsize
    summary = pa.schema([("n", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def scan(batches):
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("data")[i].as_py() or b""
                if len(data) % width:
                    raise ValueError("a block ends within an id")
                ids = np.frombuffer(data, dtype)
                ends = np.nonzero(ids == separator)[0]
                yield pa.RecordBatch.from_arrays(
                    [b.column("file").slice(i, 1), b.column("block").slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", *summary.names])

    kind = files.schema["file"].dataType.simpleString()
    found = materialise(files.select("file", "block", "data").mapInArrow(scan, f"file {kind}, block bigint, n bigint, ends array<bigint>"))
    narrow = found.select("file", "block", "n", F.size("ends").cast("bigint").alias("closes"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    placed = with_running(narrow, "file", "block", F.col("n"), "sum", "at", inclusive=False)
    placed = with_running(placed, "file", "block", F.col("closes"), "sum", "before", inclusive=False)
    placed = with_running(placed.withColumn("end", F.col("at") + F.col("last") + 1), "file", "block", F.col("end"), "max", "open_from", inclusive=False)
    stitched = found.join(placed.select("file", "block", "at", "before", F.coalesce("open_from", F.lit(0)).alias("open_from")), ["file", "block"])
    closed = stitched.select("file", "at", "before", "open_from", "ends", F.posexplode("ends").alias("i", "end")).withColumn("start", F.expr("if(i = 0, open_from, at + ends[i - 1] + 1)"))
    whole = closed.select("file", (F.col("before") + F.col("i")).alias("ordinal"), "start", (F.col("at") + F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    files_end = stitched.groupBy("file").agg(
        F.max(F.col("at") + F.col("n")).alias("total"), F.max(F.greatest(F.col("open_from"), F.col("at") + F.try_element_at("ends", F.lit(-1)) + 1)).alias("start"),
        F.max(F.col("before") + F.size("ends")).alias("ordinal"))
    rest = files_end.where("total > start").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return whole.unionByName(rest)


@register
def op6_token_counts(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    files = materialise(token_blocks(table(spark, sf, "documents"), path, public_tokenizers.PATTERN))
    counted = token_counts(files.select("file", "block", "data"))
    listed = files.select("file", "block", F.size("doc_ids").cast("bigint").alias("n"))
    first = with_running(listed, "file", "block", F.col("n"), "sum", "before", inclusive=False).select("file", "block", F.coalesce("before", F.lit(0)).alias("before"))
    named = files.select("file", "block", F.posexplode("doc_ids").alias("i", "doc_id")).join(first, ["file", "block"]).select(
        "file", (F.col("before") + F.col("i")).alias("ordinal"), "doc_id")
    return counted.join(named, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
