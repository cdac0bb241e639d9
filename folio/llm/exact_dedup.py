"""Exact deduplication as a stateful stream.

Method: every row goes through a Structured Streaming aggregation keyed by the text's digest.  The state store is
disk-backed (RocksDB) and never expires; for each digest it retains the number of rows and, of the row that stays, the
stable identifier and a content locator.  Rows whose digest was met before are hits; their full text is compared with
the text at the locator before they count as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import ORACLES, parted, register, table
from folio.session import materialise, scratch_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def tagged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as ``row`` with ``digest``, ``doc_id`` and ``locator``, a number of its own for every row.

    The locator holds only while the rows are not computed anew, so the result is written before it is used.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)).alias("digest"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("locator"),
    )


def keyed_state(stream: DataFrame, place: tuple[str, ...] = ("locator",)) -> DataFrame:
    """Per digest: rows so far and the row that stays, the one with the largest (doc_id, ``place``); nulls come last."""
    best = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", *place)
    return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(best).alias("keep"))


def run_stream(spark: SparkSession, source: str, schema, home: str, place: tuple[str, ...] = ("locator",)) -> None:
    """Feed the files in ``source`` not fed before to the state kept in ``home``."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        stream = keyed_state(spark.readStream.schema(schema).parquet(source), place)
        stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", home).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state(spark: SparkSession, home: str) -> DataFrame:
    """digest, group_size, keep: the state as of the last finished batch; empty state gives no rows."""
    read = spark.read.format("statestore").load(home)
    return read.select("key.digest", F.col("value.count").alias("group_size"), F.col("value.max").alias("keep"))


def narrow_hits(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Locators of the rows whose digest had been met, less those that stay."""
    return rows.join(repeated, "digest").where("locator <> keep.locator").select("locator")


def deduplicate(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, digest, doc_id, locator) as a written table, and a decision for every one of them.

    Decisions: locator, doc_id, keep_id, group_size, kept, text_sha256.  Texts are equal when their bytes are; null counts
    as empty, and all empty texts are one group.  Of equal texts the row with the largest ``doc_id`` stays, a null ``doc_id``
    only where the group has no other; of repeated rows with one ``doc_id`` exactly one stays.  Should two texts share a
    digest, they are regrouped by their bytes.  An empty table gives no rows.  Other columns are carried in ``row`` and cannot
    clash.
    """
    spark = docs.sparkSession
    place = scratch_path(spark)
    rows = materialise(tagged(docs, text))
    narrow = rows.select("digest", "doc_id", "locator")
    narrow.write.parquet(f"{place}/rows")
    run_stream(spark, f"{place}/rows", narrow.schema, f"{place}/state")
    found = materialise(state(spark, f"{place}/state"))

    body = F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("body")
    repeated = found.where("group_size > 1")
    hits = materialise(narrow_hits(narrow, repeated))
    hit_text, _ = parted(rows.select("digest", "doc_id", "locator", body), "locator", hits)
    kept_text, _ = parted(rows.select("locator", body.alias("kept_body")), "locator", repeated.select("keep.locator"))
    kept_text = kept_text.join(repeated.select("digest", "keep.locator"), "locator").select("digest", "kept_body")
    unequal = hit_text.join(kept_text, "digest").where("body <> kept_body").select("digest", "doc_id", "locator", "body")
    split = materialise(unequal)
    names = ["locator", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    out = narrow.join(found, "digest").select(
        "locator", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
    if split.isEmpty():
        return rows, out
    groups = keyed_state(split.withColumn("digest", F.struct("digest", "body"))).select("digest.*", "group_size", "keep")
    parted_off = split.groupBy(F.lower(F.hex("digest")).alias("text_sha256")).agg(F.count(F.lit(1)).alias("gone"))
    first = out.join(split.select("locator"), "locator", "left_anti").join(parted_off, "text_sha256", "left").withColumn(
        "group_size", F.col("group_size") - F.coalesce("gone", F.lit(0)))
    other = split.join(groups, ["digest", "body"]).select(
        "locator", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("keep.locator")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
    return rows, first.select(names).unionByName(other)


def feed(docs: DataFrame, home: str, batch: int, text: str = "text") -> DataFrame:
    """Decisions for the rows of one more batch, against all batches fed to ``home`` so far: call it as documents arrive.

    ``home`` is a folder of its own in a store that all executors share; ``batch`` a number not used there before.  The batch is
    written there, so (batch, locator) finds its texts for good, and goes through the state once.  doc_id, batch, locator,
    keep_id, keep_batch, group_size, kept, same_text, text_sha256: ``kept`` tells whether the row is the one that stays as of
    now, ``same_text`` whether its bytes are those of the row that does; where they are not, two texts share a digest.  A row
    of an earlier batch gives way to a later one with a larger ``doc_id``.  An empty batch gives no rows.
    """
    spark, place = docs.sparkSession, ("batch", "locator")
    tagged(docs, text).write.parquet(f"{home}/rows/batch={batch}")
    narrow = "digest binary, doc_id bigint, locator bigint, batch int"
    run_stream(spark, f"{home}/rows", narrow, f"{home}/state", place)
    found = materialise(state(spark, f"{home}/state"))
    rows = spark.read.schema(f"row {tagged(docs, text).schema['row'].dataType.simpleString()}, {narrow}").parquet(f"{home}/rows")
    decided = materialise(rows.where(F.col("batch") == batch).drop("row").join(found, "digest"))
    stays = F.struct("batch", "locator").eqNullSafe(F.struct("keep.batch", "keep.locator"))
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    hits = decided.where(~stays)
    mine = rows.where(F.col("batch") == batch).join(hits.select("locator"), "locator", "left_semi").select("locator", "digest", body.alias("own"))
    kept = rows.join(hits.select("digest", "keep.batch", "keep.locator").distinct(), ["digest", "batch", "locator"], "left_semi").select("digest", body.alias("other"))
    differ = mine.join(kept, "digest").where("own <> other").select("locator", F.lit(False).alias("same"))
    return decided.join(differ, "locator", "left").select(
        "doc_id", "batch", "locator", F.col("keep.doc_id").alias("keep_id"), F.col("keep.batch").alias("keep_batch"), "group_size", stays.alias("kept"),
        F.coalesce("same", F.lit(True)).alias("same_text"), F.lower(F.hex("digest")).alias("text_sha256"))


def unique_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, unchanged, with all their columns."""
    rows, decided = deduplicate(docs, text)
    gone = materialise(decided.where(~F.col("kept")).select("locator"))
    near, rest = parted(rows.select("row", "locator"), "locator", gone)
    return near.join(gone, "locator", "left_anti").unionByName(rest).select("row.*")


@register
def op10_exact_dedup(spark, sf):
    """The decision for every document."""
    return deduplicate(table(spark, sf, "documents"))[1].drop("locator")


ORACLES["op10_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
