"""Progress of running jobs, from a table or a stream of progress events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def job_progress(events: DataFrame, watermark: str = "1 hour", idle: str | None = None) -> DataFrame:
    """Last state of each job with percent and remaining seconds.

    Events: job_id, ts, processed, total, message.  The aggregation is the same for both kinds of
    input.  A stream drops events later than the watermark.  Without ``idle`` it runs in update mode and keeps one row of state
    per job for good.  With ``idle`` a job ends when nothing has come from it for that long, and comes out once, as a final row, in
    append mode; its state goes when the watermark has passed that time.  Events of a job behind such a pause are another run of it.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    keys = ["job_id"] if idle is None else ["job_id", F.session_window("ts", idle).alias("run")]
    state = F.struct("processed", "total", "message")
    last = events.groupBy(*keys).agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("updated"),
        F.max_by(state, F.struct("ts", "processed")).alias("s"),
    )
    done, total = F.col("s.processed"), F.col("s.total")
    elapsed = F.greatest((F.unix_micros(F.col("updated").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000, F.lit(0.001))
    percent = F.when(total > 0, F.least(F.greatest(done * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(100.0))).otherwise(F.lit(0.0))
    eta = F.when((done > 0) & (done < total), (total - done) * (elapsed / F.nullif(done, F.lit(0))))
    return last.select(
        "job_id", done.alias("processed"), total.alias("total"), F.col("s.message").alias("message"),
        percent.alias("percent"), eta.alias("eta_seconds"),
    )


def start_final_progress(events: DataFrame, sink, checkpoint: str, idle: str, watermark: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Run :func:`job_progress` with ``idle`` on a stream: a row for each run of a job, when it has ended."""
    writer = job_progress(events, watermark, idle).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_progress(events: DataFrame, sink, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run :func:`job_progress` on a stream; ``sink(batch, batch_id)`` must be safe to repeat for a batch id."""
    writer = (
        job_progress(events).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(sink)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
