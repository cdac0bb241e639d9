"""Running values and ranks over long ordered groups.

A book may hold a large share of all pages, so a window partitioned by book
would put that share into one task.  Every running value here is taken in two
steps instead: inside fixed-width buckets of the ordering column (bounded rows
per task), then over one summary row per bucket.  The results are the same as
those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 4096
PART_BYTES = 4_000_000  # of written pages: as lines and words they take some thirty times as much

_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def parts_for(df: DataFrame) -> int:
    """Number of parts for what ``df`` reads: that of the session's shuffles, or one for every ``PART_BYTES`` of its files if these are more."""
    spark = df.sparkSession
    size = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def spread(df: DataFrame, key: str = "page_id", *, parts: int | None = None) -> DataFrame:
    """Spread page rows by ``key`` once, before they are unfolded into lines and words.

    Everything keyed by page afterwards finds its rows in place.  The count is given because
    the rows grow about tenfold when unfolded, which the adaptive planner cannot see when it
    would merge small partitions.  ``parts`` sets it (see :func:`parts_for`); otherwise it is that of the session.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)


def with_running(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    value: Column,
    how: str,
    out: str,
    *,
    inclusive: bool = True,
    following: bool = False,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add ``out``: running ``how`` of ``value`` over ``key`` in ``order`` (a whole-number column).

    ``inclusive=False`` leaves the current row out; ``following=True`` runs over
    the rows after the current one instead of those before it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    agg, combine = _COMBINE[how]
    edge = 0 if inclusive else 1
    unb_back, unb_fwd = Window.unboundedPreceding, Window.unboundedFollowing
    local_frame = (edge, unb_fwd) if following else (unb_back, -edge)
    carry_frame = (1, unb_fwd) if following else (unb_back, -1)

    rows = df.withColumn("_bucket", F.floor(F.col(order) / width)).withColumn("_value", value)
    carry_win = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*carry_frame)
    carry = (
        rows.groupBy(*keys, "_bucket")
        .agg(agg("_value").alias("_total"))
        .select(*keys, "_bucket", agg("_total").over(carry_win).alias("_carry"))
    )
    local_win = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(*local_frame)
    return (
        rows.withColumn("_local", agg("_value").over(local_win))
        .join(carry, [*keys, "_bucket"], "left")
        .withColumn(out, combine(F.col("_local"), F.col("_carry")))
        .drop("_bucket", "_value", "_local", "_carry")
    )


def with_rank(
    df: DataFrame,
    key: str | Sequence[str],
    order: str,
    out: str = "rank",
    *,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add ``out``: 0-based position of the row within ``key`` by ``order`` (unique within the key)."""
    return with_running(
        df, key, order, F.lit(1).cast("bigint"), "sum", out, inclusive=False, width=width
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key by ``order``; partial aggregation, no sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, "_first.*").select(*df.columns)
