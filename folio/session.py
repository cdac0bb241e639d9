"""Session defaults for tests, the bench and local runs.

A cluster session brings its own settings; nothing here overrides a value the
caller has set except the time zone, which the results depend on.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "folio") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``.

    On a local master without one a temporary folder is taken; on a cluster that would be a folder of one machine, so
    there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="folio-ckpt-")
        spark.sparkContext.setCheckpointDir(named)
    return named


_SCOPES: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written within go to a folder of their own, whose path is given; :func:`drop_scratch` removes it."""
    name = uuid.uuid4().hex
    _SCOPES.append(name)
    try:
        yield f"{shared_dir(spark)}/folio/{RUN}/{name}"
    finally:
        _SCOPES.remove(name)


def scratch_path(spark: SparkSession) -> str:
    """A new place below the folder of this run, or of the innermost :func:`scratch`."""
    return "/".join([shared_dir(spark), "folio", RUN, *_SCOPES[-1:], uuid.uuid4().hex])


def materialise(df: DataFrame) -> DataFrame:
    """Write a step's result as a table in the shared folder and read it back; this runs the step at once.

    Used where a step is read several times, so that its inputs are not computed once per reader. The
    table outlives lost executors, and its real size steers the joins that follow.  :func:`clean` removes it.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession, place: str) -> None:
    """Remove the tables of a :func:`scratch` that nothing reads any more, and with them what its frames have shuffled."""
    _delete(spark, place)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Remove what frames that are no longer held have shuffled.

    Spark gives up shuffle files once the driver has forgotten the frames they belong to, so both collectors run here.
    """
    gc.collect()
    spark._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Remove all tables this run has written; call it when nothing reads them any more."""
    _delete(spark, f"{shared_dir(spark)}/folio/{RUN}")
