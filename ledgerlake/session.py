"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "ledgerlake", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` overrides them.

    ``.`` in a setting's name is written as ``__`` in a keyword argument.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is not set, one in the warehouse; on a cluster not in the default warehouse, a folder
    of the driver's machine, as executors would each write to one of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_cluster = not spark.sparkContext.master.startswith("local")
    if on_cluster and warehouse.startswith("file:") and warehouse.endswith("/spark-warehouse"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Writes within remove their shuffle files when they are complete; nothing else reads these."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at the written files, so a lost executor costs a re-read and not
    a recomputation, and the planner sees the true size: a small result is then
    broadcast by Spark's own threshold check, a large one is shuffled.
    """
    path = scratch_path(df.sparkSession, purpose)
    with shuffle_files_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
