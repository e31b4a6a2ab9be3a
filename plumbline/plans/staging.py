"""Cutting lineage through the shared folder that the cluster names."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark removes the shuffle files of a finished query at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own. A cluster without it is an
    error: a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Plans made and run inside leave no shuffle files; one that runs again shuffles again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that later uses neither recompute nor re-partition it."""
    shared_folder(df.sparkSession)
    with swept(df.sparkSession):
        # a plan of its own: the caller's may run again with its shuffles
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once as columns in the shared folder; a later use reads the columns that it needs, and no memory is held.

    With a ``folder`` of ``scratch_path``, what was stored there before is replaced. Types that have no columns are cut instead.
    """
    if any(kind in df.schema.simpleString() for kind in ("void", "interval")):
        return cut(df)
    folder = folder or scratch_path(df.sparkSession, "rows")
    with swept(df.sparkSession):
        df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
