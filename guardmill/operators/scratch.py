"""Reliable places to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_WAREHOUSE = "spark.sql.warehouse.dir"
_owners: list[list[str]] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, `spark.checkpoint.dir`; all executors share it.

    Where it is unset, a folder in the warehouse, which driver and executors share as well;
    never a machine-local folder, which would be lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get(_SETTING, None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    warehouse = spark.conf.get(_WAREHOUSE, None)
    if not warehouse:
        raise RuntimeError(f"set {_SETTING} to a folder all executors share")
    folder = f"{warehouse.rstrip('/')}/_guardmill_scratch"
    context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and stored as a table in the checkpoint folder.

    Used where two outputs share one costly input and between the waves of an iteration:
    later jobs read the stored rows, also after executors are lost. Unlike a checkpointed
    RDD the table keeps its size statistics, so small ones are still broadcast by the
    optimizer, and only the needed columns are read back.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    return path


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[None]:
    """Drops the scratch tables made inside when the block ends.

    For the job that writes or collects the result: until then the result reads them.
    """
    paths: list[str] = []
    _owners.append(paths)
    try:
        yield
    finally:
        _owners.remove(paths)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
