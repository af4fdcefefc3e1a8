"""Uniform batch and stream reads and writes from option dictionaries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@dataclass(frozen=True)
class Entry:
    """A named source or sink: whether it streams, and its options."""

    stream: bool = False
    options: Mapping[str, Any] = field(default_factory=dict)


class Entries(dict):
    """Entries by name, from a plain (YAML-shaped) mapping."""

    @classmethod
    def from_mapping(cls, spec: Mapping[str, Any]) -> Entries:
        return cls({name: Entry(bool(e.get("stream", False)), dict(e.get("options") or {}))
                    for name, e in spec.items()})

    def __missing__(self, name: str) -> Entry:
        raise KeyError(f"no entry named {name!r}; known: {', '.join(sorted(self))}")


def _target(options: dict[str, Any]) -> tuple[str | None, str | None, dict[str, Any]]:
    """(table, path, other options); explicit options win over nested ones."""
    nested = options.pop("options", None)
    if nested is not None and not isinstance(nested, Mapping):
        raise TypeError("'options' must be a mapping")
    given = {k: v for k, v in options.items()
             if v is not None or k not in ("table_name", "path")}
    merged = {**(nested or {}), **given}
    table, path = merged.pop("table_name", None), merged.pop("path", None)
    if table is not None and path is not None:
        raise ValueError("give either 'table_name' or 'path', not both")
    return table, path, merged


def read_source(spark: SparkSession, *, stream: bool = False,
                schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """Reads a catalog table (`table_name`) or files (`path`), as batch or stream."""
    table, path, rest = _target(options)
    reader = spark.readStream if stream else spark.read
    if table is not None:
        return reader.table(table)
    source_format = rest.pop("format", None)
    if source_format:
        reader = reader.format(source_format)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**rest).load(path)


def read_or_none(spark: SparkSession, **options) -> DataFrame | None:
    """The source, or None where it does not exist yet."""
    try:
        return read_source(spark, **options)
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return None
        raise



def write_sink(df: DataFrame, *, stream: bool = False, **options: Any) -> StreamingQuery | None:
    """Writes to a table or path.

    A batch overwrites unless `mode` says otherwise. For a stream `mode` is the output mode
    (append by default), `trigger` a mapping of trigger arguments, and the running query is
    returned. A batch table may be bucketed: `bucketBy` names the columns and `buckets` their
    number; rows are dealt by these columns first, so a write adds one file to a bucket.
    """
    table, path, rest = _target(options)
    sink_format = rest.pop("format", None)
    mode = rest.pop("mode", None)
    partition_by = rest.pop("partitionBy", None)
    bucket_by, buckets = rest.pop("bucketBy", None), int(rest.pop("buckets", 0))
    if bucket_by and (stream or table is None or buckets < 1):
        raise ValueError("only batch tables are bucketed, into one bucket at least")
    if stream:
        trigger = rest.pop("trigger", None)
        writer = df.writeStream.outputMode(mode or "append").options(**rest)
        if sink_format:
            writer = writer.format(sink_format)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if trigger:
            writer = writer.trigger(**trigger)
        return writer.toTable(table) if table is not None else writer.start(path)
    if bucket_by:
        bucket_by = [bucket_by] if isinstance(bucket_by, str) else list(bucket_by)
        df = df.repartition(buckets, *bucket_by)
    writer = df.write.mode(mode or "overwrite").options(**rest)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by)
    if sink_format:
        writer = writer.format(sink_format)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if table is not None:
        writer.saveAsTable(table)
    else:
        writer.save(path)
    return None


def read_entry(spark: SparkSession, entry: Entry, **more: Any) -> DataFrame:
    return read_source(spark, stream=entry.stream, **{**entry.options, **more})


def write_entry(df: DataFrame, entry: Entry, **more: Any) -> StreamingQuery | None:
    return write_sink(df, stream=entry.stream, **{**entry.options, **more})
