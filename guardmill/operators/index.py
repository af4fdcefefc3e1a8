"""Candidate index table: one vector and safe metadata per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardmill import fixed_values as fv
from guardmill.operators.scratch import settled
from guardmill.sources.io import read_or_none

#: Folders of a stored index.
BUCKETS = 64
_BUCKETS, _BUCKET = "buckets", "bucket"


def candidate_id(*names: str, last: str | None = None) -> Column:
    """First non-empty of the named columns."""
    options = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names]
    return F.coalesce(*options, *([] if last is None else [F.lit(last)]))


def safe_metadata(records: DataFrame) -> list[Column]:
    """The whitelisted columns; lists become comma strings, binaries are left out."""
    columns = []
    for field in records.schema:
        if field.name not in fv.INDEX_FIELDS or isinstance(field.dataType, T.BinaryType):
            continue
        value = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), ",")
        columns.append(value.alias(field.name))
    return columns


def index_rows(records: DataFrame, vector: str = "vector",
               order: str = "created_at") -> DataFrame:
    """Rows ready to upsert; records without any id are skipped."""
    ids = candidate_id(*(n for n in ("chunk_id", "embedding_id") if n in records.columns))
    missing = F.raise_error(F.concat(F.lit("no vector for candidate "), F.col("id")))
    stamp = F.col(order).cast("string") if order in records.columns else F.lit("")
    given = records.withColumn("id", ids).filter(F.col("id").isNotNull())
    return given.select(
        "id",
        F.when(F.col(vector).isNotNull(), F.col(vector)).otherwise(
            missing.cast(records.schema[vector].dataType)).alias("vector"),
        *safe_metadata(records), stamp.alias("updated_at"))


def upsert(index: DataFrame | None, incoming: DataFrame, key: str = "id",
           order: str = "updated_at") -> DataFrame:
    """Index after the upsert: incoming wins over stored, later over earlier.

    The stored rows have one row per id, as an upsert leaves them; those without an incoming
    one pass by an anti join. Only incoming rows are aggregated, so repeated ids shrink on
    the map side. Rows that tie in `order` are settled by their content.
    """
    payload = [c for c in incoming.columns if c != key]
    newest = F.max_by(F.struct(*payload), F.struct(order, F.xxhash64(
        *[_hashable(incoming, c) for c in payload])))
    fresh = incoming.groupBy(key).agg(newest.alias("row")).select(key, "row.*")
    if index is None:
        return fresh
    stored = index.join(incoming.select(key).distinct(), key, "left_anti")
    return stored.unionByName(fresh, True)


def upsert_stored(incoming: DataFrame, folder: str, key: str = "id",
                  order: str = "updated_at", buckets: int = BUCKETS) -> list[int]:
    """Upserts into an index stored below `folder`; returns the buckets that were rewritten.

    The index lies in one folder per hash of the key. Only buckets of incoming rows are read
    and replaced, the files of all others stay as they are. The new rows are complete in the
    checkpoint folder before the first bucket is replaced, and the same upsert once more gives
    the same rows, so a job that failed half way is run again. `buckets` holds for the life of
    the index; another number is an error.
    """
    spark = incoming.sparkSession
    rows = settled(incoming.withColumn(
        _BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    touched = sorted(r[0] for r in rows.select(_BUCKET).distinct().collect())
    if not touched:
        return []
    stored = read_stored(spark, folder, with_bucket=True)
    if stored is not None:
        if stored.agg(F.max(_BUCKETS)).first()[0] not in (None, buckets):
            raise ValueError(f"the index below {folder} has another number of buckets")
        stored = stored.filter(F.col(_BUCKET).isin(touched)).drop(_BUCKETS)
    merged = settled(upsert(stored, rows, key, order).withColumn(_BUCKETS, F.lit(buckets)))
    (merged.repartition(len(touched), _BUCKET).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKETS, _BUCKET)
     .parquet(folder))
    return touched


def read_stored(spark: SparkSession, folder: str,
                with_bucket: bool = False) -> DataFrame | None:
    """The stored index, None where there is none yet."""
    found = read_or_none(spark, format="parquet", path=folder, mergeSchema="true")
    return found if found is None or with_bucket else found.drop(_BUCKETS, _BUCKET)


def _hashable(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.array_sort(F.map_entries(name))
    return F.col(name)
