"""Safe projections and SQL views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardmill import fixed_values as fv
from guardmill.contracts import Contracts

_SPAN = "format_string('start=%s,end=%s', chunk_span.start, chunk_span.end)"
VIEW_NAMES = tuple(v[0] for v in fv.SAFE_VIEWS)


def _definition(view: str) -> tuple[str, list[str], tuple[str, ...]]:
    for name, table, columns, levels in fv.SAFE_VIEWS:
        if name == view:
            return table, list(columns), levels
    raise KeyError(f"no safe view named {view!r}")


def safe_view(df: DataFrame, view: str) -> DataFrame:
    """The safe view over its raw table."""
    _, columns, levels = _definition(view)
    if levels:
        df = df.filter(F.col("classification").isin(list(levels)))
    return df.select(*(F.expr(_SPAN).alias(c) if c == "chunk_span" else F.col(c)
                       for c in columns))


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Temp views raw_<table> and safe_<view> for the tables at hand."""
    names = []
    for table, df in tables.items():
        df.createOrReplaceTempView(f"raw_{table}")
        names.append(f"raw_{table}")
    for view in VIEW_NAMES:
        table = _definition(view)[0]
        if table in tables:
            safe_view(tables[table], view).createOrReplaceTempView(f"safe_{view}")
            names.append(f"safe_{view}")
    return names


def create_catalog_views(spark: SparkSession, locations: Mapping[str, str],
                         raw: str = "raw", safe: str = "safe") -> list[str]:
    """Databases with external Parquet tables and the safe views over them.

    `locations` maps table names to folders. Granting only `safe` keeps ciphertext, nonces
    and key ids out of reach.
    """
    for database in (raw, safe):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = []
    for table, folder in locations.items():
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString()}"
            for f in T.StructType.fromDDL(fv.TABLE_DDL[table]))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {raw}.{table} ({columns}) USING parquet "
                  f"LOCATION '{folder}'")
        made.append(f"{raw}.{table}")
    for view in VIEW_NAMES:
        table, columns, levels = _definition(view)
        if table not in locations:
            continue
        listed = ", ".join(f"{_SPAN} AS chunk_span" if c == "chunk_span" else c
                           for c in columns)
        where = f" WHERE classification IN ({', '.join(map(repr, levels))})" if levels else ""
        spark.sql(f"CREATE OR REPLACE VIEW {safe}.{view} AS "
                  f"SELECT {listed} FROM {raw}.{table}{where}")
        made.append(f"{safe}.{view}")
    return made


def without_fields(df: DataFrame, forbidden: Sequence[str] = fv.GOLD_FORBIDDEN) -> DataFrame:
    """Drops forbidden columns; an empty list drops none."""
    return df.drop(*forbidden)


def gold_forbidden(contracts: Contracts | None) -> tuple[str, ...]:
    """Sensitive gold fields of the contract, or the built-in three."""
    if contracts is None or "gold_embeddings" not in contracts.datasets:
        return fv.GOLD_FORBIDDEN
    return tuple(contracts.dataset("gold_embeddings").sensitive) or fv.GOLD_FORBIDDEN


def screen_safe(df: DataFrame) -> DataFrame:
    """Drops every column a screen must not show, and all binaries."""
    return df.select(*(f.name for f in df.schema
                       if f.name not in fv.UI_FORBIDDEN
                       and not isinstance(f.dataType, T.BinaryType)))


def contract_view(df: DataFrame, dataset_id: str, contracts: Contracts) -> DataFrame:
    """The columns the dataset's contract declares safe."""
    safe = contracts.dataset(dataset_id).safe_fields()
    return df.select(*(c for c in safe if c in df.columns))
