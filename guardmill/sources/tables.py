"""The engine's own tables: where they live and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardmill.contracts import table_schema
from guardmill.functions.rows import exploded
from guardmill.operators.graph import conform_edges, conform_nodes
from guardmill.sources.io import Entries, read_or_none, read_source

# A flat JSON object; strings may hold braces and escapes.
_FLAT_OBJECT = r'\{(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+\}'


def default_entries(data_root: str, lake_root: str) -> tuple[Entries, Entries]:
    """(readers, writers) for the standard layout."""
    lake = {t: f"{lake_root}/{t}" for t in
            ("bronze_documents", "silver_chunks", "gold_embeddings", "embed_cache")}
    readers = {
        t: {"options": {"format": "parquet", "mergeSchema": "true", "path": p}}
        for t, p in lake.items()}
    readers["metadata_documents"] = {
        "options": {"format": "json", "path": f"{data_root}/metadata"}}
    readers["raw_documents"] = {"options": {"path": f"{data_root}/raw_documents"}}
    writers = {
        t: {"options": {"format": "parquet", "compression": "snappy", "path": p,
                        "mode": "append" if t == "embed_cache" else "overwrite"}}
        for t, p in lake.items()}
    return Entries.from_mapping(readers), Entries.from_mapping(writers)


def read_or_empty(spark: SparkSession, table: str, **options) -> DataFrame:
    """The source, or an empty frame of the contract schema where it does not exist."""
    found = read_or_none(spark, **options)
    return found if found is not None else spark.createDataFrame([], table_schema(table))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users from a JSON array, one row per user_id, the last one listed; no passwords."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    known = table_schema("users").names
    optional = [c for c in ("can_access_all_records",) if c in raw.columns]
    rows = raw.select(
        *((F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c)
          for c in known), *optional,
        F.monotonically_increasing_id().alias("__position"))
    payload = [c for c in rows.columns if c not in ("user_id", "__position")]
    last = F.max_by(F.struct(*payload), "__position")
    return rows.groupBy("user_id").agg(last.alias("u")).select("user_id", "u.*")


def read_facts(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Facts from JSON lines, or (`layout="objects"`) from pretty-printed objects."""
    schema = table_schema("facts")
    if layout == "lines":
        found = read_or_none(spark, format="json", path=path, schema=schema)
        return found if found is not None else spark.createDataFrame([], schema)
    if layout != "objects":
        raise ValueError("layout is 'lines' or 'objects'")
    whole = read_or_none(spark, format="text", path=path, wholetext="true")
    if whole is None:
        return spark.createDataFrame([], schema)
    objects = exploded(
        whole, F.regexp_extract_all("value", F.lit(f"({_FLAT_OBJECT})"), F.lit(1)), "o")
    return objects.select(F.from_json("o", schema).alias("f")).select("f.*")


def read_audit(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Audit events from JSON lines; blank lines are skipped."""
    schema = table_schema("audit_events")
    if stream:
        return read_source(spark, stream=True, format="json", path=path, schema=schema)
    found = read_or_none(spark, format="json", path=path, schema=schema)
    return found if found is not None else spark.createDataFrame([], schema)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from JSON files of the form {"nodes": [...], "edges": [...]}.

    An absent path or a malformed file gives no nodes and no edges.
    """
    tables = ("graph_nodes", "graph_edges")
    schema = T.StructType([
        T.StructField(part, T.ArrayType(table_schema(table)))
        for part, table in zip(("nodes", "edges"), tables, strict=True)])
    raw = read_or_none(spark, format="json", path=path, schema=schema, multiLine="true")
    if raw is None:
        raw = spark.createDataFrame([], schema)
    nodes = exploded(raw, "nodes", "n").select("n.*").filter("node_id is not null")
    edges = exploded(raw, "edges", "e").select("e.*").filter(
        "source_id is not null and target_id is not null")
    return conform_nodes(nodes), conform_edges(edges)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str | None) -> None:
    """Stores the graph as two Parquet tables below `path`."""
    if path is None:
        raise RuntimeError("no path given, cannot save the graph")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables `write_graph` stored; empty where there are none."""
    return (read_or_empty(spark, "graph_nodes", format="parquet", path=f"{path}/nodes"),
            read_or_empty(spark, "graph_edges", format="parquet", path=f"{path}/edges"))


def write_json_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with the columns in name order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)
