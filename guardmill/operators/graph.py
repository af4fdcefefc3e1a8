"""Permission-aware relationship graph as a node table and an edge table."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import Contracts, table_schema
from guardmill.functions.access import allowed, user_from_columns, user_from_mapping
from guardmill.functions.text import name_uuid
from guardmill.operators.index import upsert
from guardmill.operators.joins import hot_keys, lookup_join, spread_join
from guardmill.operators.scratch import settled


def _with_defaults(df: DataFrame, table: str, defaults: Mapping[str, Any]) -> DataFrame:
    columns = []
    for field in table_schema(table):
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        elif field.name == "allowed_roles":
            value = F.coalesce(value, F.array().cast("array<string>"))
        elif field.name == "extra":
            value = F.coalesce(value, F.create_map().cast("map<string,string>"))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def conform_nodes(df: DataFrame) -> DataFrame:
    return _with_defaults(df, "graph_nodes", fv.NODE_DEFAULTS)


def conform_edges(df: DataFrame) -> DataFrame:
    return _with_defaults(df, "graph_edges", fv.EDGE_DEFAULTS)


def put_nodes(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds nodes, replacing stored ones of the same id."""
    merged = upsert(conform_nodes(nodes).withColumn("updated_at", F.lit("")),
                    conform_nodes(incoming).withColumn("updated_at", F.lit("")),
                    key="node_id")
    return merged.drop("updated_at").select(*table_schema("graph_nodes").names)


def put_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """Appends edges; several edges between two nodes are kept."""
    return conform_edges(edges).unionByName(conform_edges(incoming))


def build_graph(chunks: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from silver chunks and facts.

    part_of chunk -> document, mentions chunk -> entity, derived_from entity -> chunk, and
    relates_to between the subject and the object of a fact. Both inputs are read many times
    but come from texts, so their narrow columns are stored once.
    """
    chunks = settled(chunks.select("chunk_id", "document_id", "chunk_index", "classification",
                                   "allowed_roles", "department"))
    facts = settled(facts.select(
        "subject", "object", "chunk_id", "document_id", "classification", "allowed_roles",
        "department", "confidence", "extraction_method"))

    def node(node_type, label, **extra):
        return [F.lit(node_type).alias("node_type"), label.alias("label"),
                "classification", "allowed_roles", "department",
                *(v.alias(k) for k, v in extra.items())]

    def entity(name):
        # the governance is part of the id: one name under two permissions is two entities
        return F.concat(F.lit("entity:"), name_uuid(F.concat_ws(
            "|", "classification", F.array_join(F.array_sort("allowed_roles"), ","),
            "department", F.lower(F.col(name)))))

    governance = F.struct("classification", F.col("allowed_roles"), "department")
    documents = (chunks.groupBy("document_id").agg(
        F.min_by(governance, "chunk_index").alias("g"))
        .select("document_id", "g.*")
        .select(F.col("document_id").alias("node_id"),
                *node("document", F.col("document_id"),
                      source_document_id=F.col("document_id"))))
    chunk_nodes = chunks.select(
        F.col("chunk_id").alias("node_id"),
        *node("chunk", F.concat_ws("#", "document_id", F.col("chunk_index")),
              source_chunk_id=F.col("chunk_id"), source_document_id=F.col("document_id")))
    entities = None
    for name in ("subject", "object"):
        part = facts.select(
            entity(name).alias("node_id"),
            *node("entity", F.col(name), source_chunk_id=F.col("chunk_id"),
                  source_document_id=F.col("document_id"),
                  confidence=F.col("confidence"),
                  extraction_method=F.col("extraction_method")))
        entities = part if entities is None else entities.unionByName(part)
    first = F.min_by(F.struct(*[c for c in entities.columns if c != "node_id"]),
                     F.struct("source_document_id", "source_chunk_id", "label"))
    entities = entities.groupBy("node_id").agg(first.alias("n")).select("node_id", "n.*")
    nodes = (conform_nodes(documents).unionByName(conform_nodes(chunk_nodes))
             .unionByName(conform_nodes(entities)))

    def edge(df, source, target, relation):
        return df.select(source.alias("source_id"), target.alias("target_id"),
                         F.lit(relation).alias("relation_type"),
                         *([] if df is chunks else ["confidence", "extraction_method"]))

    edges = conform_edges(edge(chunks, F.col("chunk_id"), F.col("document_id"), "part_of"))
    for name in ("subject", "object"):
        edges = edges.unionByName(conform_edges(
            edge(facts, F.col("chunk_id"), entity(name), "mentions")))
        edges = edges.unionByName(conform_edges(
            edge(facts, entity(name), F.col("chunk_id"), "derived_from")))
    edges = edges.unionByName(conform_edges(
        edge(facts, entity("subject"), entity("object"), "relates_to")))
    return nodes, edges


def _visible(pairs: DataFrame, users: DataFrame | None, user: Mapping[str, Any] | None,
             contracts: Contracts) -> DataFrame:
    """Pairs whose node the asking user may see."""
    if users is None:
        return pairs.filter(allowed(contracts, user_from_mapping(user)))
    people = users.select(
        "user_id", F.col("role").alias("u_role"),
        F.col("clearance_level").alias("u_clearance_level"),
        F.col("department").alias("u_department"), F.lit(True).alias("u_known"))
    known = F.coalesce("u_known", F.lit(False))
    joined = lookup_join(pairs, people, ["user_id"], "left")
    return joined.filter(allowed(contracts, user_from_columns("u_", known))).drop(
        "u_role", "u_clearance_level", "u_department", "u_known")


def lookup_nodes(nodes: DataFrame, asked: DataFrame, contracts: Contracts,
                 users: DataFrame | None = None,
                 user: Mapping[str, Any] | None = None) -> DataFrame:
    """Asked node ids joined to the nodes their user may see.

    `asked` has node_id, plus user_id when a `users` table is given; otherwise `user` (None
    = unauthenticated) asks for all of them.
    """
    return _visible(asked.join(nodes, "node_id"), users, user, contracts)


def nodes_of_chunks(nodes: DataFrame, asked: DataFrame, contracts: Contracts,
                    users: DataFrame | None = None,
                    user: Mapping[str, Any] | None = None) -> DataFrame:
    """Visible nodes extracted from the asked chunks (column source_chunk_id)."""
    return _visible(asked.join(nodes, "source_chunk_id"), users, user, contracts)


def reachable(edges: DataFrame, seeds: DataFrame, relation_type: str | None = None,
              max_hops: int = 1) -> DataFrame:
    """Distinct (seed columns, reached_id) within `max_hops` out-edges, without the start.

    A breadth-first wave per hop: frontier x out-edges, minus what was reached before. Every
    wave is stored in the checkpoint folder, which keeps the plan short and the work safe
    when executors are lost. Sources that own a large share of the edges are salted.
    """
    keys = [c for c in seeds.columns if c != "node_id"]
    start = seeds.select(*keys, "node_id").distinct()
    if max_hops < 1:
        return start.withColumn("reached_id", F.col("node_id")).filter(F.lit(False))
    followed = edges if relation_type is None else edges.filter(
        F.col("relation_type") == relation_type)
    links = followed.select(F.col("source_id").alias("at"),
                            F.col("target_id").alias("reached_id")).distinct()
    if max_hops > 1:
        links = settled(links)
    hubs = settled(hot_keys(links, ["at"]))

    identity = [*keys, "node_id"]
    frontier = start.withColumn("at", F.col("node_id"))
    reached = None
    for hop in range(1, max_hops + 1):
        step = spread_join(links, frontier, ["at"], "inner", hubs)
        wave = step.filter(F.col("reached_id") != F.col("node_id")).select(
            *identity, "reached_id").distinct()
        if reached is not None:
            wave = wave.join(reached, [*identity, "reached_id"], "left_anti")
        if hop < max_hops:  # the last wave feeds no other
            wave = settled(wave)
        reached = wave if reached is None else reached.unionByName(wave)
        if hop == max_hops or wave.isEmpty():
            break
        frontier = wave.withColumn("at", F.col("reached_id")).drop("reached_id")
    return reached


def related(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, contracts: Contracts,
            users: DataFrame | None = None, user: Mapping[str, Any] | None = None,
            relation_type: str | None = None, max_hops: int = 1) -> DataFrame:
    """Visible nodes around each seed.

    Hidden nodes are still walked through; only the result is filtered.
    """
    found = reachable(edges, seeds, relation_type, max_hops)
    reached = found.withColumnRenamed("node_id", "start_id").withColumnRenamed(
        "reached_id", "node_id")
    reached = settled(reached)  # a node that much leads to is spread over tasks
    met = spread_join(reached, nodes, ["node_id"], "inner", hot_keys(reached, ["node_id"]))
    return _visible(met, users, user, contracts)


def safe_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without sensitive fields, also inside `extra`."""
    kept = nodes.drop(*fv.NODE_FORBIDDEN)
    if "extra" not in kept.columns:
        return kept
    return kept.withColumn("extra", F.map_filter(
        "extra", lambda k, _: ~k.isin(list(fv.NODE_FORBIDDEN))))
