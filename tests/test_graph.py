import random

import pytest
from pyspark.sql import functions as F

from guardmill.operators import chunking, facts, graph
from guardmill.sources import tables

ADMIN = {"role": "admin"}


def edges_frame(spark, rows):
    return graph.conform_edges(spark.createDataFrame(
        rows, "source_id string, target_id string, relation_type string"))


def nodes_frame(spark, ids, classification="public"):
    return graph.conform_nodes(spark.createDataFrame(
        [(i, classification) for i in ids], "node_id string, classification string"))


def walk(edges, start, relation, hops):
    reached, frontier = set(), {start}
    for _ in range(hops):
        nxt = {t for s, t, r in edges if s in frontier and relation in (None, r)}
        frontier = {n for n in nxt if n != start and n not in reached}
        reached |= frontier
    return reached


@pytest.mark.parametrize("relation,hops", [(None, 1), (None, 2), (None, 4), ("a", 3)])
def test_reachable_matches_a_plain_walk(spark, relation, hops):
    rng = random.Random(hops)
    ids = [f"n{i}" for i in range(30)]
    rows = [(rng.choice(ids), rng.choice(ids), rng.choice("ab")) for _ in range(70)]
    rows += [("hub", i, "a") for i in ids] + [(i, "hub", "b") for i in ids[::3]]
    rows += rows[:10]  # repeated edges
    seeds = spark.createDataFrame([(i,) for i in (*ids, "hub", "unknown")], "node_id string")
    got = {}
    for r in graph.reachable(edges_frame(spark, rows), seeds, relation, hops).collect():
        assert r.reached_id not in got.setdefault(r.node_id, set())
        got[r.node_id].add(r.reached_id)
    for start in (*ids, "hub", "unknown"):
        assert got.get(start, set()) == walk(rows, start, relation, hops)


def test_no_hops(spark):
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert graph.reachable(edges_frame(spark, [("a", "b", "x")]), seeds, max_hops=0).count() == 0


def test_hidden_nodes_are_walked_through(spark, contracts):
    nodes = nodes_frame(spark, ["a", "c"]).unionByName(
        nodes_frame(spark, ["b"], "restricted"))
    edges = edges_frame(spark, [("a", "b", "r"), ("b", "c", "r"), ("c", "gone", "r")])
    seeds = spark.createDataFrame([("a",)], "node_id string")

    def seen(user):
        found = graph.related(nodes, edges, seeds, contracts, user=user, max_hops=3)
        return {r.node_id for r in found.collect()}

    assert seen(None) == {"c"}
    assert seen(ADMIN) == {"b", "c"}


def test_lookups(spark, contracts):
    nodes = nodes_frame(spark, ["a"]).unionByName(nodes_frame(spark, ["b"], "internal"))
    users = spark.createDataFrame([("u", "hr_manager", "internal", "x")],
                                  "user_id string, role string, clearance_level string, "
                                  "department string")
    asked = spark.createDataFrame([("u", "a"), ("u", "b"), ("ghost", "a"), ("ghost", "b"),
                                   ("u", "missing")], "user_id string, node_id string")
    found = graph.lookup_nodes(nodes, asked, contracts, users).collect()
    assert {(r.user_id, r.node_id) for r in found} == {("u", "a"), ("u", "b"), ("ghost", "a")}


def test_put_nodes_replaces_and_put_edges_appends(spark):
    nodes = nodes_frame(spark, ["a", "b"])
    after = graph.put_nodes(nodes, nodes_frame(spark, ["b", "c"], "internal")).collect()
    assert {r.node_id: r.classification for r in after} == {
        "a": "public", "b": "internal", "c": "internal"}
    edges = edges_frame(spark, [("a", "b", "x")])
    assert graph.put_edges(edges, edges_frame(spark, [("a", "b", "x")])).count() == 2


def test_defaults_and_safe_nodes(spark):
    raw = spark.createDataFrame(
        [("a", {"raw_text": "secret", "k": "v"})],
        "node_id string, extra map<string,string>")
    node = graph.safe_nodes(graph.conform_nodes(raw)).first()
    assert node.node_type == "entity" and node.classification == "internal"
    assert node.extra == {"k": "v"} and node.allowed_roles == [] and node.confidence == 1.0


def test_build_graph(spark, contracts):
    docs = spark.createDataFrame(
        [(f"d{i}", "INCIDENT REPORT: NET DOWN === Incident commander: a@b.org", f"h{i}",
          ["internal", "internal", "restricted"][i], ["hr_manager"], "x", "p")
         for i in range(3)],
        "document_id string, text string, document_hash string, classification string, "
        "allowed_roles array<string>, department string, source_path string")
    chunks = chunking.chunk_documents(docs)
    nodes, edges = graph.build_graph(chunks, facts.facts_per_chunk(chunks, "now"))
    kinds = {(r.node_type, r.classification): r["count"] for r in
             nodes.groupBy("node_type", "classification").count().collect()}
    # one name under two permissions is two entities
    assert kinds[("entity", "internal")] == 2 and kinds[("entity", "restricted")] == 2
    assert kinds[("document", "internal")] == 2 and kinds[("chunk", "restricted")] == 1
    relations = {r.relation_type: r["count"] for r in
                 edges.groupBy("relation_type").count().collect()}
    assert relations == {"part_of": 3, "mentions": 6, "derived_from": 6, "relates_to": 3}
    asked = chunks.selectExpr("chunk_id as source_chunk_id")
    visible = graph.nodes_of_chunks(nodes, asked, contracts, user=None)
    assert visible.count() == 0


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"nodes": [{"node_id": "a", "label": "A"}], '
        '"edges": [{"source_id": "a", "target_id": "b", "relation_type": "r"}]}')
    nodes, edges = tables.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().label == "A" and edges.first().confidence == 1.0
    tables.write_graph(nodes, edges, str(tmp_path / "stored"))
    again, _ = tables.load_graph(spark, str(tmp_path / "stored"))
    assert again.collect() == nodes.collect()
    (tmp_path / "bad.json").write_text('{"nodes": [')
    for path in ("bad.json", "absent.json"):
        nodes, edges = tables.read_graph(spark, str(tmp_path / path))
        assert nodes.count() == 0 and edges.count() == 0
    with pytest.raises(RuntimeError):
        tables.write_graph(nodes, edges, None)


def test_inputs_of_the_graph_are_computed_once(spark):
    chunks = spark.createDataFrame(
        [("c1", "d1", 0, "public", ["r"], "x"), ("c2", "d1", 1, "public", ["r"], "x")],
        "chunk_id string, document_id string, chunk_index int, classification string, "
        "allowed_roles array<string>, department string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    facts = chunks.filter("chunk_index = 0").select(
        counted.asNondeterministic()("chunk_id").alias("subject"), F.lit("o").alias("object"),
        "chunk_id", "document_id", "classification", "allowed_roles", "department",
        F.lit(0.9).alias("confidence"), F.lit("m").alias("extraction_method"))
    nodes, edges = graph.build_graph(chunks, facts)
    assert nodes.count() == 5 and edges.count() == 7
    assert seen.value == 1
