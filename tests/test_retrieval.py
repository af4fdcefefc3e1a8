import uuid

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import table_schema
from guardmill.functions import vectors
from guardmill.operators import embedding, scratch
from guardmill.plans import pipeline, retrieval

DIM = 4
STAMP = "2030-01-01T00:00:00Z"
ROWS = [  # chunk, classification, roles, department, vector
    ("c1", "public", [], "x", [1, 0, 0, 0]),
    ("c2", "internal", [], "x", [.9, .1, 0, 0]),
    ("c3", "confidential", ["hr_manager"], "x", [0, 0, 1, 0]),
    ("c4", "restricted", ["hr_manager"], "y", [.5, .5, 0, 0]),
    ("c5", "internal", [], "x", None),
]


@pytest.fixture(scope="module")
def gold(spark, keys):
    df = spark.createDataFrame(
        [(c, "d" + c[1:], cls, r, d, None if v is None else [float(x) for x in v], f"h{c}",
          f"p/{c}", "me", "1")
         for c, cls, r, d, v in ROWS],
        "chunk_id string, document_id string, classification string, "
        "allowed_roles array<string>, department string, v array<float>, "
        "document_hash string, source_path string, owner string, version string")
    return embedding.sealed_rows(df.withColumn("vector", vectors.pack_f32("v")), keys, "k1",
                                 "m", DIM, STAMP)


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(
        [("adm", "admin", "restricted", "z"), ("ana", "business_analyst", "internal", "x"),
         ("hr", "hr_manager", "restricted", "x"), ("ext", "external_viewer", "public", "x")],
        "user_id string, role string, clearance_level string, department string")


def requests(spark, *rows):
    return spark.createDataFrame(
        [(*r, [1.0, 0.0, 0.0, 0.0]) if len(r) == 4 else r for r in rows],
        "request_id string, user_id string, query string, top_k int, "
        "query_vector array<float>")


def by_request(results):
    out = {}
    for r in results.orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append(r.chunk_id)
    return out


def test_secure(spark, gold, users, keys, contracts):
    batch = requests(spark, ("1", "adm", "q", 9), ("2", "ana", "q", 2), ("3", "hr", "q", 9),
                     ("4", "ext", "q", 9), ("5", "ghost", "q", 9),
                     ("6", "ana", "q", 9, None))
    out = retrieval.secure_retrieve(batch, gold, users, keys, contracts)
    assert by_request(out.results) == {
        "1": ["c1", "c2", "c4", "c3", "c5"], "2": ["c1", "c2"],
        "3": ["c1", "c2", "c3", "c5"], "4": ["c1"], "6": ["c1", "c2", "c5"]}
    assert not set(fv.GOLD_FORBIDDEN) & set(out.results.columns)
    score = out.results.filter("request_id = '1' and chunk_id = 'c2'").first().score
    assert score == round(.9 / np.hypot(.9, .1), 6)
    audit = {r.request_id: r for r in out.audit.collect()}
    assert audit["1"].filtered_out_count == 0 and audit["1"].decrypted_embedding_count == 4
    assert audit["2"].returned_ids == ["c1", "c2"] and audit["2"].filtered_out_count == 2
    assert audit["4"].filtered_out_count == 4
    assert audit["5"].status == "denied" and audit["5"].returned_ids == []
    assert audit["5"].filtered_out_count == 0 and audit["5"].role == "unknown"
    assert audit["6"].decrypted_embedding_count == 0
    notes = {r.request_id: r.note for r in out.requests.collect()}
    assert notes["5"] == "User not found: ghost"


def test_insecure_mode_shows_public_rows_to_strangers(spark, gold, users, keys, contracts):
    out = retrieval.insecure_retrieve(requests(spark, ("5", "ghost", "q", 9)), gold, users,
                                      keys, contracts)
    assert by_request(out.results) == {"5": ["c1"]}
    assert out.audit.first().mode == "insecure" and out.audit.first().status == "success"


def test_without_a_matching_key_rows_keep_id_order(spark, gold, users, keys, contracts):
    out = retrieval.secure_retrieve(requests(spark, ("1", "adm", "q", 9)), gold, users,
                                    keys.filter("key_id = 'k2'"), contracts)
    assert by_request(out.results) == {"1": ["c1", "c2", "c3", "c4", "c5"]}
    assert out.audit.first().decrypted_embedding_count == 0


def test_decryption_stays_above_the_permission_filter(spark, gold, users, keys, contracts,
                                                      tmp_path):
    gold.write.parquet(str(tmp_path / "gold"))
    keys.write.parquet(str(tmp_path / "keys"))
    stored = spark.read.parquet(str(tmp_path / "gold"))
    table = spark.read.parquet(str(tmp_path / "keys"))
    resolved = retrieval.resolved_requests(requests(spark, ("1", "ana", "q", 2)), users,
                                           contracts)
    readable = retrieval.readable_candidates(stored, resolved, contracts)
    opened = embedding.open_vectors(readable, table).select("chunk_id", "vector")
    plan = opened._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    decrypts = [i for i, line in enumerate(lines) if "aesDecrypt" in line]
    semi = [i for i, line in enumerate(lines) if "LeftSemi" in line]
    assert decrypts and semi and max(decrypts) < min(semi)
    assert "Cartesian" not in opened._jdf.queryExecution().executedPlan().toString()
    assert {r.chunk_id for r in opened.collect()} == {"c1", "c2", "c5"}


def test_access_decisions_are_complete(spark, gold, users, contracts):
    batch = requests(spark, ("1", "adm", "q", 9), ("2", "ana", "q", 2), ("5", "ghost", "q", 9))
    granted, groups = retrieval.access_decisions(batch, gold, users, contracts)
    assert groups.agg(F.sum("n")).first()[0] == len(ROWS)
    named = gold.withColumn("access", retrieval.access_of(contracts))
    seen = granted.join(named, "access").select("request_id", "chunk_id").collect()
    assert {tuple(r) for r in seen} == {
        *(("1", c[0]) for c in ROWS), ("2", "c1"), ("2", "c2"), ("2", "c5")}


def test_pairs_carry_every_decision(spark, gold, users, keys, contracts):
    pairs = spark.createDataFrame(
        [("1", "c1"), ("1", "c4"), ("1", "c2"), ("1", "c2"), ("2", "c3"), ("5", "c1")],
        "request_id string, chunk_id string")
    batch = requests(spark, ("1", "ana", "q", 1), ("2", "ana", "q", 3), ("5", "ghost", "q", 3))
    out = retrieval.retrieve_pairs(batch, pairs, gold, users, keys, contracts)
    assert by_request(out.results) == {"1": ["c1"]}
    audit = {r.request_id: r for r in out.audit.collect()}
    assert audit["1"].access_decisions == {"c1": True, "c2": True, "c4": False}
    assert audit["1"].filtered_out_ids == ["c4"] and audit["1"].returned_count == 1
    assert audit["1"].decrypted_embedding_count == 2
    assert audit["2"].filtered_out_ids == ["c3"] and audit["2"].returned_ids == []
    assert audit["5"].status == "denied"


def test_pairs_store_no_denied_payload(spark, gold, users, keys, contracts, tmp_path,
                                       monkeypatch):
    monkeypatch.setattr(scratch, "scratch_path",
                        lambda _, label: str(tmp_path / f"{label}-{uuid.uuid4().hex}"))
    pairs = spark.createDataFrame([("2", "c3"), ("2", "c4"), ("2", "c2")],
                                  "request_id string, chunk_id string")
    out = retrieval.retrieve_pairs(requests(spark, ("2", "ana", "q", 3)), pairs, gold, users,
                                   keys, contracts)
    assert by_request(out.results) == {"2": ["c2"]}
    denied = {bytes(r.embedding_ciphertext) for r in gold.filter(
        "chunk_id IN ('c3', 'c4')").collect()}
    files = list(tmp_path.rglob("*.parquet"))
    assert files and len(denied) == 2
    for file in files:
        for column in pq.read_table(file).columns:
            assert not denied & {v for v in column.to_pylist() if isinstance(v, bytes)}


def test_pairs_with_a_chunk_of_two_rows(spark, gold, users, keys, contracts):
    again = gold.filter("chunk_id = 'c3'").withColumn(
        "classification", F.lit("public")).withColumn("embedding_id", F.lit("other"))
    pairs = spark.createDataFrame([("2", "c3"), ("2", "c4")],
                                  "request_id string, chunk_id string")
    out = retrieval.retrieve_pairs(requests(spark, ("2", "ana", "q", 3)), pairs,
                                   gold.unionByName(again), users, keys, contracts)
    row = out.audit.first()
    assert row.access_decisions == {"c3": True, "c4": False}
    assert by_request(out.results) == {"2": ["c3"]}


def test_search_decisions_of_both_modes(spark, gold, users, keys, contracts, tmp_path):
    batch = requests(spark, ("1", "ana", "q", 1), ("5", "ghost", "q", 3))
    pairs = spark.createDataFrame([(r, c[0]) for r in ("1", "5") for c in ROWS],
                                  "request_id string, record_id string")
    for mode, ghost in (("secure", set()), ("insecure", {"c1"})):
        found = retrieval.secure_retrieve(batch, gold, users, keys, contracts, mode)
        retrieval.store_decisions(found, str(tmp_path / mode))
        stored = found._replace(
            granted=spark.read.parquet(str(tmp_path / mode / "granted")),
            members=spark.read.parquet(str(tmp_path / mode / "members")))
        judged = retrieval.decided(stored, pairs).collect()
        assert len(judged) == 2 * len(ROWS)
        assert {(r.request_id, r.record_id) for r in judged if r.allowed} == {
            ("1", "c1"), ("1", "c2"), ("1", "c5"), *(("5", c) for c in ghost)}


def test_index_lookup_and_strategies(spark, gold, keys):
    table = pipeline.build_index(gold.filter("chunk_id <> 'c5'"), keys)
    batch = requests(spark, ("1", "adm", "q", 9))
    near = retrieval.nearest_candidates(batch, table, 3)
    rows = near.orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["c1", "c2", "c4"]
    assert rows[0].distance == 0.0 and rows[0].classification == "public"
    some = retrieval.nearest_candidates(batch, table, 3, F.col("classification") != "public")
    assert [r.chunk_id for r in some.orderBy("rank").collect()] == ["c2", "c4", "c3"]
    linked = spark.createDataFrame([("1", "c2", 1), ("1", "c3", 1), ("1", "c9", 2)],
                                   "request_id string, chunk_id string, hops int")

    def order(strategy):
        pairs = retrieval.strategy_pairs(strategy, near, linked)
        return [r.chunk_id for r in pairs.orderBy("position", "chunk_id").collect()]

    assert order("vector_first") == ["c1", "c2", "c4"]
    assert order("graph_first") == ["c2", "c3", "c9"]
    assert order("hybrid") == ["c1", "c2", "c4", "c3", "c9"]
    with pytest.raises(ValueError):
        order("other")


def fact(spark, **values):
    base = dict(fact_id="f1", fact_type="incident_commander", subject="Net", predicate="p",
                object="a@x", document_id="d4", chunk_id="c4", classification="restricted",
                allowed_roles=["hr_manager"], department="y", source_path="p",
                confidence=1.0, extraction_method="m", created_at=STAMP)
    row = {**base, **values}
    return spark.createDataFrame([tuple(row[n] for n in table_schema("facts").names)],
                                 table_schema("facts"))


def test_governed(spark, gold, users, keys, contracts):
    ask = "Who was the incident commander of "
    batch = requests(spark, ("1", "adm", ask + "net?", 2), ("2", "ana", ask + "net?", 2),
                     ("3", "ana", ask + "gross", 2), ("4", "ana", "tell me", 2),
                     ("5", "ghost", "tell me", 2), ("6", "ghost", ask + "net", 2))
    out = retrieval.governed_retrieve(batch, gold, fact(spark), users, keys, contracts)
    got = {r.request_id: r for r in out.answers.collect()}

    def view(i):
        r = got[i]
        return (r.answer_type, r.status, r.strategy, r.blocked_count,
                [s.chunk_id for s in r.sources])

    refused = "no_authorized_information"
    assert view("1") == ("fact_answer", "answered", "fact_lookup", 0, ["c4"])
    assert got["1"].answer == "The incident commander was a@x."
    assert view("2") == ("no_answer", refused, "fact_lookup", 1, [])
    assert view("3") == ("no_fact_answer", "no_fact_answer", "hybrid", 2, ["c1", "c2"])
    assert got["3"].answer == fv.NO_FACT_BUT_CANDIDATES
    assert view("4") == ("candidate_list", "answered", "semantic", 2, ["c1", "c2"])
    assert view("5") == ("no_answer", refused, "semantic", 0, [])
    assert view("6") == ("no_answer", refused, "hybrid", 0, [])
    assert got["4"].sources[0].score == 1.0 and got["4"].sources[0].source_path == "p/c1"
    modes = {(r.request_id, r.mode) for r in out.audit.collect()}
    assert {("3", "fact_retrieve"), ("3", "secure"), ("1", "fact_retrieve")} <= modes
    assert ("1", "secure") not in modes


def test_governed_in_blocks_copies_no_candidates(spark, gold, users, keys, contracts,
                                                 monkeypatch):
    from guardmill.operators import nearest

    asked = [(str(i), ("ana", "adm", "ghost")[i % 3], "tell me", 2) for i in range(12)]

    def answered():
        out = retrieval.governed_retrieve(requests(spark, *asked), gold, fact(spark), users,
                                          keys, contracts)
        return sorted((r.request_id, r.blocked_count, [s.chunk_id for s in r.sources])
                      for r in out.answers.collect())

    def copied(*args):
        raise AssertionError("candidates are copied per block of requests")

    plain = answered()
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 4)
    monkeypatch.setattr(nearest, "_best_rows", copied)
    assert answered() == plain and len(plain) == 12


def test_governed_without_candidates(spark, gold, users, keys, contracts):
    batch = requests(spark, ("3", "ana", "who was the incident commander of gross", 2),
                     ("4", "ana", "tell me", 2))
    out = retrieval.governed_retrieve(batch, gold.filter("false"), fact(spark), users, keys,
                                      contracts)
    assert {r.request_id: r.strategy for r in out.answers.collect()} == {
        "3": "fact_lookup", "4": "semantic"}


def test_text_model_context(spark, gold, users, keys, contracts):
    batch = requests(spark, ("2", "ana", "q", 2), ("5", "ghost", "q", 2))
    out = retrieval.secure_retrieve(batch, gold, users, keys, contracts)
    got = {r.request_id: r for r in
           retrieval.text_model_context(batch, out.results, users).collect()}
    assert got["2"].source_count == 2 and not got["2"].text_model_enabled
    assert got["2"].authorized_sources[0].asDict() == {
        "chunk_id": "c1", "document_id": "d1", "classification": "public", "owner": "me",
        "department": "x"}
    assert got["5"].source_count == 0 and got["5"].user_role == "unknown"


def test_query_vectors_use_the_document_encoder(spark):
    settings = pipeline.EmbeddingSettings(key_id="k1", created_at=STAMP, dim=8)
    batch = spark.createDataFrame([("1", "u", "a b"), ("2", "u", None)],
                                  "request_id string, user_id string, query string")
    rows = retrieval.with_query_vectors(batch, settings).orderBy("request_id").collect()
    assert np.linalg.norm(rows[0].query_vector) == pytest.approx(1.0, abs=1e-6)
    assert not any(rows[1].query_vector)
