import pytest
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import Contracts, Dataset, default_contracts, read_contracts, table_schema
from guardmill.operators import audit, catalog, quality


def test_built_in_contracts():
    c = default_contracts()
    assert len(c.datasets) == 11 and len(c.roles) == 8 and len(c.lineage) == 12
    assert c.all_access_roles() == ["admin"]
    assert c.policy("restricted").needs_department
    assert c.dataset("gold_embeddings").safe_fields() == [
        "embedding_id", "chunk_id", "document_id", "embedding_algorithm", "embedding_dim",
        "embedding_model", "classification", "allowed_roles", "owner", "department"]
    for lookup in (c.dataset, c.role, c.policy):
        with pytest.raises(KeyError):
            lookup("absent")


def test_contract_frames(spark, contracts):
    assert contracts.policies_frame(spark).filter("accessible_to_all").count() == 1
    assert contracts.roles_frame(spark).filter("can_access_all_records").count() == 1
    assert contracts.lineage_frame(spark).count() == 12
    fields = catalog.safe_and_sensitive_fields(contracts.datasets_frame(spark),
                                               contracts.fields_frame(spark))
    gold = fields.filter("dataset_id = 'gold_embeddings'").first()
    assert gold.safe_fields == contracts.dataset("gold_embeddings").safe_fields()
    assert set(gold.sensitive_fields) == set(fv.GOLD_FORBIDDEN)


def test_contract_files(tmp_path):
    with pytest.raises(FileNotFoundError, match="datasets.yml"):
        read_contracts(tmp_path)
    (tmp_path / "security").mkdir()
    (tmp_path / "datasets.yml").write_text(
        "datasets:\n  t:\n    layer: gold\n    required_fields: [a]\n"
        "    forbidden_fields: [b]\n    fields:\n"
        "      - {name: a, type: INT, required: true}\n      - {name: b}\n")
    (tmp_path / "lineage.yml").write_text("lineage:\n  - {source: a, target: b, type: x}\n")
    (tmp_path / "security" / "roles.yml").write_text(
        "roles:\n  boss:\n    clearance_level: high\n    capabilities:\n"
        "      can_access_all_records: true\n")
    (tmp_path / "security" / "classifications.yml").write_text("levels: [low, high]\n")
    (tmp_path / "security" / "access_policies.yml").write_text(
        "classification_policies:\n  high:\n    required_clearance_levels: [high]\n"
        "    requires_allowed_role: true\n")
    c = read_contracts(tmp_path)
    assert c.dataset("t").safe_fields() == ["a"] and c.dataset("t").name == "t"
    assert c.all_access_roles() == ["boss"] and c.policy("high").clearances == ("high",)
    assert c.lineage == (("a", "b", "x"),) and c.levels == ("low", "high")


def test_catalog(spark, contracts):
    built = {r.id: r for r in catalog.build_catalog(spark, contracts).collect()}
    assert built["secure_retrieval_service"].type == "API"
    assert built["audit_events"].type == "Log" and built["gold_embeddings"].type == "Table"
    assert built["superset_sql_ui"].type == "Application"
    assert built["gold_embeddings"].lineage_upstream == ["silver_chunks"]
    assert built["gold_embeddings"].lineage_downstream == [
        "chroma_vector_index", "secure_retrieval_service", "trino_governed_views"]
    assert built["landing_documents"].lineage_upstream == []
    assert [f.name for f in built["landing_documents"].fields] == ["document_id", "path"]
    assert built["superset_sql_ui"].fields == []
    shown = catalog.governance_summary(catalog.build_catalog(spark, contracts))
    assert "fields" not in shown.columns and shown.count() == 11
    model = catalog.security_model(spark, contracts).first()
    assert model.clearance_order["restricted"] == 3 and len(model.roles) == 8


def empty_like(spark, table):
    return spark.createDataFrame([], table_schema(table))


def test_quality_with_defects(spark, contracts):
    bronze = spark.createDataFrame(
        [("d1", "public", "me", ["r"]), ("d2", "public", None, ["r"])],
        "document_id string, classification string, owner string, "
        "allowed_roles array<string>")
    silver = spark.createDataFrame(
        [("c1", "d1", "confidential", []), ("c2", "d1", "public", [])],
        "chunk_id string, document_id string, classification string, "
        "allowed_roles array<string>")
    gold = spark.createDataFrame(
        [("e", "c1", "d1", "public", None, [1.0])],
        "embedding_id string, chunk_id string, document_id string, classification string, "
        "key_id string, vector array<float>")
    shown = spark.createDataFrame([("x", "leak")], "chunk_id string, key_id string")
    extended = Contracts(
        {**contracts.datasets,
         "screen": Dataset("screen", "Screen", layer="ui", forbidden=("key_id", "raw_text"))},
        contracts.roles, contracts.policies, contracts.lineage, contracts.levels)
    report = quality.quality_report(spark, {
        "bronze_documents": bronze, "silver_chunks": silver, "gold_embeddings": gold,
        "screen": shown, "unheard": shown, "audit_events": None}, extended)
    rows = report.collect()
    checks = {r.check: r for r in rows if r.kind == "check"}
    failed = {c for c, r in checks.items() if not r.passed}
    assert failed == {"bronze_documents_have_owner", fv.ROLE_CHECK, fv.KEY_CHECK,
                      fv.PLAINTEXT_CHECK, "screen_no_key_id"}
    assert checks["bronze_documents_have_owner"].message == "1/2 missing owner"
    assert checks["gold_embeddings_link_to_chunk"].passed
    warnings = [r.message for r in rows if r.kind == "warning"]
    assert warnings == ["No contract found for dataset unheard", "No audit records found"]
    summary = quality.quality_summary(report).first()
    assert summary.status == "failed" and summary.total - summary.passed == 5


def test_quality_without_rows(spark, contracts):
    report = quality.quality_report(spark, {
        t: empty_like(spark, t) for t in ("bronze_documents", "silver_chunks",
                                          "gold_embeddings")}, contracts)
    rows = report.collect()
    assert {r.check for r in rows if r.kind == "check"} == {
        fv.ROLE_CHECK, fv.KEY_CHECK, fv.PLAINTEXT_CHECK}
    assert {r.message for r in rows if r.kind == "warning"} == {
        f"No {n} records found" for n in ("bronze", "silver", "gold")}
    assert quality.quality_summary(report).first().status == "passed"


def test_filled(spark):
    df = spark.createDataFrame([("", [], 0, False), ("x", ["a"], 1, True),
                                (None, None, None, None)],
                               "s string, a array<string>, i int, b boolean")
    got = df.select(*(F.count_if(quality.is_filled(df, c)).alias(c)
                      for c in (*df.columns, "absent"))).first()
    assert tuple(got) == (1, 1, 2, 2, 0)


def events(spark):
    logins = audit.login_events(spark.createDataFrame(
        [("u1", "hr", "success", ""), ("u2", "unknown", "denied", "bad password")],
        "user_id string, role string, status string, reason string"))
    denied = audit.denied_events(spark.createDataFrame(
        [("u1", "hr", "c9", "chunk", "clearance")],
        "user_id string, role string, resource_id string, resource_type string, "
        "reason string"))
    search = audit.audit_events(spark.createDataFrame(
        [("r1", "u1", "hr", "q", "secure", 3, 7, "success")],
        "request_id string, user_id string, role string, query string, mode string, "
        "returned_count int, filtered_out_count long, status string"), "search")
    return logins.unionByName(denied).unionByName(search)


def test_audit_events_and_views(spark):
    log = events(spark)
    assert log.schema.names == table_schema("audit_events").names
    rows = log.collect()
    assert len({r.request_id for r in rows}) == 4
    assert {r.status for r in rows if r.event_type == "access_denied"} == {"denied"}
    assert all(r.timestamp.endswith("Z") for r in rows)
    mine = audit.audit_view(log, {"user_id": "u2", "role": "hr"}).collect()
    assert [(r.reason, r.returned_count, r.query) for r in mine] == [("bad password", 0, "")]
    assert audit.audit_view(log, {"user_id": "x", "role": "admin"}).count() == 4
    assert audit.audit_view(log, {}).count() == 0


def test_audit_totals(spark):
    viewers = spark.createDataFrame([("u1", "hr"), ("boss", "admin"), ("u3", None)],
                                    "user_id string, role string")
    got = {(r.viewer_id, r.event_type, r.status): (r.events, r.returned, r.filtered_out)
           for r in audit.audit_totals(events(spark), viewers).collect()}
    assert got[("u1", "search", "success")] == (1, 3, 7)
    assert got[("boss", "login", "denied")] == (1, 0, 0)
    assert got[("boss", "search", "success")] == (1, 3, 7)
    assert not any(k[0] == "u3" for k in got)
