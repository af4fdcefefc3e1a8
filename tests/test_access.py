from itertools import product

import pytest
from pyspark.sql import functions as F

from guardmill.contracts import Contracts, Policy, Role
from guardmill.functions import access
from guardmill.operators import authorize, grants

LEVELS = ["public", "internal", "confidential", "restricted"]
ROLES = ["admin", "hr_manager", "external_viewer", None, "odd\x1frole"]
DEPARTMENTS = ["finance", "Finance", None]


def decide(contracts, user, record):
    """The rule in plain Python, for comparison."""
    cls = record["classification"]
    if user is None:
        return cls == "public"
    policy = contracts.policies.get(cls)
    if policy is None:
        return False
    if policy.open_to_all or user["role"] in contracts.all_access_roles():
        return True
    if policy.clearances and (user["clearance"] or "public") not in policy.clearances:
        return False
    if policy.needs_role and (user["role"] or "unknown") not in (record["roles"] or []):
        return False
    return not (policy.needs_department and user["department"] != record["department"])


def grid(spark, contracts):
    records = [(f"r{i}", c, r, d) for i, (c, r, d) in enumerate(product(
        [*LEVELS, "secret", "", None],
        [None, [], ["hr_manager"], ["hr_manager", "hr_manager", "odd\x1frole"], ["unknown"]],
        DEPARTMENTS))]
    users = [(f"u{i}", r, c, d) for i, (r, c, d) in enumerate(product(
        ROLES, [*LEVELS, None], DEPARTMENTS))]
    rdf = spark.createDataFrame(records, "record_id string, classification string, "
                                         "allowed_roles array<string>, department string")
    udf = spark.createDataFrame(users, "user_id string, role string, "
                                       "clearance_level string, department string")
    expected = {
        (u[0], r[0]) for u in users for r in records
        if decide(contracts, dict(zip(("role", "clearance", "department"), u[1:], strict=True)),
                  dict(zip(("classification", "roles", "department"), r[1:], strict=True)))}
    return records, users, rdf, udf, expected


def odd_contracts():
    """Policies the built-in set does not have: department without role, no clearances."""
    policies = {p.classification: p for p in (
        Policy("public", False, ("internal",), False, False),
        Policy("internal", False, (), False, True),
        Policy("confidential", False, (), True, False),
        Policy("secret", True))}
    return Contracts({}, {"admin": Role("admin", capabilities={"can_access_all_records": True})},
                     policies, (), ("public",))


@pytest.mark.parametrize("which", ["built-in", "odd"])
def test_tokens_and_rule_agree_with_plain_python(spark, contracts, which):
    rules = contracts if which == "built-in" else odd_contracts()
    _, _, records, users, expected = grid(spark, rules)
    pairs = authorize.authorized_pairs(records, users, rules, ["record_id"]).collect()
    assert len(pairs) == len(set(pairs)), "a pair must match on one token only"
    assert {tuple(p) for p in pairs} == expected

    every = users.select("user_id", "role", "clearance_level",
                         F.col("department").alias("user_department")).crossJoin(records)
    user = access.UserColumns(F.col("role"), F.col("clearance_level"),
                              F.col("user_department"))
    by_rule = every.filter(access.allowed(rules, user)).select("user_id", "record_id")
    assert {tuple(r) for r in by_rule.collect()} == expected


def test_anonymous_sees_public_only(spark, contracts):
    records, _, rdf, _, _ = grid(spark, contracts)
    seen = {r.record_id for r in authorize.authorized_rows(rdf, None, contracts).collect()}
    assert seen == {r[0] for r in records if r[1] == "public"}
    opened = rdf.filter(F.array_contains(access.record_tokens(contracts),
                                         access.ANONYMOUS_TOKEN))
    assert {r.record_id for r in opened.collect()} == seen


def test_counts_match_pairs(spark, contracts):
    _, _, records, users, expected = grid(spark, contracts)
    counted = authorize.authorized_counts(records, users, contracts).collect()
    per_user = {}
    for row in counted:
        per_user[row.user_id] = per_user.get(row.user_id, 0) + row.n
    truth = {}
    for user, _ in expected:
        truth[user] = truth.get(user, 0) + 1
    assert per_user == truth


def test_user_flag_opens_everything(spark, contracts):
    _, _, records, _, _ = grid(spark, contracts)
    user = {"role": "hr_manager", "can_access_all_records": True}
    seen = authorize.authorized_rows(records, user, contracts)
    assert {r.classification for r in seen.collect()} == set(LEVELS)


def test_filter_for_one_user_reaches_the_scan(spark, contracts, tmp_path):
    _, _, records, _, _ = grid(spark, contracts)
    records.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    visible = authorize.authorized_rows(stored, {"role": "x", "clearance_level": "public"},
                                        contracts).select("record_id")
    plan = visible._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_reasons(spark, contracts):
    rows = spark.createDataFrame([
        (1, True, "admin", "restricted", "x", "restricted", ["hr"], "y"),
        (2, True, "hr", "internal", "x", "confidential", ["hr"], "x"),
        (3, True, "hr", "confidential", "x", "confidential", ["it", "ops"], "x"),
        (4, True, "hr", "restricted", "x", "restricted", ["hr"], None),
        (5, True, "hr", "restricted", None, "restricted", ["hr"], None),
        (6, False, None, None, None, "internal", None, "x"),
        (7, True, "hr", "public", "x", "", None, "x"),
        (8, True, "hr", "public", "x", "public", None, "x"),
    ], "i int, user_known boolean, user_role string, user_clearance string, "
       "user_department string, classification string, allowed_roles array<string>, "
       "department string")
    got = {r.i: (r.granted, r.reason) for r in
           authorize.explain_pairs(rows, contracts).collect()}
    assert got == {
        1: (True, "User may access all records"),
        2: (False, "Insufficient clearance: internal not in [confidential, restricted]"),
        3: (False, "User role hr not in allowed_roles: [it, ops]"),
        4: (False, "User department x != record department none"),
        5: (True, "User has required clearance and role for restricted"),
        6: (False, "Unauthenticated user; public records only"),
        7: (False, "Unknown classification: unknown"),
        8: (True, "Public record; accessible to everyone"),
    }


def test_select_grants(spark):
    users = spark.createDataFrame(
        [("a", "admin"), ("e", "external_viewer"), ("d", "data_engineer")],
        "user_id string, role string")
    op = "SelectFromColumns"
    asked = spark.createDataFrame([
        (1, "a", op, "raw", "gold_embeddings", "chunk_id"),
        (2, "a", op, "raw", "gold_embeddings", "key_id"),
        (3, "e", op, "safe", "v_public_chunks", None),
        (4, "e", op, "safe", "silver_chunks", None),
        (5, "d", op, "raw", "silver_chunks", None),
        (6, "nobody", op, "safe", "v_public_chunks", None),
        (7, "a", "DropTable", "safe", "v_public_chunks", None),
    ], "i int, user_id string, operation string, schema_name string, table_name string, "
       "column_name string")
    got = {r.i: r.allowed for r in grants.decide_selects(asked, users).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_rules_first_match_wins(spark):
    asked = spark.createDataFrame([
        (1, "admin", "lakehouse", "raw", "t", "DELETE"),
        (2, "bob", "lakehouse", "safe", "t", "SELECT"),
        (3, "bob", "lakehouse", "safe", "t", "INSERT"),
        (4, "bob", "lakehouse", "raw", "t", "SELECT"),
        (5, "bob", "system", "safe", "t", "SELECT"),
    ], "i int, user_id string, catalog_name string, schema_name string, table_name string, "
       "privilege string")
    got = {r.i: r.allowed for r in grants.decide_by_rules(asked).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}
