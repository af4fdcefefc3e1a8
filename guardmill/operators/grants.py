"""Who may select which table and column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardmill import fixed_values as fv


def decide_selects(asked: DataFrame, users: DataFrame) -> DataFrame:
    """Adds `role`, `column_blocked` and `allowed` to select requests.

    asked: user_id, operation, schema_name, table_name, column_name (may be null).
    Denied unless the role is granted both schema and table and the column is not blocked.
    The grants are a few dozen configuration values, so they become a literal predicate.
    """
    role, table = F.col("role"), F.col("table_name")
    schema_ok = _granted(role, F.col("schema_name"), fv.GRANTED_SCHEMAS)
    table_ok = _granted(role, table, fv.GRANTED_TABLES)
    blocked = F.coalesce(F.col("column_name").isin(list(fv.BLOCKED_COLUMNS)), F.lit(False))
    selects = F.col("operation") == fv.SELECT_OPERATION
    decided = F.coalesce(selects & schema_ok & table_ok, F.lit(False)) & ~blocked
    known = users.select("user_id", "role")
    return (asked.join(known, "user_id", "left")
            .withColumn("column_blocked", blocked).withColumn("allowed", decided))


def _granted(role: Column, name: Column, grants: Mapping[str, Sequence[str]]) -> Column:
    rule = F.lit(False)
    for granted_role, names in grants.items():
        rule = rule | ((role == granted_role) & name.isin(list(names)))
    return rule


def decide_by_rules(asked: DataFrame, table_rules: Sequence[tuple] = fv.TABLE_RULES,
                    catalog_rules: Sequence[tuple] = fv.CATALOG_RULES) -> DataFrame:
    """Adds `allowed` by the access-control list: the first matching rule decides.

    asked: user_id, catalog_name, schema_name, table_name, privilege.
    """
    access = F.lit("none")
    for user, catalog, level in reversed(catalog_rules):
        access = F.when(_whole("user_id", user) & _whole("catalog_name", catalog),
                        F.lit(level)).otherwise(access)
    privilege = F.col("privilege")
    in_catalog = (access == "all") | ((access == "read-only") & (privilege == "SELECT"))
    granted = F.lit(False)
    for user, catalog, schema, table, privileges in reversed(table_rules):
        matches = (_whole("user_id", user) & _whole("catalog_name", catalog)
                   & _whole("schema_name", schema) & _whole("table_name", table))
        granted = F.when(matches, privilege.isin(list(privileges))).otherwise(granted)
    return asked.withColumn("allowed", F.coalesce(in_catalog & granted, F.lit(False)))


def _whole(column: str, pattern: str) -> Column:
    return F.col(column).rlike(rf"\A(?:{pattern})\z")
