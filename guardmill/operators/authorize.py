"""Permission filters over whole tables."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import Contracts
from guardmill.functions import access
from guardmill.functions.rows import exploded


def authorized_rows(records: DataFrame, user: Mapping[str, Any] | None,
                    contracts: Contracts) -> DataFrame:
    """Rows one user may read; a plain filter that reaches the scan."""
    return records.filter(access.allowed(contracts, access.user_from_mapping(user)))


def with_tokens(records: DataFrame, contracts: Contracts, name: str = "tokens") -> DataFrame:
    return records.withColumn(name, access.record_tokens(contracts))


def users_with_tokens(users: DataFrame, contracts: Contracts,
                      name: str = "tokens") -> DataFrame:
    flag = F.col("can_access_all_records") if "can_access_all_records" in users.columns \
        else None
    return users.withColumn(name, access.user_tokens(
        contracts, access.user_from_columns(all_records=flag)))


def authorized_pairs(records: DataFrame, users: DataFrame, contracts: Contracts,
                     record_columns: list[str]) -> DataFrame:
    """(user_id, record columns) for every granted pair: an equi-join on access tokens."""
    opened = exploded(with_tokens(records, contracts), "tokens", "token", *record_columns)
    held = exploded(users_with_tokens(users, contracts), "tokens", "token", "user_id")
    return held.join(opened, "token").select("user_id", *record_columns)


def authorized_counts(records: DataFrame, users: DataFrame,
                      contracts: Contracts) -> DataFrame:
    """user_id, classification, n: how many records each user may read.

    Records are counted per token before the join, so its size depends on the number of
    distinct permissions and not on the number of records.
    """
    per_token = (exploded(with_tokens(records, contracts), "tokens", "token")
                 .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    held = exploded(users_with_tokens(users, contracts), "tokens", "token", "user_id")
    # a user holds one token per classification, so no further grouping is needed
    return held.join(per_token, "token").select(
        "user_id", access.token_classification(F.col("token")).alias("classification"), "n")


def explain_pairs(pairs: DataFrame, contracts: Contracts) -> DataFrame:
    """Decision and reason for given (user, record) rows.

    pairs: user_known, user_role, user_clearance, user_department and the record's
    classification, allowed_roles, department.
    """
    user = access.UserColumns(F.col("user_role"), F.col("user_clearance"),
                              F.col("user_department"), known=F.col("user_known"))
    cls, roles, dept = (F.col(c) for c in ("classification", "allowed_roles", "department"))
    none = F.lit("none")
    known = F.col("user_known")
    return (pairs
            .withColumn("granted", access.allowed(contracts, user))
            .withColumn("reason", access.reason(contracts, user, cls, roles, dept))
            .withColumn("classification", F.coalesce(F.nullif(cls, F.lit("")),
                                                     F.lit("unknown")))
            .withColumn("required_roles", F.coalesce(roles, F.array().cast("array<string>")))
            .withColumn("user_role", F.when(known, F.coalesce("user_role", F.lit("unknown")))
                        .otherwise(none))
            .withColumn("user_clearance", F.when(known, F.coalesce("user_clearance", none))
                        .otherwise(none))
            .withColumn("user_department", F.when(known, F.coalesce("user_department", none))
                        .otherwise(none))
            .withColumn("record_department", F.coalesce(dept, none))
            .drop("allowed_roles", "department", "user_known"))


def authorized_summary(records: DataFrame, user: Mapping[str, Any] | None,
                       contracts: Contracts) -> DataFrame:
    """The readable records with their summary columns and an access_status."""
    visible = authorized_rows(records, user, contracts)
    return visible.select(*(c for c in records.columns if c in fv.SUMMARY_FIELDS),
                          F.lit("authorized").alias("access_status"))
