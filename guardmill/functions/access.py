"""Access rules as column expressions.

Two equivalent forms:

* `allowed` - the decision for one (user, record) row, a CASE over the policies.
* access tokens - a record carries the tokens that open it, a user the tokens they hold;
  access is granted iff the two sets share a token, and they never share more than one.
  This turns "which users may read which records" into an equi-join on a short string, and
  lets counts be taken per token before any join, so users x records is never formed.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import Contracts, Policy

_SEP = "\x1f"
ANONYMOUS_TOKEN = "anonymous"


def _text(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def _flag(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(bool(value))


class UserColumns:
    """The user side of a decision; each attribute may be a column or a plain value."""

    def __init__(self, role: Any, clearance: Any, department: Any,
                 all_records: Any = False, known: Any = True):
        self.role = F.coalesce(_text(role), F.lit("unknown"))
        self.clearance = F.coalesce(_text(clearance), F.lit("public"))
        self.department = _text(department)
        self.flag = F.coalesce(_flag(all_records), F.lit(False))
        self.known = F.coalesce(_flag(known), F.lit(False))

    def sees_all(self, contracts: Contracts) -> Column:
        return self.flag | self.role.isin(contracts.all_access_roles())


def user_from_mapping(user: Mapping[str, Any] | None) -> UserColumns:
    """Literal columns for one user; None is an unauthenticated caller."""
    if user is None:
        return UserColumns(None, None, None, known=False)
    return UserColumns(user.get("role", "unknown"), user.get("clearance_level", "public"),
                       user.get("department"), user.get("can_access_all_records", False))


def user_from_columns(prefix: str = "", known: Column | None = None,
                      all_records: Column | None = None) -> UserColumns:
    return UserColumns(
        F.col(f"{prefix}role"), F.col(f"{prefix}clearance_level"),
        F.col(f"{prefix}department"),
        False if all_records is None else all_records,
        True if known is None else known)


def _clearance_ok(policy: Policy, user: UserColumns) -> Column:
    return user.clearance.isin(list(policy.clearances)) if policy.clearances else F.lit(True)


def _role_ok(policy: Policy, user: UserColumns, roles: Column) -> Column:
    return F.array_contains(roles, user.role) if policy.needs_role else F.lit(True)


def _department_ok(policy: Policy, user: UserColumns, department: Column) -> Column:
    if not policy.needs_department:
        return F.lit(True)
    return user.department.eqNullSafe(department)


def _record_roles(roles: Column) -> Column:
    return F.coalesce(roles, F.array().cast("array<string>"))


def allowed(contracts: Contracts, user: UserColumns, classification: Column | None = None,
            roles: Column | None = None, department: Column | None = None) -> Column:
    """The access decision for one row; never null."""
    classification = F.col("classification") if classification is None else classification
    roles = _record_roles(F.col("allowed_roles") if roles is None else roles)
    department = F.col("department") if department is None else department

    granted = F.lit(False)
    for policy in contracts.policies.values():
        if policy.open_to_all:
            rule = F.lit(True)
        else:
            rule = user.sees_all(contracts) | (
                _clearance_ok(policy, user) & _role_ok(policy, user, roles)
                & _department_ok(policy, user, department))
        granted = F.when(classification == policy.classification, rule).otherwise(granted)
    public = classification == "public"
    return F.coalesce(F.when(user.known, granted).otherwise(public), F.lit(False))


def reason(contracts: Contracts, user: UserColumns, classification: Column, roles: Column,
           department: Column) -> Column:
    """Why `allowed` says what it says, tested in the order the decision uses."""
    roles = _record_roles(roles)
    named = F.coalesce(F.nullif(classification, F.lit("")), F.lit("unknown"))
    text = F.concat(F.lit(fv.REASON_UNKNOWN), named)
    for policy in contracts.policies.values():
        if policy.open_to_all:
            why = F.lit(
                fv.REASON_PUBLIC if policy.classification == "public"
                else fv.REASON_GRANTED + policy.classification)
        else:
            needed = ", ".join(sorted(policy.clearances))
            why = (
                F.when(user.sees_all(contracts), F.lit(fv.REASON_ALL_RECORDS))
                .when(~_clearance_ok(policy, user),
                      F.concat(F.lit(fv.REASON_CLEARANCE), user.clearance,
                               F.lit(f" not in [{needed}]")))
                .when(~_role_ok(policy, user, roles),
                      F.concat(F.lit(fv.REASON_ROLE), user.role,
                               F.lit(" not in allowed_roles: ["),
                               F.array_join(roles, ", "), F.lit("]")))
                .when(~_department_ok(policy, user, department),
                      F.concat(F.lit(fv.REASON_DEPARTMENT),
                               F.coalesce(user.department, F.lit("none")),
                               F.lit(" != record department "),
                               F.coalesce(department, F.lit("none"))))
                .otherwise(F.lit(fv.REASON_GRANTED + policy.classification)))
        text = F.when(named == policy.classification, why).otherwise(text)
    return F.when(user.known, text).otherwise(
        F.lit(fv.REASON_UNAUTHENTICATED))


def _token(policy: Policy, *parts: str | Column) -> Column:
    return F.concat_ws(_SEP, F.lit(policy.classification),
                       *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _department_part(department: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), department), F.lit("null"))


def record_tokens(contracts: Contracts, classification: Column | None = None,
                  roles: Column | None = None, department: Column | None = None) -> Column:
    """array<string>: the tokens that open a record (empty = nobody)."""
    classification = F.col("classification") if classification is None else classification
    roles = F.array_distinct(F.array_compact(
        _record_roles(F.col("allowed_roles") if roles is None else roles)))
    department = F.col("department") if department is None else department
    nothing = F.array().cast("array<string>")

    tokens = nothing
    for policy in contracts.policies.values():
        dept = _department_part(department)
        if policy.open_to_all:
            opens = F.array(_token(policy, "any"))
        else:
            if policy.needs_role and policy.needs_department:
                ruled = F.transform(roles, lambda r: _token(policy, "rd", r, dept))  # noqa: B023
            elif policy.needs_role:
                ruled = F.transform(roles, lambda r: _token(policy, "r", r))  # noqa: B023
            elif policy.needs_department:
                ruled = F.array(_token(policy, "d", dept))
            else:
                ruled = F.array(_token(policy, "any"))
            opens = F.concat(F.array(_token(policy, "all")), ruled)
        tokens = F.when(classification == policy.classification, opens).otherwise(tokens)
    anonymous = F.when(classification == "public",
                       F.array(F.lit(ANONYMOUS_TOKEN))).otherwise(nothing)
    return F.concat(tokens, anonymous)


def user_tokens(contracts: Contracts, user: UserColumns) -> Column:
    """array<string>: the tokens a user holds, at most one per classification."""
    held = []
    for policy in contracts.policies.values():
        if policy.open_to_all:
            held.append(_token(policy, "any"))
            continue
        dept = _department_part(user.department)
        if policy.needs_role and policy.needs_department:
            own = _token(policy, "rd", user.role, dept)
        elif policy.needs_role:
            own = _token(policy, "r", user.role)
        elif policy.needs_department:
            own = _token(policy, "d", dept)
        else:
            own = _token(policy, "any")
        held.append(F.when(user.sees_all(contracts), _token(policy, "all"))
                    .when(_clearance_ok(policy, user), own))
    return F.when(user.known, F.array_compact(F.array(*held))).otherwise(
        F.array(F.lit(ANONYMOUS_TOKEN)))


def token_classification(token: Column) -> Column:
    """Classification a token belongs to (anonymous tokens open public records)."""
    return F.when(token == ANONYMOUS_TOKEN, F.lit("public")).otherwise(
        F.substring_index(token, _SEP, 1))
