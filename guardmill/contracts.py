"""Dataset, role, policy and lineage contracts.

Contracts are configuration, a few kilobytes of YAML, so they are read on the driver and
compiled into column expressions; `*_frame` methods expose them as small DataFrames for
jobs that join them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from guardmill import fixed_values as fv


@dataclass(frozen=True)
class Policy:
    classification: str
    open_to_all: bool = False
    clearances: tuple[str, ...] = ()
    needs_role: bool = False
    needs_department: bool = False


@dataclass(frozen=True)
class Role:
    name: str
    clearance: str = "public"
    capabilities: Mapping[str, bool] = field(default_factory=dict)
    description: str = ""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "STRING"
    required: bool = False
    sensitive: bool = False
    hidden: bool = False
    description: str = ""


@dataclass(frozen=True)
class Dataset:
    id: str
    name: str
    layer: str = ""
    owner: str = ""
    classification: str = "public"
    description: str = ""
    security_notes: str = ""
    tags: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    required: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    flags: Mapping[str, Any] = field(default_factory=dict)

    def safe_fields(self) -> list[str]:
        """All fields but the sensitive, forbidden and hidden ones."""
        off_limits = {*self.sensitive, *self.forbidden}
        return [
            f.name for f in self.fields
            if not (f.sensitive or f.hidden or f.name in off_limits)
        ]


@dataclass(frozen=True)
class Contracts:
    datasets: Mapping[str, Dataset]
    roles: Mapping[str, Role]
    policies: Mapping[str, Policy]
    lineage: Sequence[tuple[str, str, str]]
    levels: Sequence[str]

    def dataset(self, dataset_id: str) -> Dataset:
        return _entry(self.datasets, dataset_id, "dataset")

    def role(self, name: str) -> Role:
        return _entry(self.roles, name, "role")

    def policy(self, classification: str) -> Policy:
        return _entry(self.policies, classification, "classification")

    def all_access_roles(self) -> list[str]:
        return [r.name for r in self.roles.values()
                if r.capabilities.get("can_access_all_records")]

    # -- small DataFrames ---------------------------------------------------------

    def policies_frame(self, spark: SparkSession) -> DataFrame:
        order = {level: i for i, level in enumerate(self.levels)}
        rows = [
            (p.classification, order.get(p.classification), p.open_to_all, list(p.clearances),
             p.needs_role, p.needs_department)
            for p in self.policies.values()
        ]
        return spark.createDataFrame(
            rows,
            "classification string, clearance_order int, accessible_to_all boolean, "
            "required_clearance_levels array<string>, requires_allowed_role boolean, "
            "requires_department_match boolean")

    def roles_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.name, r.clearance, *(bool(r.capabilities.get(c)) for c in fv.CAPABILITIES))
            for r in self.roles.values()
        ]
        flags = ", ".join(f"{c} boolean" for c in fv.CAPABILITIES)
        return spark.createDataFrame(rows, f"role string, clearance_level string, {flags}")

    def lineage_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.lineage), "source string, target string, type string")

    def datasets_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (d.id, d.name, d.layer, d.owner, d.classification, d.description,
             d.security_notes, list(d.tags), list(d.required), list(d.sensitive),
             list(d.forbidden), {k: str(v).lower() for k, v in d.flags.items()})
            for d in self.datasets.values()
        ]
        return spark.createDataFrame(
            rows,
            "dataset_id string, name string, layer string, owner string, "
            "classification string, description string, security_notes string, "
            "tags array<string>, required_fields array<string>, "
            "sensitive_fields array<string>, forbidden_fields array<string>, "
            "sensitive_flags map<string,string>")

    def fields_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (d.id, i, f.name, f.type, f.required, f.sensitive, f.hidden, f.description)
            for d in self.datasets.values() for i, f in enumerate(d.fields)
        ]
        return spark.createDataFrame(
            rows,
            "dataset_id string, position int, name string, type string, required boolean, "
            "sensitive boolean, forbidden_in_safe_views boolean, description string")


def _entry(entries: Mapping[str, Any], name: str, kind: str) -> Any:
    try:
        return entries[name]
    except KeyError:
        raise KeyError(f"no {kind} contract named {name!r}") from None


def table_schema(table: str) -> T.StructType:
    """StructType of a contract table."""
    return T.StructType.fromDDL(fv.TABLE_DDL[table])


def default_contracts() -> Contracts:
    """The built-in contract set."""
    datasets = {
        id_: Dataset(
            id=id_, name=name, layer=layer, owner="data_platform", classification=cls,
            tags=tags,
            fields=tuple(Field(field, kind, required=needed, sensitive=secret, hidden=secret)
                         for field, kind, needed, secret in fv.DATASET_FIELDS.get(id_, ())),
            required=required, sensitive=sensitive, forbidden=forbidden)
        for id_, name, layer, cls, tags, required, sensitive, forbidden in fv.DATASETS
    }
    roles = {
        name: Role(name, clearance, dict(zip(fv.CAPABILITIES, flags, strict=True)))
        for name, clearance, *flags in fv.ROLES
    }
    policies = {row[0]: Policy(*row) for row in fv.ACCESS_POLICIES}
    return Contracts(datasets, roles, policies, fv.LINEAGE, fv.CLASSIFICATION_LEVELS)


def read_contracts(folder: str | Path) -> Contracts:
    """Contracts from a folder of YAML files; every one of the five files must be there."""
    import yaml

    folder = Path(folder)
    names = ("datasets", "lineage", "security/roles", "security/classifications",
             "security/access_policies")
    paths = {name: folder / f"{name}.yml" for name in names}
    absent = sorted(str(p) for p in paths.values() if not p.is_file())
    if absent:
        raise FileNotFoundError("missing contract files: " + ", ".join(absent))
    docs = {n: yaml.safe_load(p.read_text("utf-8")) or {} for n, p in paths.items()}

    datasets = {}
    for id_, spec in (docs["datasets"].get("datasets") or {}).items():
        datasets[id_] = Dataset(
            id=id_,
            name=spec.get("name", id_),
            layer=spec.get("layer", ""),
            owner=spec.get("owner", ""),
            classification=spec.get("classification", "public"),
            description=spec.get("description", ""),
            security_notes=spec.get("security_notes", ""),
            tags=tuple(spec.get("tags") or ()),
            fields=tuple(
                Field(f["name"], f.get("type", "STRING"), bool(f.get("required")),
                      bool(f.get("sensitive")), bool(f.get("forbidden_in_safe_views")),
                      f.get("description", ""))
                for f in spec.get("fields") or ()),
            required=tuple(spec.get("required_fields") or ()),
            sensitive=tuple(spec.get("sensitive_fields") or ()),
            forbidden=tuple(spec.get("forbidden_fields") or ()),
            flags=spec.get("sensitive_flags") or {})
    roles = {
        name: Role(name, spec.get("clearance_level", "public"),
                   spec.get("capabilities") or {}, spec.get("description", ""))
        for name, spec in (docs["security/roles"].get("roles") or {}).items()
    }
    policies = {
        c: Policy(c, bool(spec.get("accessible_to_all")),
                  tuple(spec.get("required_clearance_levels") or ()),
                  bool(spec.get("requires_allowed_role")),
                  bool(spec.get("requires_department_match")))
        for c, spec in
        (docs["security/access_policies"].get("classification_policies") or {}).items()
    }
    lineage = tuple((e["source"], e["target"], e["type"])
                    for e in docs["lineage"].get("lineage") or ())
    return Contracts(datasets, roles, policies, lineage,
                     tuple(docs["security/classifications"].get("levels") or ()))
