"""Metadata quality checks, one pass per dataset."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardmill import fixed_values as fv
from guardmill.contracts import Contracts, Dataset

REPORT = ("dataset_id string, check string, kind string, passed boolean, missing bigint, "
          "total bigint, message string")
_SAFE_LAYERS = ("serving", "ui")


def is_filled(df: DataFrame, name: str) -> Column:
    """Not null, not '' and not an empty list; 0 and false count as filled."""
    if name not in df.columns:
        return F.lit(False)
    value, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return value.isNotNull() & (value != "")
    if isinstance(kind, T.ArrayType):
        return value.isNotNull() & (F.size(value) > 0)
    return value.isNotNull()


def _finding(check: str | Column, kind: str, passed: Column, missing: Column, total: Column,
             message: Column, applies: Column) -> Column:
    return F.struct(
        (F.lit(check) if isinstance(check, str) else check).alias("check"),
        F.lit(kind).alias("kind"), passed.alias("passed"), missing.alias("missing"),
        total.alias("total"), message.alias("message"), applies.alias("applies"))


def _count_finding(check: str, bad: Column, total: Column, words: str,
                   applies: Column) -> Column:
    message = F.when(bad > 0, F.concat(bad.cast("string"), F.lit("/"),
                                       total.cast("string"), F.lit(f" {words}")))
    return _finding(check, "check", bad == 0, bad, total, message, applies)


def _plan(dataset: Dataset, df: DataFrame) -> tuple[dict[str, Column], list[Column]]:
    """What to count over the rows of a dataset, and the findings from those counts."""
    total = F.count(F.lit(1)).cast("bigint")
    measures = {"total": total}
    findings: list[Column] = []
    any_rows, always, n = F.col("total") > 0, F.lit(True), F.col("total")

    def counted(name: str, condition: Column) -> Column:
        measures[name] = F.count_if(condition).cast("bigint")
        return F.col(f"`{name}`")

    for field in dataset.required:
        bad = counted(f"missing {field}", ~is_filled(df, field))
        name = fv.CHECK_NAMES.get((dataset.id, field), f"{dataset.id}_have_{field}")
        findings.append(_count_finding(name, bad, n, f"missing {field}", any_rows))

    if dataset.id == "silver_chunks" and "classification" in df.columns:
        guarded = F.col("classification").isin("confidential", "restricted")
        of = counted("guarded", guarded)
        bad = counted("no roles", guarded & ~is_filled(df, "allowed_roles"))
        findings.append(_count_finding(fv.ROLE_CHECK, bad, of,
                                       "confidential chunks missing allowed_roles", always))
    if dataset.id == "gold_embeddings":
        bad = counted("no key", ~is_filled(df, "key_id"))
        findings.append(_count_finding(fv.KEY_CHECK, bad, n, "missing encryption key_id",
                                       always))
        plain = [f.name for f in df.schema if _is_vector(f.dataType)]
        findings.append(_finding(
            fv.PLAINTEXT_CHECK, "check", F.lit(not plain),
            F.lit(len(plain)).cast("bigint"), F.lit(len(df.columns)).cast("bigint"),
            F.lit(f"plain vector columns: {', '.join(plain)}" if plain else None).cast(
                "string"), always))
    if dataset.layer in _SAFE_LAYERS:
        for field in dataset.forbidden:
            bad = counted(f"exposed {field}", is_filled(df, field))
            findings.append(_count_finding(
                f"{dataset.id}_no_{field}", bad, n,
                f"records expose forbidden field {field}", always))
    findings.append(_warning(dataset.id, F.concat(
        F.lit(f"No {dataset.id.split('_')[0]} records found")), F.col("total") == 0))

    return measures, findings


def _dataset_findings(dataset: Dataset, df: DataFrame) -> DataFrame:
    measures, findings = _plan(dataset, df)
    return _found(dataset, findings, df.agg(*(m.alias(n) for n, m in measures.items())))


def _found(dataset: Dataset, findings: list[Column], counts: DataFrame) -> DataFrame:
    return (counts.select(F.explode(F.array(*findings)).alias("f"))
            .filter("f.applies")
            .select(F.lit(dataset.id).alias("dataset_id"), "f.check", "f.kind", "f.passed",
                    "f.missing", "f.total", "f.message"))


class WriteChecks:
    """Quality checks counted while rows are written, at no second scan.

    `watch` puts the counts of a dataset's checks onto a frame; the next action on that frame
    takes them. `report` is that of `quality_report` over all frames watched. The counts of
    a frame that is never written are waited for, so only watch what is.
    """

    def __init__(self, contracts: Contracts):
        self._contracts = contracts
        self._watched: list[tuple[str, Observation | None, DataFrame | None]] = []

    def watch(self, dataset_id: str, df: DataFrame) -> DataFrame:
        if dataset_id not in self._contracts.datasets:
            self._watched.append((dataset_id, None, df))
            return df
        measures, _ = _plan(self._contracts.datasets[dataset_id], df)
        taken = Observation(f"{dataset_id} {uuid.uuid4().hex}")
        self._watched.append((dataset_id, taken, df))
        return df.observe(taken, *(m.alias(n) for n, m in measures.items()))

    def absent(self, dataset_id: str) -> None:
        """A dataset that should have been there."""
        self._watched.append((dataset_id, None, None))

    def report(self, spark: SparkSession) -> DataFrame:
        parts = []
        for dataset_id, taken, df in self._watched:
            if taken is None:
                parts.append(quality_report(spark, {dataset_id: df}, self._contracts))
                continue
            dataset = self._contracts.datasets[dataset_id]
            measures, findings = _plan(dataset, df)
            counts = taken.get
            one = spark.createDataFrame([tuple(counts[n] for n in measures)],
                                        ", ".join(f"`{n}` bigint" for n in measures))
            parts.append(_found(dataset, findings, one))
        report = parts[0] if parts else spark.createDataFrame([], REPORT)
        for part in parts[1:]:
            report = report.unionByName(part)
        return report


def _warning(dataset_id: str, message: Column, applies: Column) -> Column:
    nothing = F.lit(None).cast("bigint")
    return _finding(dataset_id, "warning", F.lit(None).cast("boolean"), nothing, nothing,
                    message, applies)


def _is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(
        kind.elementType, (T.FloatType, T.DoubleType))


def quality_report(spark: SparkSession, datasets: Mapping[str, DataFrame | None],
                   contracts: Contracts) -> DataFrame:
    """One row per check (kind 'check') or remark (kind 'warning')."""
    parts = []
    for dataset_id, df in datasets.items():
        label = dataset_id.split("_")[0]
        remarks = []
        if df is None:
            remarks.append(f"No {label} records found")
        if dataset_id not in contracts.datasets:
            remarks.append(f"No contract found for dataset {dataset_id}")
        if remarks:
            parts.append(spark.createDataFrame(
                [(dataset_id, dataset_id, "warning", None, None, None, r) for r in remarks],
                REPORT))
        if dataset_id in contracts.datasets:
            dataset = contracts.datasets[dataset_id]
            if df is not None:
                parts.append(_dataset_findings(dataset, df))
            else:
                absent = spark.createDataFrame([], "classification string")
                parts.append(_dataset_findings(dataset, absent).filter("kind = 'check'"))
    report = parts[0] if parts else spark.createDataFrame([], REPORT)
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def quality_summary(report: DataFrame) -> DataFrame:
    """passed, total, warnings and overall status."""
    checks = F.col("kind") == "check"
    return report.agg(
        F.count_if(checks & F.col("passed")).alias("passed"),
        F.count_if(checks).alias("total"),
        F.count_if(F.col("kind") == "warning").alias("warnings"),
        F.when(F.coalesce(F.bool_and(F.when(checks, F.col("passed"))), F.lit(True)),
               "passed").otherwise("failed").alias("status"))
