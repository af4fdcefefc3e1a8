"""Catalogue of governed datasets with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import Contracts


def with_lineage(entities: DataFrame, edges: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Adds sorted `lineage_upstream` and `lineage_downstream`."""
    def side(of: str, other: str, name: str) -> DataFrame:
        return (edges.groupBy(F.col(of).alias(key))
                .agg(F.array_sort(F.collect_set(other)).alias(name)))

    nothing = F.array().cast("array<string>")
    joined = (entities.join(side("target", "source", "lineage_upstream"), key, "left")
              .join(side("source", "target", "lineage_downstream"), key, "left"))
    return (joined.withColumn("lineage_upstream", F.coalesce("lineage_upstream", nothing))
            .withColumn("lineage_downstream", F.coalesce("lineage_downstream", nothing)))


def entity_type(dataset_id, layer):
    kind = F.lit("Table")
    for name, value in fv.ENTITY_TYPES.items():
        kind = F.when(layer == name, F.lit(value)).otherwise(kind)
    for name, value in fv.ENTITY_TYPE_BY_DATASET.items():
        kind = F.when(dataset_id == name, F.lit(value)).otherwise(kind)
    return kind


def build_catalog(spark: SparkSession, contracts: Contracts) -> DataFrame:
    """One row per dataset: type, owner, fields, lineage, security notes."""
    described = contracts.datasets_frame(spark).withColumn(
        "type", entity_type(F.col("dataset_id"), F.col("layer")))
    listed = (contracts.fields_frame(spark).groupBy("dataset_id")
              .agg(F.array_sort(F.collect_list(
                  F.struct("position", "name", "type", "description"))).alias("f"))
              .select("dataset_id", F.transform("f", lambda x: F.struct(
                  x["name"].alias("name"), x["type"].alias("type"),
                  x["description"].alias("description"))).alias("fields")))
    joined = with_lineage(described.join(listed, "dataset_id", "left"),
                          contracts.lineage_frame(spark))
    return joined.select(
        F.col("dataset_id").alias("id"), "name", "type", "layer", "owner", "description",
        "tags", "classification",
        F.coalesce("fields", F.array().cast(
            "array<struct<name:string,type:string,description:string>>")).alias("fields"),
        "lineage_upstream", "lineage_downstream", "security_notes", "sensitive_flags")


def governance_summary(catalog: DataFrame) -> DataFrame:
    """The catalogue columns a screen may show."""
    return catalog.select("id", "name", "type", "owner", "description", "tags",
                          "classification", "lineage_upstream", "lineage_downstream",
                          "security_notes")


def security_model(spark: SparkSession, contracts: Contracts) -> DataFrame:
    """One row: levels, roles, clearance order and how vectors are protected."""
    order = {level: i for i, level in enumerate(contracts.levels)}
    return spark.createDataFrame(
        [(list(contracts.levels), list(contracts.roles), order, fv.ENCRYPTION_ALGORITHM,
          "governed_views_only")],
        "classifications array<string>, roles array<string>, "
        "clearance_order map<string,int>, encryption_algorithm string, "
        "direct_sql_access string")


def safe_and_sensitive_fields(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """Field lists per dataset: those safe to show and those declared sensitive."""
    hidden = datasets.select(
        "dataset_id", "sensitive_fields",
        F.array_union("sensitive_fields", "forbidden_fields").alias("hidden"))
    named = F.when(~(F.col("sensitive") | F.col("forbidden_in_safe_views")),
                   F.struct("position", "name"))
    listed = fields.groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(named)).alias("open"))
    safe = F.filter(F.col("open.name"), lambda f: ~F.array_contains(F.col("hidden"), f))
    return hidden.join(listed, "dataset_id", "left").select(
        "dataset_id",
        F.coalesce(safe, F.array().cast("array<string>")).alias("safe_fields"),
        "sensitive_fields")
