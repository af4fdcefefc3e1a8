"""Governed inputs derived from the given tables.

The tables carry no governance columns; these functions add them with expressions that any
SQL engine can repeat. Every input covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.plans.pipeline import EmbeddingSettings, bronze_documents

STAMP = "2024-06-01T00:00:00Z"
KEY_ID = "key-7"
ROLE_SETS = (
    ("security_engineer", "compliance_officer"),
    ("finance_manager", "hr_manager", "data_engineer"),
    ("business_analyst", "security_engineer"),
)
DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A text table, spread over `spark.guardmill.textPartitions` tasks if that is set.

    For files of one row group, which one scan task has to read. Tables of many files or row
    groups are left to the scan.
    """
    df = table(spark, sf, name)
    parts = spark.conf.get("spark.guardmill.textPartitions", None)
    return df.repartition(int(parts), df.columns[0]) if parts else df


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def roles_for(index: Column) -> Column:
    sets = [F.array(*(F.lit(r) for r in s)) for s in ROLE_SETS]
    return F.when(index == 0, sets[0]).when(index == 1, sets[1]).otherwise(sets[2])


def role_names() -> list[str]:
    return [r[0] for r in fv.ROLES]


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """documents as bronze rows plus their text."""
    return governed_documents(texts(spark, sf, "documents"))


def governed_documents(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    return documents.select(
        d.cast("string").alias("document_id"),
        F.concat(F.lit("Document "), d).alias("title"),
        F.concat("source", F.lit("/"), d, F.lit(".txt")).alias("source_path"),
        pick(fv.CLASSIFICATION_LEVELS, d % 4).alias("classification"),
        F.concat(F.lit("owner-"), d % 7).alias("owner"),
        F.col("source").alias("department"),
        roles_for(d % 3).alias("allowed_roles"),
        F.concat(F.lit("1."), d % 5).alias("version"),
        F.lit(STAMP).alias("created_at"),
        (d % 2 == 0).alias("contains_sensitive_info"),
        F.sha2("text", 256).alias("document_hash"),
        "text")


def bronze(spark: SparkSession, sf: str) -> DataFrame:
    return bronze_documents(catalogue(spark, sf), STAMP)


def incident_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue with every text framed as an incident report."""
    docs = catalogue(spark, sf)
    d = F.col("document_id").cast("bigint")
    framed = F.concat(
        F.lit("INCIDENT REPORT: "), F.upper("department"), F.lit(" OUTAGE "), d % 40,
        F.lit("\n=====\n"), F.col("text"),
        F.lit("\nIncident commander: ops"), d % 50, F.lit("@example.org"))
    return docs.withColumn("text", framed)


def users(spark: SparkSession, sf: str) -> DataFrame:
    """customers as users."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.cast("string").alias("user_id"), F.col("c_name").alias("name"),
        pick(role_names(), c % 8).alias("role"),
        F.concat(F.lit("src"), F.col("c_nationkey") % 20).alias("department"),
        pick(fv.CLASSIFICATION_LEVELS, F.col("c_nationkey") % 4).alias("clearance_level"))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    """nations as a key table."""
    return table(spark, sf, "nation").select(
        F.concat(F.lit("key-"), "n_nationkey").alias("key_id"),
        F.unhex(F.sha2("n_name", 256)).alias("key"))


def settings(dim: int = DIM) -> EmbeddingSettings:
    return EmbeddingSettings(key_id=KEY_ID, created_at=STAMP, dim=dim)


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as governed chunk rows with their plain vector."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("c"), v).alias("chunk_id"),
        F.concat(F.lit("d"), F.floor(v / 4)).alias("document_id"),
        F.col("embedding"), F.col("label"), v.alias("vec_id"),
        pick(fv.CLASSIFICATION_LEVELS, v % 4).alias("classification"),
        roles_for(v % 3).alias("allowed_roles"),
        F.concat(F.lit("owner-"), v % 7).alias("owner"),
        F.concat(F.lit("src"), F.col("label")).alias("department"),
        F.concat(F.lit("v/"), v).alias("source_path"),
        F.lit("1.0").alias("version"),
        F.sha2(v.cast("string"), 256).alias("document_hash"))


def label_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per label: the mean vector of the label, asked by customer `label`."""
    v = table(spark, sf, "embeddings").select("label", F.posexplode("embedding"))
    means = v.groupBy("label", "pos").agg(
        F.round(F.avg(F.col("col").cast("double")), 6).alias("x"))
    vectors = means.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return vectors.select(
        F.concat(F.lit("q"), "label").alias("request_id"),
        F.col("label").cast("string").alias("user_id"),
        F.concat(F.lit("label "), "label").alias("query"),
        F.lit(5).alias("top_k"),
        F.col("p.x").alias("query_vector"))


def turn_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a request; every tenth conversation has no known user."""
    conv, turn = F.col("conv_id"), F.col("turn")
    user = F.when(conv % 10 == 9, F.concat(F.lit("guest-"), conv)).otherwise(
        ((conv * 37 + turn * 11) % 150).cast("string"))
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", conv, turn).alias("request_id"), user.alias("user_id"),
        F.col("text").alias("query"), F.lit(3).alias("top_k"))


def fact_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One question per document: about its incident, about any, or about none on file."""
    d = F.col("doc_id")
    subject = F.concat(F.upper("source"), F.lit(" OUTAGE "), d % 40)
    query = (F.when(d % 5 == 3, F.lit("Who was the incident commander?"))
             .when(d % 5 == 4, F.concat(F.lit("Incident commander of  NOTHING "), d,
                                        F.lit(" ?")))
             .otherwise(F.concat(F.lit("Who  was the Incident commander of "), subject,
                                 F.lit("?"))))
    user = F.when(d % 11 == 10, F.lit("nobody")).otherwise((d % 150).cast("string"))
    return table(spark, sf, "documents").select(
        d.cast("string").alias("request_id"), user.alias("user_id"), query.alias("query"),
        F.lit(3).alias("top_k"))
