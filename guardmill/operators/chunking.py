"""Documents to overlapping word chunks with sensitivity annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import table_schema
from guardmill.functions import sensitivity, text
from guardmill.functions.rows import exploded

INHERITED = ("classification", "allowed_roles", "owner", "department", "version",
             "source_path", "document_hash")


def _inherited(docs: DataFrame) -> list:
    """Governance columns; a table without them is public with empty values.

    A null classification stays null, which no policy admits.
    """
    defaults = {"classification": F.lit("public"),
                "allowed_roles": F.array().cast("array<string>")}
    columns = []
    for name in INHERITED:
        if name not in docs.columns:
            columns.append(defaults.get(name, F.lit("")).alias(name))
        elif name == "allowed_roles":
            roles = F.col(name)
            if docs.schema[name].dataType.typeName() == "string":
                roles = F.when(roles.isNotNull(), F.array(roles))
            columns.append(F.coalesce(roles, defaults[name]).alias(name))
        else:
            columns.append(F.col(name).cast("string").alias(name))
    return columns


def document_windows(docs: DataFrame, size: int, overlap: int, text_column: str = "text",
                     with_text: bool = True) -> DataFrame:
    """One row per document with `windows`, the array of its chunks."""
    text.check_window(size, overlap)
    split = docs.select(
        F.col("document_id").cast("string").alias("document_id"), *_inherited(docs),
        text.words(F.col(text_column)).alias("__words"))
    return split.select(
        "document_id", *INHERITED,
        text.word_windows(F.col("__words"), size, overlap, with_text).alias("windows"))


def chunk_documents(docs: DataFrame, size: int = fv.DEFAULT_CHUNK_SIZE,
                    overlap: int = fv.DEFAULT_OVERLAP, text_column: str = "text",
                    with_text: bool = True) -> DataFrame:
    """One row per chunk, with the transient `chunk_text` unless only spans are wanted; no
    shuffle.

    The window texts are built inside the row and exploded, so a generated row carries its
    own window and not the whole word list of the document.
    """
    windows = document_windows(docs, size, overlap, text_column, with_text)
    chunks = exploded(windows, "windows", "w", "document_id", *INHERITED)
    return chunks.select(
        text.chunk_key(F.col("document_id"), F.coalesce("document_hash", F.lit("None")),
                       F.col("w.index")).alias("chunk_id"),
        "document_id",
        F.col("w.index").alias("chunk_index"),
        F.struct("w.start", "w.end").alias("chunk_span"),
        *INHERITED,
        *([F.col("w.text").alias("chunk_text")] if with_text else []))


def score_sensitivity(chunks: DataFrame) -> DataFrame:
    """Adds score, detected types and the two threshold flags."""
    scanned = (chunks
               .withColumn("__lower", F.lower(F.coalesce("chunk_text", F.lit(""))))
               .withColumn("__hits", sensitivity.keyword_hits(F.col("__lower"))))
    typed = scanned.withColumn(
        "detected_sensitive_types",
        sensitivity.detected_types(F.col("chunk_text"), F.col("__hits")))
    scored = typed.withColumn("__score", sensitivity.score(
        F.col("detected_sensitive_types"), F.col("classification")))
    return scored.select(
        *chunks.columns,
        F.col("__score").cast("float").alias("sensitivity_score"),
        "detected_sensitive_types",
        (F.col("__score") >= fv.ENCRYPTION_THRESHOLD).alias("requires_encryption"),
        (F.col("__score") >= fv.RESTRICTED_THRESHOLD).alias("requires_restricted_access"))


def chunk_workset(docs: DataFrame, size: int = fv.DEFAULT_CHUNK_SIZE,
                  overlap: int = fv.DEFAULT_OVERLAP, text_column: str = "text") -> DataFrame:
    """Silver columns plus `chunk_text`. Never write this: it holds plain text."""
    scored = score_sensitivity(chunk_documents(docs, size, overlap, text_column))
    return scored.select(*table_schema("silver_chunks").names, "chunk_text")


def silver_columns(workset: DataFrame) -> DataFrame:
    """The columns that may be stored."""
    return workset.select(*table_schema("silver_chunks").names)


def with_chunk_texts(chunks: DataFrame, docs: DataFrame,
                     text_column: str = "text") -> DataFrame:
    """Fills missing `chunk_text` from `chunk_span` and the documents' raw text.

    `docs` has one row per `source_path`. The distinct spans of a document travel to its
    text, so the word list is split once per document and never copied per chunk. A chunk
    without a span or without a document gets ''.
    """
    has_text = "chunk_text" in chunks.columns
    known = F.nullif(F.col("chunk_text"), F.lit("")) if has_text else F.lit(None)
    base = chunks.withColumn("chunk_text", known.cast("string"))
    start = F.coalesce(F.col("chunk_span.start"), F.lit(0)).alias("start")
    end = F.coalesce(F.col("chunk_span.end"), F.lit(0)).alias("end")

    wanted = (base.filter(F.col("chunk_text").isNull()).select("source_path", start, end)
              .distinct()
              .groupBy("source_path")
              .agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    split = docs.join(wanted, "source_path").select(
        "source_path", "spans", text.words(F.col(text_column)).alias("__words"))

    def span_text(span):
        length = F.greatest(span["end"] - span["start"], F.lit(0))
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.array_join(
            F.slice(F.col("__words"), span["start"] + 1, length), " ").alias("rebuilt"))

    rebuilt = (exploded(split, F.transform("spans", span_text), "t", "source_path")
               .select("source_path", "t.start", "t.end", "t.rebuilt"))
    joined = base.withColumn("start", start).withColumn("end", end).join(
        rebuilt, ["source_path", "start", "end"], "left")
    filled = F.coalesce("chunk_text", "rebuilt", F.lit("")).alias("chunk_text")
    return joined.select(*(filled if c == "chunk_text" else c for c in base.columns))
