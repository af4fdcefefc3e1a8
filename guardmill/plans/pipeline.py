"""Document catalogue to chunks, facts and sealed embeddings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardmill import fixed_values as fv
from guardmill.contracts import table_schema
from guardmill.operators import cache as cache_ops
from guardmill.operators import embedding
from guardmill.operators.chunking import chunk_documents, chunk_workset, silver_columns
from guardmill.operators.facts import facts_from_documents
from guardmill.operators.index import index_rows, upsert, upsert_stored
from guardmill.operators.scratch import settled
from guardmill.sources.io import Entry, read_entry, write_entry
from guardmill.sources.tables import read_or_none


@dataclass(frozen=True)
class EmbeddingSettings:
    """How vectors are made and sealed.

    `load_encoder` returns the encode function of a model; None selects hashed words.
    """

    key_id: str
    created_at: str
    model: str = embedding.HASHING_MODEL
    dim: int = fv.DEFAULT_DIM
    batch_size: int = fv.DEFAULT_BATCH
    normalize: bool = True
    load_encoder: Callable[[], embedding.Encode] | None = None
    partitions: int | None = None

    def vectors(self, df: DataFrame, text_column: str) -> DataFrame:
        if self.load_encoder is None:
            return embedding.hashed_vectors(df, text_column, self.dim)
        return embedding.encoded_vectors(df, text_column, self.load_encoder, self.dim,
                                         self.batch_size, self.normalize)


def bronze_documents(metadata: DataFrame, ingested_at: str) -> DataFrame:
    """Contract columns and types; values that do not convert become null."""
    columns = []
    for field in table_schema("bronze_documents"):
        if field.name == "ingestion_timestamp":
            value = F.lit(ingested_at)
        elif field.name in metadata.columns:
            value = F.col(field.name).try_cast(field.dataType)
        else:
            raise ValueError(f"the catalogue has no column {field.name!r}")
        columns.append(value.alias(field.name))
    return metadata.select(*columns)


def silver_chunks(bronze_with_text: DataFrame, size: int = fv.DEFAULT_CHUNK_SIZE,
                  overlap: int = fv.DEFAULT_OVERLAP) -> DataFrame:
    """Chunk rows to store: no text, no shuffle."""
    return silver_columns(chunk_workset(bronze_with_text, size, overlap))


def document_facts(bronze_with_text: DataFrame, created_at: str,
                   size: int = fv.DEFAULT_CHUNK_SIZE,
                   overlap: int = fv.DEFAULT_OVERLAP) -> DataFrame:
    return facts_from_documents(bronze_with_text, created_at, size, overlap)


def fresh_embeddings(chunks: DataFrame, keys: DataFrame,
                     settings: EmbeddingSettings) -> DataFrame:
    """Gold rows for chunks that carry text and a span."""
    embeddable = chunks.filter(F.col("chunk_span").isNotNull())
    if settings.partitions:
        # by chunk, not by document: one long document must not fill one task
        embeddable = embeddable.repartition(settings.partitions, "chunk_id")
    return embedding.sealed_rows(settings.vectors(embeddable, "chunk_text"), keys,
                                 settings.key_id, settings.model, settings.dim,
                                 settings.created_at)


def build_embeddings(chunks: DataFrame, keys: DataFrame, settings: EmbeddingSettings,
                     reader: Entry | None = None, writer: Entry | None = None,
                     spans: DataFrame | None = None) -> DataFrame:
    """Gold rows for all chunks; only those not in the cache are encoded.

    `spans`, the same chunks without their text, saves building the texts of the hits, and
    where all are hits any text: the misses are then found by their keys first.

    Fresh rows are appended to the cache first and gold is then read from the cache, so
    both tables hold the same bytes whatever is recomputed later. The step may be repeated:
    rows already cached are hits the second time.
    """
    spark = chunks.sparkSession
    embeddable = chunks.filter(F.col("chunk_span").isNotNull())
    if reader is None or writer is None:
        return fresh_embeddings(embeddable, keys, settings)

    def usable() -> DataFrame | None:
        stored = read_or_none(spark, schema=table_schema("embed_cache"), **reader.options)
        return None if stored is None else cache_ops.reusable(
            stored, settings.model, settings.dim, settings.key_id)

    cached = usable()
    if spans is None or cached is None:
        _, misses = cache_ops.split(embeddable, cached)
    else:
        wanted = spans.filter(F.col("chunk_span").isNotNull()).select(*cache_ops.KEY).distinct()
        missing = settled(cache_ops.split(wanted, cached)[1])
        # a key that holds a null meets no cached row, nor would it meet itself here
        whole = F.lit(True)
        for name in cache_ops.KEY:
            whole = whole & F.col(name).isNotNull()
        if missing.isEmpty():
            misses = None
        elif missing.filter(~whole).isEmpty():
            misses = embeddable.join(missing, list(cache_ops.KEY), "left_semi")
        else:
            _, misses = cache_ops.split(embeddable, cached)
    if misses is not None:
        write_entry(cache_ops.cache_rows(fresh_embeddings(misses, keys, settings)), writer)
    known = embeddable.drop("chunk_text") if spans is None else spans
    hits, _ = cache_ops.split(known, usable())
    return cache_ops.gold_from_hits(hits, settings.key_id, settings.created_at)


def build_index(gold: DataFrame, keys: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Candidate index after upserting all decodable gold rows.

    The vectors are packed float32 with their safe metadata; no ciphertext, nonce or key id.
    """
    opened = embedding.open_vectors(embedding.decodable(gold), keys, strict=True)
    return upsert(index, index_rows(opened))


def sync_index(gold: DataFrame, keys: DataFrame, folder: str) -> list[int]:
    """Upserts all decodable gold rows into the index stored below `folder`, in place."""
    opened = embedding.open_vectors(embedding.decodable(gold), keys, strict=True)
    return upsert_stored(index_rows(opened), folder)


def write_gold_by_class(gold: DataFrame, path: str) -> None:
    """Gold in one folder per classification, so that permission prunes files. Rows are
    spread within a class: a class that most rows have is many files. Rows without a class,
    which nobody may read, lie in a folder of their own."""
    gold.write.mode("overwrite").partitionBy("classification").parquet(path)


def read_gold_by_class(spark, path: str) -> DataFrame:
    """The stored gold with the contract's columns in their order."""
    schema = table_schema("gold_embeddings")
    return spark.read.schema(schema).parquet(path).select(*schema.names)


Watch = Callable[[str, DataFrame], DataFrame]


def _unwatched(dataset_id: str, df: DataFrame) -> DataFrame:
    return df


def run_gold(bronze_with_text: DataFrame, keys: DataFrame, settings: EmbeddingSettings,
             readers: dict[str, Entry], writers: dict[str, Entry], facts_path: str,
             size: int = fv.DEFAULT_CHUNK_SIZE, overlap: int = fv.DEFAULT_OVERLAP,
             watch: Watch = _unwatched) -> None:
    """Writes silver chunks, facts and gold embeddings from one workset.

    The workset holds plain text, so it is recomputed from the documents per output instead
    of being stored: cutting words is cheaper than spilling every text once more. `watch` may
    put observations on the silver and gold rows that are written.
    """
    workset = chunk_workset(bronze_with_text, size, overlap)
    write_entry(watch("silver_chunks", silver_columns(workset)), writers["silver_chunks"])
    facts = document_facts(bronze_with_text, settings.created_at, size, overlap)
    facts.select(*sorted(facts.columns)).write.mode("overwrite").json(facts_path)
    spans = chunk_documents(bronze_with_text, size, overlap, with_text=False)
    gold = build_embeddings(workset, keys, settings, readers.get("embed_cache"),
                            writers.get("embed_cache"), spans)
    write_entry(watch("gold_embeddings", gold), writers["gold_embeddings"])


def run_silver(bronze_with_text: DataFrame, writers: dict[str, Entry],
               size: int = fv.DEFAULT_CHUNK_SIZE, overlap: int = fv.DEFAULT_OVERLAP) -> None:
    write_entry(silver_chunks(bronze_with_text, size, overlap), writers["silver_chunks"])


def run_bronze(spark, readers: dict[str, Entry], writers: dict[str, Entry],
               ingested_at: str, watch: Watch = _unwatched) -> None:
    raw = read_entry(spark, readers["metadata_documents"])
    write_entry(watch("bronze_documents", bronze_documents(raw, ingested_at)),
                writers["bronze_documents"])
