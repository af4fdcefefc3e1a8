"""Chunk texts to sealed embedding rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardmill import fixed_values as fv
from guardmill.contracts import table_schema
from guardmill.functions import crypto, text, vectors
from guardmill.operators.joins import lookup_join

Encode = Callable[[list[str]], np.ndarray]

HASHING_MODEL = "hashed-words"


def hashed_vectors(df: DataFrame, text_column: str, dim: int = fv.DEFAULT_DIM,
                   output: str = "vector") -> DataFrame:
    """Adds the packed unit vector of hashed word counts."""
    cleaned = text.drop_control_characters(F.col(text_column))
    return df.withColumn(output, _once(vectors.hashed_words(dim))(cleaned))


def encoded_vectors(df: DataFrame, text_column: str, load_encoder: Callable[[], Encode],
                    dim: int, batch_size: int = fv.DEFAULT_BATCH, normalize: bool = True,
                    output: str = "vector") -> DataFrame:
    """Adds packed vectors of a user-supplied encoder.

    `load_encoder` runs once per task; texts reach the encoder `batch_size` at a time, so
    memory does not depend on the partition size.
    """
    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load_encoder()
        for texts in batches:
            packed: list[bytes] = []
            for start in range(0, len(texts), batch_size):
                part = pc.fill_null(texts.slice(start, batch_size), "").to_pylist()
                matrix = np.asarray(encoder(part))
                if matrix.shape != (len(part), dim):
                    raise ValueError(f"encoder returned shape {matrix.shape}, "
                                     f"expected {(len(part), dim)}")
                rows = vectors.unit_rows(matrix) if normalize else matrix.astype("<f4")
                packed.extend(row.tobytes() for row in rows)
            yield pa.array(packed, pa.binary())

    return df.withColumn(output, _once(encode)(F.col(text_column)))


def _once(udf):
    """Keeps the optimizer from moving a costly function below the joins that thin its input.

    A filter on the result would otherwise be pushed through the anti join that removes
    cached chunks, and with it the encoding of all chunks.
    """
    return udf.asNondeterministic()


def sealed_rows(vector_rows: DataFrame, keys: DataFrame, key_id: str, model: str, dim: int,
                created_at: str) -> DataFrame:
    """Gold rows: vectors sealed under `key_id` of the key table (key_id, key binary)."""
    sealed = vector_rows.withColumn("__key", active_key(keys, key_id)).withColumn(
        "__sealed", crypto.seal(F.col("vector"), F.col("__key"),
                                F.concat_ws("|", "chunk_id", "document_hash")))
    stamps = {
        "embedding_id": embedding_key(created_at),
        "embedding_ciphertext": crypto.body_of(F.col("__sealed")),
        "embedding_nonce": crypto.nonce_of(F.col("__sealed")),
        "embedding_algorithm": F.lit(fv.ENCRYPTION_ALGORITHM),
        "embedding_dim": F.lit(dim),
        "embedding_dtype": F.lit(fv.EMBEDDING_DTYPE),
        "embedding_model": F.lit(model),
        "key_id": F.lit(key_id),
        "created_at": F.lit(created_at),
    }
    return conform(sealed, stamps)


def active_key(keys: DataFrame, key_id: str) -> Column:
    """The one key of that id as a scalar subquery: no join, no key in the plan text.

    Null when there is none; two keys of one id fail the query.
    """
    return keys.filter(F.col("key_id") == key_id).select("key").scalar()


def embedding_key(created_at: str):
    """An id per row that a retried task repeats."""
    return text.name_uuid(F.concat_ws("|", F.lit("embedding"), "chunk_id", "document_hash",
                                      F.lit(created_at)))


def conform(df: DataFrame, values: dict, table: str = "gold_embeddings") -> DataFrame:
    """Contract columns: given values, else the column of that name, else null."""
    columns = []
    for field in table_schema(table):
        value = values.get(field.name)
        if value is None:
            value = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def open_vectors(gold: DataFrame, keys: DataFrame, output: str = "vector",
                 strict: bool = False) -> DataFrame:
    """Adds the decrypted vector bytes, null where a row cannot be opened.

    Filter `gold` by permission before the call: the key arrives by a join placed after
    that filter, and decryption needs the key column, so it cannot be moved below it.
    """
    keyed = lookup_join(gold, keys.select("key_id", "key"), ["key_id"], "left")
    opener = crypto.open_strict if strict else crypto.open_sealed
    opened = opener(F.col("embedding_ciphertext"), F.col("embedding_nonce"), F.col("key"))
    return keyed.withColumn(output, opened).drop("key")


def decodable(gold: DataFrame) -> DataFrame:
    """Rows that carry ciphertext, nonce and dimension."""
    return gold.dropna(subset=["embedding_ciphertext", "embedding_nonce", "embedding_dim"])


def seal_text_fields(chunks: DataFrame, keys: DataFrame, key_id: str,
                     fields: Sequence[str] = ("chunk_text",)) -> DataFrame:
    """Replaces text fields of chunks flagged `requires_encryption` by base64 ciphertext.

    Adds `<field>_is_encrypted`, true on replaced values and null elsewhere.
    """
    keyed = chunks.withColumn("__key", active_key(keys, key_id))
    flagged = F.coalesce("requires_encryption", F.lit(False))
    for name in fields:
        seal_it = flagged & F.col(name).isNotNull()
        sealed = F.base64(crypto.seal(F.encode(F.col(name), "UTF-8"), F.col("__key"),
                                      F.concat_ws("|", "chunk_id", F.lit(name))))
        keyed = (keyed.withColumn(f"{name}_is_encrypted", F.when(seal_it, F.lit(True)))
                 .withColumn(name, F.when(seal_it, sealed).otherwise(F.col(name))))
    return keyed.drop("__key")


def open_text_fields(chunks: DataFrame, keys: DataFrame, key_id: str,
                     fields: Sequence[str] = ("chunk_text",)) -> DataFrame:
    """Undoes `seal_text_fields`; a value that cannot be opened becomes null."""
    keyed = chunks.withColumn("__key", active_key(keys, key_id))
    for name in fields:
        sealed = F.unbase64(F.col(name))
        plain = crypto.open_sealed(crypto.body_of(sealed), crypto.nonce_of(sealed),
                                   F.col("__key")).cast("string")
        keyed = keyed.withColumn(name, F.when(F.col(f"{name}_is_encrypted"), plain)
                                 .otherwise(F.col(name)))
    return keyed.drop("__key")
