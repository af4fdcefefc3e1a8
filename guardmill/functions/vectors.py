"""Vector packing, cosine similarity and the default text encoder.

The Python functions work on whole Arrow arrays: list and binary buffers are reshaped, not
converted row by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELLS = 4_000_000


def _binaries(payload: bytes, lengths: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Binary array of consecutive pieces of `payload`, null where `missing`."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    valid = pa.array(~missing).buffers()[1] if missing.any() else None
    return pa.Array.from_buffers(pa.binary(), len(lengths),
                                 [valid, pa.py_buffer(offsets), pa.py_buffer(payload)])


def _missing(array: pa.Array) -> np.ndarray:
    return array.is_null().to_numpy(zero_copy_only=False)


@F.arrow_udf(T.BinaryType())
def pack_f32(vectors: pa.Array) -> pa.Array:
    """array<float> -> N*4 little-endian bytes."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    return _binaries(flat.tobytes(), lengths.astype(np.int64) * 4, _missing(vectors))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _floats(payload: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.binary_length(payload), 0).to_numpy(zero_copy_only=False) // 4
    flat = np.frombuffer(b"".join(payload.drop_null().to_pylist()), dtype="<f4")
    offsets = np.zeros(len(payload) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float32()),
                                    mask=pa.array(_missing(payload)))


def unpack_f32(payload: Column, dim: Column) -> Column:
    """Bytes -> array<float>; raises when the byte length disagrees with `dim`."""
    wrong = F.raise_error(F.concat(
        F.lit("vector payload has "), F.octet_length(payload).cast("string"),
        F.lit(" bytes, expected 4 x "), dim.cast("string")))
    checked = F.when(payload.isNull() | (F.octet_length(payload) == dim * 4), payload)
    return _floats(checked.otherwise(wrong.cast("binary")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 when either has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def word_bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % dim


def word_buckets(words: pa.Array, dim: int) -> np.ndarray:
    """`word_bucket` of every word, -1 for empty ones.

    A batch has many distinct words, so Arrow lowers those of ASCII characters and hands over
    the bytes; only the hash itself is a Python call per word.
    """
    raw = pc.ascii_lower(words).cast(pa.binary()).to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
    for i, word in zip(other, words.take(pa.array(other)).to_pylist(), strict=True):
        raw[i] = word.lower().encode()
    md5 = hashlib.md5
    heads = b"".join([md5(word).digest()[:4] for word in raw])
    # the first eight hexadecimal digits of the hash
    bucket = (np.frombuffer(heads, dtype=">u4") % dim).astype(np.int64)
    bucket[pc.binary_length(words).to_numpy(zero_copy_only=False) == 0] = -1
    return bucket


def hashed_words(dim: int):
    """Arrow UDF: cleaned text -> packed unit vector of hashed word counts.

    Only the distinct words of a batch are hashed; counting is one `bincount` per slice.
    """
    @F.arrow_udf(T.BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        rows_per_slice = max(1, _CELLS // dim)
        parts = [_word_vectors(texts.slice(start, rows_per_slice), dim)
                 for start in range(0, len(texts), rows_per_slice)]
        payload = b"".join(part.tobytes() for part in parts)
        return _binaries(payload, np.full(len(texts), 4 * dim), np.zeros(len(texts), bool))
    return encode


def _word_vectors(texts: pa.Array, dim: int) -> np.ndarray:
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = split.flatten().dictionary_encode()
    # the ends of a text may give empty pieces, which are not words
    bucket = word_buckets(words.dictionary, dim)
    row = np.repeat(np.arange(len(texts)), lengths)
    of_word = bucket[words.indices.to_numpy(zero_copy_only=False)] if len(words) else row
    used = of_word >= 0
    counts = np.bincount(row[used] * dim + of_word[used], minlength=len(texts) * dim)
    return unit_rows(counts.reshape(len(texts), dim))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (zero rows stay zero) as little-endian float32."""
    wide = np.asarray(matrix, dtype=np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True))
    return (wide / np.where(norms == 0, 1.0, norms)).astype("<f4")
