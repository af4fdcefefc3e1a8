"""Authenticated encryption as column expressions (AES-256-GCM).

Keys arrive as a column of a joined key table, never as literals: a literal key would be
printed in query plans and event logs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONCE_BYTES = 12


def _nonce(key: Column, context: Column, plain: Column) -> Column:
    # Derived from key, context and content: a retried task writes the same bytes, and a
    # nonce can only repeat for the same message.
    seed = F.concat(key, F.encode(F.coalesce(context, F.lit("")), "UTF-8"), plain)
    return F.unhex(F.substring(F.sha2(seed, 256), 1, 2 * _NONCE_BYTES))


def seal(plain: Column, key: Column, context: Column) -> Column:
    """nonce || ciphertext || tag, null when the plain value or the key is null."""
    sealed = F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"),
                           _nonce(key, context, plain))
    return F.when(plain.isNotNull() & key.isNotNull(), sealed)


def nonce_of(sealed: Column) -> Column:
    return F.substring(sealed, 1, _NONCE_BYTES)


def body_of(sealed: Column) -> Column:
    return F.substring(sealed, _NONCE_BYTES + 1, 2**31 - 1 - _NONCE_BYTES)


def open_sealed(body: Column, nonce: Column, key: Column) -> Column:
    """Plain bytes, or null for a wrong key, a changed byte or a missing part."""
    return F.try_aes_decrypt(F.concat(nonce, body), key, F.lit("GCM"))


def open_strict(body: Column, nonce: Column, key: Column) -> Column:
    """Plain bytes; a wrong key or a changed byte fails the query."""
    return F.aes_decrypt(F.concat(nonce, body), key, F.lit("GCM"))
