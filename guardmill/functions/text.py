"""Text cleaning, word windows and stable ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardmill import fixed_values as fv

# A blank run is matched possessively and only from its first character, so a document made
# of one long run of blanks still costs one pass.
_LINE_END_BLANKS = r"[ \t](?<![ \t][ \t])[ \t]*+\n"
_BLANK_LINES = r"\n{3,}"
_BLANKS = r"(?U)\s+"


def drop_control_characters(text: Column) -> Column:
    return F.regexp_replace(text, fv.UNWANTED_CHARACTERS, "")


def strip_ends(text: Column) -> Column:
    """Unicode-aware strip; plain `trim` only knows U+0020."""
    return F.btrim(text, F.lit(fv.WHITE_SPACE))


def tidy_white_space(text: Column) -> Column:
    text = F.regexp_replace(text, _LINE_END_BLANKS, "\n")
    return strip_ends(F.regexp_replace(text, _BLANK_LINES, "\n\n"))


def clean(text: Column) -> Column:
    return tidy_white_space(drop_control_characters(text))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def words(text: Column) -> Column:
    """Words of the cleaned text.

    Tidying only rewrites white space between words, so dropping unwanted characters is
    enough to get the same list. It also drops the control characters in which Java's and
    Python's ideas of white space differ.
    """
    bare = drop_control_characters(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(bare, _BLANKS), "")


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("chunk overlap must lie in [0, size)")


def word_windows(word_list: Column, size: int, overlap: int,
                 with_text: bool = True) -> Column:
    """array<struct<index, start, end, text>> of overlapping windows; text only on demand.

    Pass a materialised column, not an expression: the lambda reads it once per window.
    """
    check_window(size, overlap)
    n = F.size(word_list)

    def window(start: Column, index: Column) -> Column:
        span = [index.cast("int").alias("index"), start.cast("int").alias("start"),
                F.least(start + size, n).cast("int").alias("end")]
        if with_text:
            words = F.slice(word_list, start + 1, F.lit(size))
            span.append(F.array_join(words, " ").alias("text"))
        return F.struct(*span)

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, window)


def name_uuid(key: Column) -> Column:
    """Version-5 UUID of `key` in the URL name-space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(fv.UUID_URL_NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12))


def chunk_key(document_id: Column, document_hash: Column, index: Column) -> Column:
    return name_uuid(F.concat_ws(":", document_id, document_hash, index.cast("string")))
