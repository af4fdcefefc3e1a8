"""Column expressions that several operators share. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
#: Hash values are whole numbers in [0, 2^60): 15 hexadecimal digits of an MD5.
HASH_BITS = 60


def document_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def word_list(text: Column) -> Column:
    """The maximal runs of anything but ASCII white space, in order."""
    flat = F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, counted without building them.

    A word starts where a non-blank character follows a blank, so the words are the runs
    left after every run of blanks has become one blank.
    """
    single = F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "))
    gaps = F.octet_length(single) - F.octet_length(F.translate(single, " ", ""))
    return F.when(F.octet_length(single) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


def hash60(*parts: Column) -> Column:
    """A uniform whole number in [0, 2^60) that any SQL engine can repeat."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def hash_range(hashed: Column, parts: int) -> Column:
    """Which of `parts` equal ranges of [0, 2^60) the hash lies in; keeps the order."""
    high = F.shiftright(hashed, 30) * F.lit(parts)
    return F.shiftright(high, 30).cast("int")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or one made from it, that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
