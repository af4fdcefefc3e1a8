"""Document texts from a folder of raw files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardmill.functions.text import unix_newlines
from guardmill.operators.joins import hot_keys, salted, spread_join
from guardmill.operators.scratch import settled
from guardmill.sources import files as direct

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?")
#: File names by which Spark's readers decompress.
_CODED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"
_SALT = "__salt"


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, relative_path, file_name of every file below `folder`; reads no content.

    Listed by tasks where they can open the folder, else by Spark's readers on the driver.
    """
    root = direct.open_root(spark, folder)
    if root is None:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", pattern).load(folder).select("path"))
    else:
        glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        files = direct.listed(spark, root).filter(F.rlike(
            F.substring_index("path", "/", -1), F.lit(f"(?s)\\A(?:{glob})\\z")))
    return files.select(
        "path", relative_path(F.col("path"), folder).alias("relative_path"),
        F.substring_index("path", "/", -1).alias("file_name"))


def relative_path(path: Column, folder: str) -> Column:
    """A listed path below `folder`."""
    # listing and folder may write scheme and host differently, or only one of them at all
    base = _SCHEME.sub("", folder).rstrip("/") + "/"
    return F.substring(path, F.instr(path, base) + F.lit(len(base)), F.length(path))


def file_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, text of every file below `folder`, with `\\n` line ends."""
    whole = (spark.read.option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).text(folder, wholetext=True))
    # the metadata column is percent-encoded, the listing is not; a plus is just a plus
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return whole.select(F.url_decode(encoded).alias("path"),
                        unix_newlines(F.col("value")).alias("text"))


def with_document_text(docs: DataFrame, folder: str, output: str = "text") -> DataFrame:
    """Adds the file text of `source_path`: exact relative path, else by file name.

    Several files of one name resolve to the smallest path; no file gives ''. Paths are
    matched on listings first. Where tasks can open the folder, rows are dealt out by path
    and a task reads its files, so no text is moved; else texts move once, to the rows that
    need them. A file that many rows share is salted.
    """
    spark = docs.sparkSession
    listing = settled(list_files(spark, folder))  # a folder is listed once
    exact = listing.select(F.col("relative_path").alias("source_path"),
                           F.col("path").alias("exact_path"))
    by_name = (listing.groupBy("file_name").agg(F.min("path").alias("named_path")))
    located = settled(docs.withColumn("file_name", F.substring_index("source_path", "/", -1))
                      .join(exact, "source_path", "left").join(by_name, "file_name", "left")
                      .withColumn("path", F.coalesce("exact_path", "named_path"))
                      .drop("exact_path", "named_path", "file_name"))
    hot = hot_keys(located.select("path").filter(F.col("path").isNotNull()), ["path"])
    if direct.open_root(spark, folder) and listing.filter(
            F.rlike(F.lower("file_name"), F.lit(_CODED))).isEmpty():
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = (salted(located, ["path"], hot, _SALT).repartition(parts, "path", _SALT)
                 .sortWithinPartitions("path").drop(_SALT))
        read = unix_newlines(direct.file_contents(F.col("path")).cast("string"))
        return dealt.withColumn(output, F.coalesce(read, F.lit(""))).drop("path")
    texts = file_texts(spark, folder).withColumnRenamed("text", output)
    joined = spread_join(located, texts, ["path"], "left", hot)
    return joined.withColumn(output, F.coalesce(output, F.lit(""))).drop("path")


def catalogue_coverage(docs: DataFrame, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Counts before ingestion: files, rows, rows without a file, files without a row."""
    files = list_files(docs.sparkSession, folder, pattern).select("file_name").distinct()
    rows = docs.select(F.substring_index("source_path", "/", -1).alias("file_name"))
    marked = (files.withColumn("file", F.lit(1)).join(
        rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("rows")), "file_name", "full"))
    n_rows = F.coalesce("rows", F.lit(0))
    return marked.agg(
        F.count("file").alias("files"),
        F.coalesce(F.sum(n_rows), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.when(F.col("file").isNull(), n_rows)), F.lit(0)).alias(
            "documents_without_file"),
        F.count_if(n_rows == 0).alias("files_without_document"))


def require_inputs(spark: SparkSession, folder: str, pattern: str = "*.txt") -> None:
    """Fails when the folder is absent or holds no source file."""
    if list_files(spark, folder, pattern).isEmpty():
        raise FileNotFoundError(f"no {pattern} files below {folder}")
