"""Exact deduplication as a streaming job with keyed state on disk."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardmill.operators.joins import spread_join
from guardmill.operators.scratch import scratch_path, settled

from .columns import document_text, free_name, need_columns

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory that the state stores of an executor share.
STATE_MB = "96"
#: Arrived rows that one state store takes in, so that stores follow the rows.
STORE_ROWS = 65_536
#: A digest is hot when its group holds more than this share of the rows.
HOT_SHARE = 0.001


@contextmanager
def _settings(spark: SparkSession, **values: str):
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def arrivals(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """What the stream sees of a document: id, digest, bytes and where its content lies."""
    need_columns(docs, identity, text)
    body = document_text(text)
    return docs.select(
        F.col(identity).alias("id"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        _locator(docs).alias("locator"))


def _locator(docs: DataFrame) -> Column:
    """File and row of the content, or nulls where the rows don't come from files."""
    if not _has_place(docs):
        return F.struct(F.lit(None).cast("string").alias("file"),
                        F.lit(None).cast("long").alias("row"))
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.row_index").alias("row"))


def _stores(spark: SparkSession, n_rows: int) -> int:
    """How many state stores so many rows need: one per core at least, whatever a shuffle has.

    Each store writes files of its own in every batch. To a local disk Hadoop writes a file
    with the help of child processes (chmod), and while one starts, a sum over processes
    counts the executor's memory twice.
    """
    return max(spark.sparkContext.defaultParallelism, -(-n_rows // STORE_ROWS))


def keep_state(stream: DataFrame, path: str, stores: int | None = None) -> DataFrame:
    """Runs the stream of `arrivals` to its present end; digest, keeper, group_size, n_bytes.

    The state has one row per digest and no expiry: the digest, the id and locator of the
    row to keep (the largest id) and the number of rows seen. It is held in RocksDB on the
    executors' disks and saved under `path` after every micro-batch, so a lost executor's
    part is loaded again. Started anew with the same `path`, the job goes on with what
    arrived since. Rows with equal digests meet as partial aggregates, one per task. The
    state lies in `stores` parts, as many as a shuffle has where none are given; a job that
    goes on keeps the number it began with.
    """
    spark = stream.sparkSession
    parts = {"spark.sql.shuffle.partitions": str(stores)} if stores else {}
    seen = stream.groupBy("digest").agg(
        F.max(F.struct("id", "locator")).alias("keeper"),
        F.count(F.lit(1)).alias("group_size"), F.max("n_bytes").alias("n_bytes"))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changed/batch={batch_id}")

    with _settings(spark, **parts, **{
            "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            # many small stores: no megabytes set aside for each one's logs, one bound on the
            # memory of all of an executor's, and closed soon after the job
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": STATE_MB,
            "spark.sql.streaming.stateStore.maintenanceInterval": "10s"}):
        query = (seen.writeStream.outputMode("update").foreachBatch(store)
                 .option("checkpointLocation", f"{path}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    schema = seen.schema.add("batch", "long")
    # ids and counts of a digest only grow from batch to batch
    return (spark.read.schema(schema).parquet(f"{path}/changed").groupBy("digest").agg(
        F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"),
        F.max("n_bytes").alias("n_bytes")))


def dedup_documents(docs: DataFrame, identity: str = "doc_id", text: str = "text",
                    files_per_batch: int = 1000) -> DataFrame:
    """One row per document: identity, keep_id, group_size, kept, text_sha256, locator.

    Of equal texts the row with the largest id stays. A null text equals the empty one. Null
    ids are smaller than all others. Of rows equal in id and text only the one that lies
    last (file, then row) stays; where rows have no place in a file, all of them stay. Other
    columns are not read. Empty tables give no rows. Equality is that of bytes: the digest
    finds the groups, and `check_bytes` compares the contents of every group with more than
    one row.

    The narrow arrivals are landed once and streamed. Only rows whose digest was seen more
    than once move their text, spread over many tasks where a digest is hot.
    """
    spark = docs.sparkSession
    landed = scratch_path(spark, "arrivals")
    arrivals(docs, identity, text).write.parquet(landed)
    rows = spark.read.parquet(landed)
    stream = (spark.readStream.schema(rows.schema)
              .option("maxFilesPerTrigger", files_per_batch).parquet(landed))
    groups = settled(keep_state(stream, scratch_path(spark, "dedup"),
                                _stores(spark, rows.count())))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # never more than 1 / HOT_SHARE digests
    hot = groups.filter(F.col("group_size") > max(1.0, total * HOT_SHARE)).select("digest")
    check_bytes(docs, groups.filter("group_size > 1"), hot, text)
    judged = spread_join(rows, groups.drop("n_bytes"), ["digest"], "inner", hot)
    return judged.select(
        F.col("id").alias(identity), F.col("keeper")["id"].alias("keep_id"), "group_size",
        F.struct("id", "locator").eqNullSafe(F.col("keeper")).alias("kept"),
        F.col("digest").alias("text_sha256"), "locator")


def check_bytes(docs: DataFrame, groups: DataFrame, hot: DataFrame, text: str) -> None:
    """Raises if two texts of one digest differ in any byte.

    The least and the greatest text of a group are equal iff all are. Both are found per
    task before anything is shuffled a second time.
    """
    body = document_text(text).cast("binary")
    contents = docs.select(F.sha2(body, 256).alias("digest"), body.alias("content"))
    hits = spread_join(contents, groups.select("digest"), ["digest"], "inner", hot)
    unequal = hits.groupBy("digest").agg(
        F.min("content").alias("least"), F.max("content").alias("greatest")).filter(
        F.col("least") != F.col("greatest"))
    if unequal.select("digest").head(1):
        raise ValueError("different texts share a SHA-256 digest")


def kept_documents(docs: DataFrame, identity: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns, whatever these are called.

    One row per different text, a null one being empty; an empty table stays empty. Of rows
    equal in id and text one stays where rows have a place in a file, else all.
    """
    verdict = dedup_documents(docs, identity, text)
    file, row = free_name(docs, "__file"), free_name(docs, "__row")
    key, sha = free_name(docs, "__id"), free_name(docs, "__sha")
    if _has_place(docs):
        place = verdict.filter("kept").select(
            F.col("locator.file").alias(file), F.col("locator.row").alias(row))
        placed = docs.select("*", F.col("_metadata.file_path").alias(file),
                             F.col("_metadata.row_index").alias(row))
        return placed.join(place, [file, row], "left_semi").select(docs.columns)
    keep = verdict.filter("kept").select(F.col(identity).alias(key),
                                         F.col("text_sha256").alias(sha)).distinct()
    digest = F.sha2(document_text(text).cast("binary"), 256)
    return docs.join(keep, docs[identity].eqNullSafe(F.col(key))
                     & (digest == F.col(sha)), "left_semi")


def _has_place(docs: DataFrame) -> bool:
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True
