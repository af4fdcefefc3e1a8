"""Incremental versions of the batch jobs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guardmill import fixed_values as fv
from guardmill.contracts import table_schema
from guardmill.functions.text import unix_newlines
from guardmill.operators.chunking import chunk_workset, silver_columns
from guardmill.operators.joins import fits
from guardmill.operators.scratch import settled
from guardmill.plans.pipeline import EmbeddingSettings, bronze_documents, build_embeddings
from guardmill.sources.io import Entry, read_or_none, read_source, write_sink
from guardmill.sources.texts import relative_path


def stream_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Arriving catalogue rows (JSON lines) in the bronze schema."""
    fields = [f for f in table_schema("bronze_documents")
              if f.name != "ingestion_timestamp"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return read_source(spark, stream=True, format="json", path=path, schema=ddl)


def stream_bronze(metadata: DataFrame, path: str, checkpoint: str, ingested_at: str,
                  trigger: dict | None = None) -> StreamingQuery:
    """Appends conformed catalogue rows as they arrive."""
    return write_sink(bronze_documents(metadata, ingested_at), stream=True,
                      format="parquet", path=path, checkpointLocation=checkpoint,
                      trigger=trigger or {"availableNow": True})


def stream_silver(documents: DataFrame, path: str, checkpoint: str,
                  size: int = fv.DEFAULT_CHUNK_SIZE, overlap: int = fv.DEFAULT_OVERLAP,
                  trigger: dict | None = None) -> StreamingQuery:
    """Chunks documents with text as they arrive; stateless, so nothing accumulates."""
    return write_sink(silver_columns(chunk_workset(documents, size, overlap)), stream=True,
                      format="parquet", path=path, checkpointLocation=checkpoint,
                      trigger=trigger or {"availableNow": True})


def stream_gold(documents: DataFrame, keys: DataFrame, settings: EmbeddingSettings,
                reader: Entry, writer: Entry, path: str, checkpoint: str,
                size: int = fv.DEFAULT_CHUNK_SIZE, overlap: int = fv.DEFAULT_OVERLAP,
                trigger: dict | None = None) -> StreamingQuery:
    """Embeds arriving documents batch by batch through the cache.

    Each micro-batch overwrites its own folder below `path`, named after the checkpoint and
    the batch, and chunks already cached are hits, so a batch replayed after a failure leaves
    the same rows and a job with another checkpoint leaves earlier output alone.
    """
    job = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def embed(batch: DataFrame, batch_id: int) -> None:
        gold = build_embeddings(chunk_workset(batch, size, overlap), keys, settings, reader,
                                writer)
        gold.write.mode("overwrite").parquet(f"{path}/job={job}/batch={batch_id}")

    return (documents.writeStream.foreachBatch(embed)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_raw_documents(spark: SparkSession, folder: str, catalogue: str, out: str,
                         checkpoint: str, size: int = fv.DEFAULT_CHUNK_SIZE,
                         overlap: int = fv.DEFAULT_OVERLAP, pattern: str = "*",
                         trigger: dict | None = None) -> StreamingQuery:
    """Chunks raw text files as they arrive below `folder`.

    Every micro-batch of files meets the catalogue (bronze rows stored at `catalogue`, read
    anew per batch) by source path. Silver rows go to `out`/chunks; files without a catalogue
    row are listed in `out`/unmatched, for `rerun_unmatched`. A batch overwrites its own
    folders, so one that is replayed after a failure leaves the same rows.
    """
    files = (spark.readStream.format("binaryFile").schema(_FILES)
             .option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
             .load(folder))
    job = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def chunk(batch: DataFrame, batch_id: int) -> None:
        _chunk_files(batch, folder, catalogue, out, f"job={job}/batch={batch_id}", size,
                     overlap)

    return (files.writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _chunk_files(files: DataFrame, folder: str, catalogue: str, out: str, place: str,
                 size: int, overlap: int) -> None:
    named = files.withColumn("source_path", relative_path(F.col("path"), folder))
    rows = read_or_none(files.sparkSession, format="parquet", path=catalogue,
                        schema=table_schema("bronze_documents"))
    if rows is None:
        rows = files.sparkSession.createDataFrame([], table_schema("bronze_documents"))
    # the batch's paths, read once without their content where the source allows it
    listed = settled(named.select("path", "source_path"))
    wanted = settled(rows.join(listed.select("source_path").distinct(), "source_path",
                               "left_semi"))
    text = unix_newlines(F.make_valid_utf8(F.col("content").cast("string")))
    met = named.select("source_path", text.alias("text")).join(
        _small(wanted), "source_path").select(*rows.columns, "text")
    silver = silver_columns(chunk_workset(met, size, overlap))
    silver.write.mode("overwrite").parquet(f"{out}/chunks/{place}")
    # a file's name is enough to find it again; its content is not kept twice
    (listed.join(wanted.select("source_path"), "source_path", "left_anti")
     .select("path", "source_path").write.mode("overwrite").parquet(f"{out}/unmatched/{place}"))


def _small(rows: DataFrame) -> DataFrame:
    """`rows` for a join with texts: where they are checked to be few, the texts stay."""
    return F.broadcast(rows) if fits(rows) else rows


def rerun_unmatched(spark: SparkSession, folder: str, catalogue: str, out: str, run: str,
                    size: int = fv.DEFAULT_CHUNK_SIZE,
                    overlap: int = fv.DEFAULT_OVERLAP) -> None:
    """Chunks earlier files whose catalogue rows have come since, as rerun `run`.

    Files that an earlier rerun did are left out; the same rerun once more overwrites itself.
    """
    waiting = read_or_none(spark, format="parquet", path=f"{out}/unmatched",
                           schema="path string, source_path string")
    if waiting is None:
        return
    rows = read_source(spark, format="parquet", path=catalogue,
                       schema=table_schema("bronze_documents"))
    done = read_or_none(spark, format="parquet", path=f"{out}/rerun",
                        schema="source_path string, run string")
    waiting = waiting.select("source_path").distinct()
    if done is not None:
        waiting = waiting.join(done.filter(F.col("run") != run), "source_path", "left_anti")
    now = settled(waiting.join(rows.select("source_path"), "source_path", "left_semi"))
    (now.withColumn("run", F.lit(run)).write.mode("overwrite").partitionBy("run")
     .option("partitionOverwriteMode", "dynamic").parquet(f"{out}/rerun"))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .withColumn("source_path", relative_path(F.col("path"), folder))
             .join(_small(now), "source_path", "left_semi"))
    _chunk_files(files.drop("source_path"), folder, catalogue, out, f"job=rerun/batch={run}",
                 size, overlap)


def streamed_chunks(spark: SparkSession, out: str) -> DataFrame:
    """All silver rows below `out`, of stream and reruns."""
    return spark.read.schema(table_schema("silver_chunks")).parquet(f"{out}/chunks")
