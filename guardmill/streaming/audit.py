"""Running totals of the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from guardmill.operators import index
from guardmill.operators.audit import seen_totals
from guardmill.sources.tables import read_audit

#: How late an event may come, and the span of time whose totals are kept together.
DELAY, SPAN = "7 days", "1 day"
_KEYS = ("span", "user_id", "event_type", "status")
_SUMS = ("events", "returned", "filtered_out")


def totals_per_span(events: DataFrame, delay: str = DELAY, span: str = SPAN) -> DataFrame:
    """span, user_id, event_type, status and sums, of batch or stream.

    On a stream the sums of a span are state until no event of it is waited for any more:
    `delay` behind the latest time seen. Events later than that are left out. Events without
    a readable time can't be dated and are left out as well.
    """
    dated = events.withColumn("at", F.try_to_timestamp("timestamp")).filter(
        F.col("at").isNotNull())
    return (dated.withWatermark("at", delay)
            .groupBy(F.window("at", span).alias("w"), "user_id", "event_type", "status")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.coalesce("returned_count", F.lit(0))).cast("bigint")
                 .alias("returned"),
                 F.sum(F.coalesce("filtered_out_count", F.lit(0))).cast("bigint")
                 .alias("filtered_out"))
            .select(F.col("w.start").alias("span"), *_KEYS[1:], *_SUMS))


def stream_audit_totals(spark: SparkSession, log: str, table: str, checkpoint: str,
                        delay: str = DELAY, span: str = SPAN,
                        trigger: dict | None = None) -> StreamingQuery:
    """Keeps the totals of the events arriving in `log` in the keyed table `table`.

    Every micro-batch hands over the sums that changed (update mode), and they replace those
    of the same key, so a batch that is replayed after a failure changes nothing.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        # null-safe: a user without an id, say, has totals as well
        key = F.sha2(F.to_json(F.struct(*(F.col(c).cast("string") for c in _KEYS))), 256)
        index.upsert_stored(batch.withColumn("id", key).withColumn(
            "updated_at", F.lit(batch_id).cast("bigint")), table)

    changed = totals_per_span(read_audit(spark, log, stream=True), delay, span)
    return (changed.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_totals(spark: SparkSession, table: str) -> DataFrame:
    """user_id, event_type, status and the sums over all spans; empty before the first."""
    stored = index.read_stored(spark, table)
    if stored is None:
        return spark.createDataFrame([], "user_id string, event_type string, status string, "
                                         "events long, returned long, filtered_out long")
    return stored.groupBy("user_id", "event_type", "status").agg(
        *(F.sum(c).cast("bigint").alias(c) for c in _SUMS))


def visible_totals(spark: SparkSession, table: str, viewers: DataFrame) -> DataFrame:
    """`operators.audit.audit_totals` from the kept table."""
    return seen_totals(read_totals(spark, table), viewers)
