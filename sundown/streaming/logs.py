"""Campaign logs as streams: the batch rules of the event log, kept up to date.

State is keyed by (campaign, idempotency key) or (campaign, chunk of its sequence), or
aggregated map-side first, so a campaign that holds a large share of the stream is spread
over the state partitions like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sundown.functions.checks import first_failure
from sundown.functions.hashing import row_text
from sundown.operators.events import MEMBERSHIP, kind, state_after, typed

LOG_SCHEMA = (
    "campaign_id string, sequence bigint, event_type string, occurred_at timestamp, idempotency_key string, "
    "previous_event_digest string, event_digest string, payload string"
)


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream the parquet files of a landed log."""
    return (
        spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def without_retries(log: DataFrame, delay: str) -> DataFrame:
    """The first delivery of every idempotency key, as long as repeats come within the delay."""
    return log.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["campaign_id", "idempotency_key"])


def stream_campaign_state(log: DataFrame, delay: str) -> DataFrame:
    """Running state per campaign. The fold is associative, so arrival order does not matter."""
    at = F.col("sequence")
    after = state_after()
    membership = kind().isin(*MEMBERSHIP)
    return typed(without_retries(log, delay)).groupBy("campaign_id").agg(
        F.max_by(after, F.when(after.isNotNull(), at)).alias("state"),
        F.max("occurred_at").alias("last_event_at"),
        F.count(F.lit(1)).alias("events"),
        F.coalesce(
            F.max_by(kind() == "RECONCILIATION_RECORDED", F.when(membership, at)), F.lit(False)
        ).alias("reconciled"),
        # A gap shows as fewer events than the highest sequence; it is a failure only once
        # the watermark has passed it: see sundown.streaming.chain.
        (F.max("sequence") - F.count(F.lit(1))).alias("missing"),
    )


def stream_conflicts(log: DataFrame, delay: str) -> DataFrame:
    """Idempotency keys that arrived with more than one content."""
    content = F.sha2(row_text(("event_type", "payload")), 256)
    return (
        log.withWatermark("occurred_at", delay).withColumn("_h", content)
        .groupBy("campaign_id", "idempotency_key")
        .agg((F.min("_h") != F.max("_h")).alias("conflict"))
        .filter("conflict")
    )


def write_updates(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write each micro-batch to its own folder; running a batch again replaces it."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(save).start()
    )


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row per key."""
    columns = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_u")).select(*keys, "_u.*")


def present_failures(findings: DataFrame) -> DataFrame:
    """First failure of each campaign from the last finding of every event; a stream that breaks comes before its creation."""
    last = latest(findings, ["campaign_id", "sequence"]).filter("refusal_code IS NOT NULL")
    return first_failure(last, ["campaign_id"], ["check", "sequence"], ["sequence", "refusal_code"])


def split_late(log: DataFrame, folder: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Every event to ``folder/events``, in ``late=true`` or ``late=false``; read them with :func:`split_events`.

    An event is late if its time is not after the newest of all earlier batches less the delay, as
    for a watermark. The newest time is a running maximum: a batch reads the row of the one before
    and writes its own, so a batch that runs again finds the same border and replaces its own output.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.parquet(f"{folder}/border/batch={batch_id - 1}").first()["newest"] if batch_id else None
        late = F.lit(False)
        if earlier is not None:
            late = F.coalesce(F.col("occurred_at") <= F.timestamp_micros(F.lit(earlier)) - F.expr(f"INTERVAL {delay}"), late)
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{folder}/events/batch={batch_id}")
        newest = F.greatest(F.unix_micros(F.max("occurred_at")), F.lit(earlier).cast("bigint"))
        batch.agg(newest.alias("newest")).write.mode("overwrite").parquet(f"{folder}/border/batch={batch_id}")

    return (
        log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )


def split_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of :func:`split_late` with ``batch`` and ``late``; together they are all that arrived."""
    return spark.read.schema(f"{LOG_SCHEMA}, batch int, late boolean").option("basePath", f"{folder}/events").parquet(f"{folder}/events")
