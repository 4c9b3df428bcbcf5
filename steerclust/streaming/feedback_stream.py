"""Structured Streaming jobs for the feedback log (J1, J2); both equal their batch twins.

* ``stream_actions`` (J1): action rows arrive as files; each micro-batch is validated (B8) and
  written to ``accepted`` / ``quarantine`` tables partitioned by batch id with dynamic
  partition overwrite, so a replayed batch rewrites exactly its own output (idempotent sink).
  Optional event-time dedupe: ``withWatermark(ts) + dropDuplicatesWithinWatermark(session, seq)``.
* ``stream_links`` (J2): every micro-batch is folded into an incremental link store (see
  ``link_state``): of a touched session only its spanning forest and live cannot events are read,
  whatever its history, and late or out-of-order rows give the same end state as the batch job. The
  links are written once more as a plain table when the stream has ended. ``buckets`` should be
  about the bytes of all state over 128 MB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..session import checkpoint_dir
from .link_state import LinkStore

BUCKETS = 64


def _root(spark: SparkSession, root: str | None) -> str:
    return root or f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def write_files(df: DataFrame, path: str, files: int = 5, seed: int = 7) -> str:
    """Write a table as ``files`` Parquet files in shuffled row order (a test source)."""
    df.withColumn("_r", F.rand(seed)).repartition(files, "_r").sortWithinPartitions("_r").drop("_r").write.mode(
        "overwrite"
    ).parquet(path)
    return path


def stream_actions(
    spark: SparkSession,
    source_path: str,
    schema,
    root: str | None = None,
    watermark: str | None = None,
    max_files_per_trigger: int = 1,
) -> tuple[str, str]:
    """Validate streamed actions. Returns (accepted_path, quarantine_path)."""
    root = _root(spark, root)
    acc, qua = f"{root}/accepted", f"{root}/quarantine"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_path)
    if watermark:
        stream = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "seq"])

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        v = FB.validate_actions(batch).withColumn("batch_id", F.lit(batch_id))
        dyn = {"partitionOverwriteMode": "dynamic"}  # only this batch's partition is replaced
        v.where(F.col("valid")).write.mode("overwrite").options(**dyn).partitionBy("batch_id").parquet(acc)
        v.where(~F.col("valid")).write.mode("overwrite").options(**dyn).partitionBy("batch_id").parquet(qua)

    q = (
        stream.writeStream.foreachBatch(per_batch)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return acc, qua


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Read a J1 sink, keeping one row per (session, seq) whatever batches were replayed."""
    df = spark.read.parquet(path)
    return df.dropDuplicates(["session_id", "seq"]).drop("batch_id")


def stream_links(
    spark: SparkSession,
    source_path: str,
    schema,
    root: str | None = None,
    buckets: int = BUCKETS,
    max_files_per_trigger: int = 1,
) -> str:
    """Keep the resolved link store current while link events arrive; returns its path."""
    root = _root(spark, root)
    store = LinkStore(spark, root, buckets)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_path)
    q = (
        stream.writeStream.foreachBatch(store.add)
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    store.links().write.mode("overwrite").parquet(f"{root}/links")
    return f"{root}/links"
