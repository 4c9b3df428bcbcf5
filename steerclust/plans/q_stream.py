"""Streaming plans: the feedback log written as shuffled Parquet files and consumed by the
streaming jobs; results are read back from their sinks and equal the batch jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..session import checkpoint_dir
from ..sources import tables as S
from ..streaming import feedback_stream as FS
from .common import SQL_FEEDBACK_LOG, finish, with_
from .q_links import SQL_EV
from .registry import register


def action_log(spark, sf):
    """Actions derived from the feedback log (one per event)."""
    fl = S.feedback_log(spark, sf)
    t = F.col("feedback_type")
    words = F.array(*[F.lit(w) for w in S.CONCEPT_WORDS])
    items = (
        F.when(t.isin("must_link", "cannot_link"), F.array(F.col("a").cast("int"), F.col("b").cast("int")))
        .when(t.isin("miscluster", "assign_outlier"), F.array(F.col("a").cast("int")))
    )
    clusters = F.when(
        t == "assign_outlier",
        F.when(F.col("b") % 3 == 0, F.array((F.col("b") % 10).cast("int"), (F.col("a") % 10).cast("int"))).otherwise(
            F.array((F.col("b") % 10).cast("int"))
        ),
    )
    payload = F.when(t == "emphasize_feature", F.element_at(words, (F.col("a") % 8 + 1).cast("int")))
    return fl.select(
        "session_id", "seq", "feedback_type", items.alias("item_ids"), clusters.alias("cluster_ids"),
        payload.alias("text_payload"), F.lit(None).cast("int").alias("step_number"), F.lit(None).cast("string").alias("reason"),
        F.lit(1.0).alias("confidence"), F.col("ts").cast("timestamp").alias("ts"),
    )


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WORDS = "[" + ", ".join(f"'{w}'" for w in S.CONCEPT_WORDS) + "]"


@register(
    "stream_actions",
    with_(SQL_FEEDBACK_LOG)
    + f""", acts AS (SELECT session_id, seq, feedback_type,
  CASE WHEN feedback_type IN ('must_link', 'cannot_link') THEN [a, b] WHEN feedback_type IN ('miscluster', 'assign_outlier') THEN [a] END AS item_ids,
  CASE WHEN feedback_type = 'assign_outlier' THEN CASE WHEN b % 3 = 0 THEN [b % 10, a % 10] ELSE [b % 10] END END AS cluster_ids,
  CASE WHEN feedback_type = 'emphasize_feature' THEN {_WORDS}[a % 8 + 1] END AS text_payload FROM feedback_log)
SELECT session_id, seq, feedback_type, reason_code IS NULL AS valid, reason_code FROM (SELECT *, CASE
  WHEN feedback_type IN ('must_link', 'cannot_link') AND coalesce(len(item_ids), 0) < 2 THEN 'needs_two_items'
  WHEN feedback_type = 'miscluster' AND coalesce(len(item_ids), 0) < 1 THEN 'needs_items'
  WHEN feedback_type = 'emphasize_feature' AND coalesce(length(text_payload), 0) = 0 THEN 'needs_text'
  WHEN feedback_type = 'assign_outlier' AND (coalesce(len(item_ids), 0) < 1 OR coalesce(len(cluster_ids), 0) <> 1) THEN 'needs_item_and_one_cluster'
  END AS reason_code FROM acts)""",
)
def q_stream_actions(spark, sf):
    """J1 over the feedback log written as 5 shuffled Parquet files; rows are told apart by
    (session, seq) when the sink is read, so the stream holds no state."""
    log = action_log(spark, sf)
    src = FS.write_files(log, _scratch(spark, "actions-src"), files=5)
    acc, qua = FS.stream_actions(spark, src, log.schema, max_files_per_trigger=5)
    out = FS.read_actions(spark, acc).unionByName(FS.read_actions(spark, qua))
    return finish(out.select("session_id", "seq", "feedback_type", "valid", "reason_code"))


@register("stream_links", "WITH RECURSIVE " + SQL_FEEDBACK_LOG + ",\n" + SQL_EV + "\nSELECT session_id, kind, i, j FROM links")
def q_stream_links(spark, sf):
    """J2 over the link events written as 5 shuffled Parquet files."""
    ev = S.link_events(spark, sf)
    src = FS.write_files(ev, _scratch(spark, "links-src"), files=5)
    path = FS.stream_links(spark, src, ev.schema, max_files_per_trigger=3)
    return finish(spark.read.parquet(path).select("session_id", "kind", "i", "j"))
