"""Session-state plans: checkpoint replay, retention, lookup, history, surviving effects, and the
Parquet checkpoint store. The operation log: every event of a user is a saved step, except that
every fifth (by seq) is a rollback to (its rank − 3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state as ST
from ..sources import tables as S
from .common import SQL_FEEDBACK_LOG, finish
from .q_feedback import SQL_APPLY, SQL_ASSIGN, SQL_TABLES, SQL_VALID, table_rows
from .q_links import SQL_EV
from .q_text import SQL_CLASSIFIED, SQL_MESSAGES, classified_messages
from .registry import register


def ops(spark, sf):
    ev = S.table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    r = ev.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.row_number().over(w).alias("r"))
    return r.select(
        "session_id",
        "seq",
        F.when(F.col("r") % 5 == 0, F.lit("rollback")).otherwise(F.lit("save")).alias("op"),
        F.when(F.col("r") % 5 == 0, F.col("r") - 3).alias("target"),
    )


SQL_REPLAY = """WITH RECURSIVE ops AS (SELECT user_id AS session_id, event_id AS seq,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
ops2 AS (SELECT session_id, seq, r, CASE WHEN r % 5 = 0 THEN 'rollback' ELSE 'save' END AS op,
  CASE WHEN r % 5 = 0 THEN r - 3 END AS target FROM ops),
rec AS (SELECT session_id, 0 AS r, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS target,
    CAST(NULL AS BIGINT) AS step_number, CAST(NULL AS BOOLEAN) AS ok, CAST(0 AS BIGINT) AS lo, CAST(1 AS BIGINT) AS counter
  FROM (SELECT DISTINCT session_id FROM ops2)
  UNION ALL
  SELECT o.session_id, o.r, o.seq, o.op, o.target,
    CASE WHEN o.op = 'save' THEN rec.counter END,
    CASE WHEN o.op = 'save' THEN true ELSE o.target BETWEEN rec.lo AND rec.counter - 1 END,
    CASE WHEN o.op = 'save' THEN greatest(rec.lo, rec.counter + 1 - 10) ELSE rec.lo END,
    CASE WHEN o.op = 'save' THEN rec.counter + 1 WHEN o.target BETWEEN rec.lo AND rec.counter - 1 THEN o.target + 1 ELSE rec.counter END
  FROM rec JOIN ops2 o ON o.session_id = rec.session_id AND o.r = rec.r + 1),
rep AS (SELECT session_id, seq, op, target, step_number, ok, counter AS counter_after, lo AS lo_after FROM rec WHERE r > 0),
fs AS (SELECT session_id, max_by(lo_after, seq) AS lo, max_by(counter_after, seq) AS counter FROM rep GROUP BY session_id),
saves AS (SELECT session_id, step_number, max(seq) AS seq FROM rep WHERE op = 'save' GROUP BY ALL),
kept AS (SELECT s.session_id, s.step_number, s.seq FROM saves s JOIN fs USING (session_id)
  WHERE s.step_number BETWEEN fs.lo AND fs.counter - 1
  UNION ALL SELECT session_id, 0, NULL FROM fs WHERE lo = 0)
"""


@register(
    "checkpoint_replay",
    SQL_REPLAY + "SELECT session_id, seq, op, target, step_number, ok, counter_after, lo_after FROM rep",
)
def q_checkpoint_replay(spark, sf):
    return finish(ST.replay(ops(spark, sf)))


@register("checkpoint_retention", SQL_REPLAY + "SELECT session_id, CAST(step_number AS BIGINT) AS step_number, seq FROM kept")
def q_checkpoint_retention(spark, sf):
    return finish(ST.checkpoint_retention(ST.replay(ops(spark, sf))))


@register(
    "checkpoint_lookup",
    SQL_REPLAY
    + """, rb AS (SELECT session_id, seq, target, ok FROM rep WHERE op = 'rollback')
SELECT rb.session_id, rb.seq, rb.target, CASE WHEN rb.ok THEN (SELECT max(s.seq) FROM rep s WHERE s.op = 'save'
  AND s.session_id = rb.session_id AND s.step_number = rb.target AND s.seq < rb.seq) END AS restored_seq FROM rb""",
)
def q_checkpoint_lookup(spark, sf):
    return finish(ST.checkpoint_lookup(ST.replay(ops(spark, sf))))


@register(
    "show_history",
    SQL_REPLAY
    + """SELECT k.session_id, CAST(count(*) AS BIGINT) AS n_entries, CAST(min(step_number) AS BIGINT) AS first_step,
  CAST(max(step_number) AS BIGINT) AS last_step, CAST(any_value(fs.counter) AS BIGINT) AS current_step
FROM kept k JOIN fs USING (session_id) GROUP BY k.session_id""",
)
def q_show_history(spark, sf):
    return finish(ST.show_history(ST.replay(ops(spark, sf))))


@register(
    "rollback_effects",
    SQL_REPLAY
    + """, t AS (SELECT *, CASE WHEN op = 'rollback' AND ok THEN target END AS tt FROM rep),
lm AS (SELECT *, min(tt) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later_min FROM t)
SELECT session_id, seq, CAST(step_number AS BIGINT) AS step_number FROM lm
WHERE op = 'save' AND (later_min IS NULL OR later_min >= step_number)""",
)
def q_rollback_effects(spark, sf):
    return finish(ST.surviving_saves(ST.replay(ops(spark, sf))))


@register(
    "checkpoint_write",
    SQL_REPLAY + "SELECT session_id, CAST(step_number AS BIGINT) AS step_number, seq FROM saves",
)
def q_checkpoint_write(spark, sf):
    """A5: the newest save of every (session, step) written as a Parquet state table partitioned by
    step (one bulk job), read back through partition pruning."""
    rep = ST.replay(ops(spark, sf))
    saves = rep.where(F.col("op") == "save").groupBy("session_id", "step_number").agg(F.max("seq").alias("seq"))
    root = ST.state_root(spark)
    path = ST.write_state_table(saves, root, "manifest")
    return finish(spark.read.parquet(path).select("session_id", "step_number", "seq"))


SQL_STATE = f"""WITH RECURSIVE {SQL_FEEDBACK_LOG},
{SQL_MESSAGES},
{SQL_CLASSIFIED},
{SQL_VALID},
{SQL_ASSIGN},
ops AS (SELECT session_id, seq, CASE feedback_type WHEN 'rollback' THEN 'rollback' WHEN 'reset_session' THEN 'reset' ELSE 'save' END AS op,
  CASE WHEN feedback_type = 'rollback' THEN step_number END AS target, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r
  FROM valid WHERE reason_code IS NULL AND feedback_type <> 'show_history'),
rec AS (SELECT DISTINCT session_id, 0 AS r, CAST(NULL AS BIGINT) AS seq, '' AS op, CAST(NULL AS BIGINT) AS step_number,
    CAST(NULL AS BIGINT) AS back, CAST(0 AS BIGINT) AS lo, CAST(1 AS BIGINT) AS counter FROM ops
  UNION ALL
  SELECT o.session_id, o.r, o.seq, o.op, CASE WHEN o.op = 'save' THEN rec.counter END,
    CASE WHEN o.op = 'reset' THEN 0 WHEN o.op = 'rollback' AND o.target BETWEEN rec.lo AND rec.counter - 1 THEN o.target END,
    CASE o.op WHEN 'save' THEN greatest(rec.lo, rec.counter + 1 - 10) WHEN 'reset' THEN 0 ELSE rec.lo END,
    CASE WHEN o.op = 'save' THEN rec.counter + 1 WHEN o.op = 'reset' THEN 1
      WHEN o.target BETWEEN rec.lo AND rec.counter - 1 THEN o.target + 1 ELSE rec.counter END
  FROM rec JOIN ops o ON o.session_id = rec.session_id AND o.r = rec.r + 1),
alive AS (SELECT session_id, seq FROM (SELECT *, min(back) OVER (PARTITION BY session_id ORDER BY seq DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM rec WHERE r > 0)
  WHERE op = 'save' AND (later IS NULL OR later >= step_number)),
restored AS (SELECT session_id, max(seq) AS restored_at FROM rec WHERE back IS NOT NULL GROUP BY session_id),
{SQL_APPLY.replace("SELECT * FROM valid WHERE reason_code IS NULL", "SELECT valid.* FROM valid JOIN alive USING (session_id, seq)")},
ev AS (SELECT session_id, seq, kind, least(i, j) AS lo, greatest(i, j) AS hi FROM links_out WHERE i <> j),
{SQL_EV[SQL_EV.index("me AS ("):]},
walk AS (SELECT session_id, restored_at, i, j, i AS node FROM links JOIN restored USING (session_id) WHERE kind = 'cannot'
  UNION SELECT w.session_id, w.restored_at, w.i, w.j, a.y FROM walk w
  JOIN adj a ON a.session_id = w.session_id AND a.x = w.node AND a.w < w.restored_at * 268435456),
gone AS (SELECT DISTINCT session_id, 'cannot' AS kind, i, j FROM walk WHERE node = j),
{SQL_TABLES}
UNION ALL SELECT session_id, kind, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) FROM links ANTI JOIN gone USING (session_id, kind, i, j)
UNION ALL SELECT session_id, 'clusters', CAST(10 + sum(CASE WHEN feedback_type = 'subcluster' THEN len(cluster_ids) ELSE 0 END) AS VARCHAR)
  FROM valid JOIN ops USING (session_id, seq) WHERE op = 'save' GROUP BY session_id"""


@register("restored_state", SQL_STATE)
def q_restored_state(spark, sf):
    """Links, flags, splits, labels, keywords and cluster number of every session at the end of
    its messages, rollbacks and resets."""
    actions = classified_messages(spark, sf)
    t = ST.session_state(actions, S.items(spark, sf).select("item_id", "cluster_id"))
    pairs = F.concat_ws("-", F.col("i").cast("string"), F.col("j").cast("string"))
    out = (
        table_rows(t)
        .unionByName(t["links"].select("session_id", F.col("kind").alias("target"), pairs.alias("value")))
        .unionByName(t["clusters"].select("session_id", F.lit("clusters").alias("target"), F.col("n_clusters").cast("string").alias("value")))
    )
    return finish(out)
