"""Feedback plans: response JSON parsing, action validation, routing, expansion, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..sources import tables as S
from .common import SQL_FEEDBACK_LOG, finish, with_
from .q_text import SQL_CLASSIFIED, SQL_EMPH, SQL_MESSAGES, classified_messages
from .registry import register


def responses(spark, sf):
    """One JSON response per event (FIXTURES): one must/cannot action with the event's pair.
    Defects: unknown type every 13th id, confidence 1.5 every 11th, missing brace every 17th."""
    fl = S.feedback_log(spark, sf)
    eid = F.col("seq")
    ftype = F.when(eid % 13 == 0, "bogus").when(eid % 2 == 0, "must_link").otherwise("cannot_link")
    conf = F.when(eid % 11 == 0, F.lit("1.5")).otherwise(F.lit("0.9"))
    body = F.concat(
        F.lit('{"thought_process": "event '), eid.cast("string"),
        F.lit('", "actions": [{"feedback_type": "'), ftype,
        F.lit('", "item_ids": ['), F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"),
        F.lit('], "confidence": '), conf,
        F.lit('}], "reply_to_user": "Noted."'),
        F.when(eid % 17 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return fl.select("session_id", F.col("seq").alias("response_id"), body.alias("response"))


SQL_RESPONSES = """responses AS (SELECT session_id, seq AS response_id,
  '{"thought_process": "event ' || CAST(seq AS VARCHAR) || '", "actions": [{"feedback_type": "' ||
  CASE WHEN seq % 13 = 0 THEN 'bogus' WHEN seq % 2 = 0 THEN 'must_link' ELSE 'cannot_link' END ||
  '", "item_ids": [' || CAST(a AS VARCHAR) || ', ' || CAST(b AS VARCHAR) || '], "confidence": ' ||
  CASE WHEN seq % 11 = 0 THEN '1.5' ELSE '0.9' END || '}], "reply_to_user": "Noted."' ||
  CASE WHEN seq % 17 = 0 THEN '' ELSE '}' END AS response FROM feedback_log)"""

_TYPES_SQL = ", ".join(f"'{t}'" for t in FB.FEEDBACK_TYPES)
SQL_PARSED = f"""parsed AS (SELECT session_id, response_id, response,
  CASE WHEN NOT json_valid(response) THEN false ELSE json_extract(response, '$.thought_process') IS NOT NULL
  AND json_extract(response, '$.reply_to_user') IS NOT NULL AND json_type(response, '$.actions') = 'ARRAY'
  AND coalesce(list_bool_and(list_transform(json_extract_string(response, '$.actions[*].feedback_type'),
      lambda t: t IN ({_TYPES_SQL}))), true)
  AND coalesce(list_bool_and(list_transform(json_extract(response, '$.actions[*].confidence'),
      lambda c: coalesce(CAST(c AS DOUBLE), 1.0) BETWEEN 0.0 AND 1.0)), true) END AS accepted
  FROM responses)"""


@register(
    "parse_action_json",
    with_(SQL_FEEDBACK_LOG, SQL_RESPONSES, SQL_PARSED)
    + f"""SELECT response_id, accepted,
  CAST(CASE WHEN accepted THEN json_array_length(response, '$.actions') ELSE 0 END AS BIGINT) AS n_actions,
  CASE WHEN accepted THEN json_extract_string(response, '$.reply_to_user') ELSE '{FB.APOLOGY.replace("'", "''")}' END AS reply
FROM parsed""",
)
def q_parse_action_json(spark, sf):
    p = FB.parse_action_json(responses(spark, sf))
    return finish(p.select("response_id", "accepted", F.size("actions").cast("bigint").alias("n_actions"), "reply"))


@register(
    "accepted_actions",
    with_(SQL_FEEDBACK_LOG, SQL_RESPONSES, SQL_PARSED)
    + """SELECT response_id, CAST(0 AS BIGINT) AS action_pos,
  json_extract_string(response, '$.actions[0].feedback_type') AS feedback_type,
  array_to_string(CAST(json_extract(response, '$.actions[0].item_ids') AS INTEGER[]), ',') AS item_ids,
  round(CAST(json_extract(response, '$.actions[0].confidence') AS DOUBLE), 6) AS confidence
FROM parsed WHERE accepted""",
)
def q_accepted_actions(spark, sf):
    p = FB.parse_action_json(responses(spark, sf))
    a = FB.explode_actions(p, ["response_id"])
    return finish(
        a.select(
            "response_id", "action_pos", "feedback_type",
            F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("item_ids"), "confidence",
        )
    )


SQL_VALID = """valid AS (SELECT *, CASE
  WHEN feedback_type IS NULL THEN 'unknown_type'
  WHEN feedback_type IN ('must_link', 'cannot_link') AND len(item_ids) < 2 THEN 'needs_two_items'
  WHEN feedback_type = 'miscluster' AND len(item_ids) < 1 THEN 'needs_items'
  WHEN feedback_type = 'merge_clusters' AND len(cluster_ids) < 2 THEN 'needs_two_clusters'
  WHEN feedback_type = 'rename_cluster' AND (len(cluster_ids) < 1 OR coalesce(length(text_payload), 0) = 0) THEN 'needs_cluster_and_text'
  WHEN feedback_type = 'emphasize_feature' AND coalesce(length(text_payload), 0) = 0 THEN 'needs_text'
  WHEN feedback_type = 'subcluster' AND len(cluster_ids) < 1 THEN 'needs_cluster'
  WHEN feedback_type = 'assign_outlier' AND (len(item_ids) < 1 OR len(cluster_ids) <> 1) THEN 'needs_item_and_one_cluster'
  WHEN feedback_type = 'rollback' AND step_number IS NULL THEN 'needs_step'
  END AS reason_code FROM classified)"""


@register(
    "validate_actions",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED, SQL_VALID)
    + "SELECT seq, feedback_type, reason_code IS NULL AS valid, reason_code FROM valid",
)
def q_validate_actions(spark, sf):
    v = FB.validate_actions(classified_messages(spark, sf))
    return finish(v.select("seq", "feedback_type", "valid", "reason_code"))


@register(
    "route_actions",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED)
    + """SELECT CAST(seq // 4 AS BIGINT) AS response_id, CAST(count(*) AS BIGINT) AS n_actions,
  CASE WHEN bool_or(feedback_type = 'show_history') THEN 'history'
       WHEN bool_or(feedback_type IN ('rollback', 'reset_session')) THEN 'control' ELSE 'normal' END AS route
FROM classified GROUP BY seq // 4""",
)
def q_route_actions(spark, sf):
    c = classified_messages(spark, sf).withColumn("response_id", F.floor(F.col("seq") / 4).cast("bigint"))
    return finish(FB.route_actions(c, ["response_id"]))


SQL_ASSIGN = """assign AS (SELECT vec_id AS item_id, label AS cluster_id FROM embeddings),
anchors AS (SELECT * FROM (SELECT cluster_id, item_id, row_number() OVER (PARTITION BY cluster_id
  ORDER BY ((item_id % 2147483648) * 1103515245 + 42) % 2147483648, item_id) AS anchor_rank FROM assign) WHERE anchor_rank <= 3),
firsts AS (SELECT * FROM (SELECT cluster_id, item_id, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) AS member_rank
  FROM assign) WHERE member_rank <= 3)"""

SQL_APPLY = """v AS (SELECT * FROM valid WHERE reason_code IS NULL),
direct AS (SELECT session_id, seq * 268435456 + pos - 1 AS seq, CASE feedback_type WHEN 'must_link' THEN 'must' ELSE 'cannot' END AS kind,
  CAST(p.i AS BIGINT) AS i, CAST(p.j AS BIGINT) AS j FROM (
  SELECT session_id, seq, feedback_type, unnest(prs) AS p, unnest(generate_series(1, len(prs))) AS pos FROM (
    SELECT session_id, seq, feedback_type, flatten(list_transform(generate_series(1, len(item_ids) - 1),
      lambda x: list_transform(generate_series(x + 1, len(item_ids)), lambda y: {'i': item_ids[x], 'j': item_ids[y]}))) AS prs
    FROM v WHERE feedback_type IN ('must_link', 'cannot_link')))),
merges AS (SELECT m.session_id, m.seq * 268435456 + a1.anchor_rank - 1 AS seq, 'must' AS kind, a1.item_id AS i, a2.item_id AS j
  FROM v m JOIN anchors a1 ON a1.cluster_id = m.cluster_ids[1] JOIN anchors a2 ON a2.cluster_id = m.cluster_ids[2]
  AND a2.anchor_rank = a1.anchor_rank WHERE m.feedback_type = 'merge_clusters'),
outl AS (SELECT o.session_id, o.seq * 268435456 + f.member_rank - 1 AS seq, 'must' AS kind, CAST(o.item_ids[1] AS BIGINT) AS i,
  f.item_id AS j FROM v o JOIN firsts f ON f.cluster_id = o.cluster_ids[1] WHERE o.feedback_type = 'assign_outlier'),
links_out AS (SELECT * FROM direct UNION ALL SELECT * FROM merges UNION ALL SELECT * FROM outl)"""


@register(
    "apply_actions",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED, SQL_VALID, SQL_ASSIGN, SQL_APPLY)
    + """SELECT session_id, seq, kind, i, j FROM links_out""",
)
def q_apply_actions(spark, sf):
    assign = S.items(spark, sf).select("item_id", "cluster_id")
    t = FB.apply_actions(classified_messages(spark, sf), assign)
    return finish(t["links"])


SQL_TABLES = (
    """flags AS (SELECT session_id, CAST(it AS BIGINT) AS item_id FROM (
    SELECT session_id, unnest(item_ids) AS it FROM v WHERE feedback_type = 'miscluster') GROUP BY ALL),
splits AS (SELECT session_id, c AS cluster_id FROM (
    SELECT session_id, unnest(cluster_ids) AS c FROM v WHERE feedback_type = 'subcluster') GROUP BY ALL),
labels AS (SELECT session_id, cluster_ids[1] AS cluster_id, max_by(text_payload, seq) AS label FROM v
    WHERE feedback_type = 'rename_cluster' GROUP BY ALL),
kw AS (SELECT DISTINCT session_id, lower(k) AS keyword FROM (
    SELECT session_id, unnest(CASE WHEN len(kws) > 0 THEN kws ELSE [regexp_replace(text_payload, '^\\s+|\\s+$', '', 'g')] END) AS k FROM (
    SELECT session_id, text_payload, list_filter("""
    + SQL_EMPH
    + """, lambda t: length(t) > 0) AS kws FROM v WHERE feedback_type = 'emphasize_feature')))
SELECT session_id, 'flag' AS target, CAST(item_id AS VARCHAR) AS value FROM flags
UNION ALL SELECT session_id, 'split', CAST(cluster_id AS VARCHAR) FROM splits
UNION ALL SELECT session_id, 'label', CAST(cluster_id AS VARCHAR) || '=' || label FROM labels
UNION ALL SELECT session_id, 'keyword', keyword FROM kw"""
)


def table_rows(t) -> DataFrame:
    """Flags, splits, labels and keywords as ``(session_id, target, value)``."""
    return (
        t["flags"].select("session_id", F.lit("flag").alias("target"), F.col("item_id").cast("string").alias("value"))
        .unionByName(t["splits"].select("session_id", F.lit("split").alias("target"), F.col("cluster_id").cast("string").alias("value")))
        .unionByName(
            t["labels"].select("session_id", F.lit("label").alias("target"),
                               F.concat(F.col("cluster_id").cast("string"), F.lit("="), F.col("label")).alias("value"))
        )
        .unionByName(t["keywords"].select("session_id", F.lit("keyword").alias("target"), F.col("keyword").alias("value")))
    )


@register(
    "action_tables",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED, SQL_VALID, SQL_ASSIGN, SQL_APPLY, SQL_TABLES),
)
def q_action_tables(spark, sf):
    assign = S.items(spark, sf).select("item_id", "cluster_id")
    return finish(table_rows(FB.apply_actions(classified_messages(spark, sf), assign)))


@register(
    "needs_training",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED, SQL_VALID, SQL_ASSIGN, SQL_APPLY)
    + """SELECT DISTINCT session_id, true AS needs_training FROM (
  SELECT session_id FROM links_out UNION ALL SELECT session_id FROM v
  WHERE feedback_type IN ('miscluster', 'subcluster', 'rename_cluster', 'emphasize_feature'))""",
)
def q_needs_training(spark, sf):
    assign = S.items(spark, sf).select("item_id", "cluster_id")
    t = FB.apply_actions(classified_messages(spark, sf), assign)
    return finish(FB.needs_training(t))


@register(
    "merge_anchors",
    with_(SQL_ASSIGN) + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, item_id, CAST(anchor_rank AS BIGINT) AS anchor_rank FROM anchors",
)
def q_merge_anchors(spark, sf):
    return finish(FB.merge_anchor_ranks(S.items(spark, sf).select("item_id", "cluster_id")))


@register(
    "flagged_items",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED, SQL_VALID)
    + """SELECT vec_id AS item_id, CAST(label AS BIGINT) AS cluster_id FROM embeddings
WHERE vec_id IN (SELECT unnest(item_ids) FROM valid WHERE reason_code IS NULL AND feedback_type = 'miscluster')""",
)
def q_flagged_items(spark, sf):
    assign = S.items(spark, sf).select("item_id", "cluster_id")
    t = FB.apply_actions(classified_messages(spark, sf), assign)
    return finish(FB.flagged_items(assign, t["flags"]))


@register(
    "split_members",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED, SQL_VALID)
    + """SELECT vec_id AS item_id, CAST(label AS BIGINT) AS cluster_id FROM embeddings
WHERE label IN (SELECT unnest(cluster_ids) FROM valid WHERE reason_code IS NULL AND feedback_type = 'subcluster')""",
)
def q_split_members(spark, sf):
    assign = S.items(spark, sf).select("item_id", "cluster_id")
    t = FB.apply_actions(classified_messages(spark, sf), assign)
    return finish(FB.split_members(assign, t["splits"]))


def _sql_action_links() -> str:
    from .q_links import SQL_EV

    rest = SQL_EV[SQL_EV.index("me AS ("):]
    ev = """ev AS (SELECT session_id, seq, kind, least(i, j) AS lo, greatest(i, j) AS hi FROM links_out WHERE i <> j),
"""
    return (
        "WITH RECURSIVE " + ",\n".join([SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED, SQL_VALID, SQL_ASSIGN, SQL_APPLY])
        + ",\n" + ev + rest + "\nSELECT session_id, kind, i, j FROM links"
    )


@register("resolve_action_links", _sql_action_links())
def q_resolve_action_links(spark, sf):
    """Full chat path: messages → actions → expanded links → order-exact link store."""
    from ..operators import links as L

    assign = S.items(spark, sf).select("item_id", "cluster_id")
    t = FB.apply_actions(classified_messages(spark, sf), assign)
    return finish(L.resolve_links(t["links"]))
