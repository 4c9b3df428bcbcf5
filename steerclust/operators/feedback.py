"""Feedback actions: parse (A7), validate (B8), route (B9), train gate (B10), expand.

An action is the struct ``<feedback_type, item_ids, cluster_ids, text_payload, step_number,
reason, confidence>``. Expansion turns accepted actions into narrow tables (links, flags, splits,
labels, keywords) keyed by ``(session_id, seq)``; link rows get a unique sub-order
``seq * SUB_ORDER + position`` so the order-exact link rule (operators.links) sees the reference's
in-action order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..session import cut_lineage

# The eleven feedback types.
FEEDBACK_TYPES = (
    "must_link", "cannot_link", "miscluster", "merge_clusters", "rename_cluster", "emphasize_feature",
    "subcluster", "assign_outlier", "rollback", "show_history", "reset_session",
)
# Links of one action lie between two multiples of this in the order of all links.
SUB_ORDER = 1 << 28
ANCHOR_MULT = 1103515245
ANCHOR_MOD = 2147483648

ACTION_SCHEMA = T.StructType(
    [
        T.StructField("feedback_type", T.StringType()),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
        T.StructField("cluster_ids", T.ArrayType(T.IntegerType())),
        T.StructField("text_payload", T.StringType()),
        T.StructField("step_number", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("thought_process", T.StringType()),
        T.StructField("actions", T.ArrayType(ACTION_SCHEMA)),
        T.StructField("reply_to_user", T.StringType()),
    ]
)
# The reply when a response is rejected as a whole.
APOLOGY = "That answer could not be read. Please say it in other words."
# The same text with every action as raw JSON values, to tell a wrong type from an absent field.
RAW_SCHEMA = T.StructType([T.StructField("actions", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def parse_action_json(responses: DataFrame, col: str = "response") -> DataFrame:
    """JSON text → typed response. Any validation error (malformed JSON, missing fields,
    unknown type, confidence outside [0, 1]) rejects the *whole* response: zero actions and an
    apology. Adds ``accepted``, ``actions`` (empty when rejected) and ``reply``."""
    p = F.from_json(F.col(col), RESPONSE_SCHEMA, {"mode": "PERMISSIVE"})
    parsed = responses.withColumn("_p", p)
    acts = F.col("_p.actions")
    raws = F.from_json(F.col(col), RAW_SCHEMA, {"mode": "PERMISSIVE"})["actions"]
    lists = ("item_ids", "cluster_ids")

    def wrong_type(raw, typed):
        """A value is there but not of its type, a list holds a null, or the confidence is null."""
        bad = [raw[f.name].isNotNull() & typed[f.name].isNull() for f in ACTION_SCHEMA.fields]
        bad += [F.exists(F.coalesce(typed[n], F.array().cast("array<int>")), lambda x: x.isNull()) for n in lists]
        bad.append(F.map_contains_key(raw, "confidence") & raw["confidence"].isNull())
        return reduce(lambda a, b: a | b, [F.coalesce(b, F.lit(False)) for b in bad])

    right_types = ~F.exists(F.zip_with(raws, acts, wrong_type), lambda x: x)
    ok_action = lambda a: (
        a["feedback_type"].isin(*FEEDBACK_TYPES)
        & F.coalesce(a["confidence"], F.lit(1.0)).between(0.0, 1.0)
    )
    accepted = (
        F.col("_p").isNotNull()
        & acts.isNotNull()
        & F.col("_p.thought_process").isNotNull()
        & F.col("_p.reply_to_user").isNotNull()
        & F.coalesce(F.forall(acts, ok_action), F.lit(False))
        & F.coalesce(right_types, F.lit(False))
    )
    return (
        parsed.withColumn("accepted", accepted)
        .withColumn(
            "actions",
            F.when(F.col("accepted"), F.transform(acts, lambda a: a.withField("confidence", F.coalesce(a["confidence"], F.lit(1.0)))))
            .otherwise(F.array().cast(T.ArrayType(ACTION_SCHEMA))),
        )
        .withColumn("reply", F.when(F.col("accepted"), F.col("_p.reply_to_user")).otherwise(F.lit(APOLOGY)))
        .drop("_p")
    )


def parse_with(messages: DataFrame, make_parser: Callable[[], Callable[[list[str]], list[str | None]]], content: str = "content") -> DataFrame:
    """Plug-in message parser (a caller's model in place of the phrase rules): ``make_parser()`` is
    called once per Python worker and maps a list of messages to as many JSON responses, which
    ``parse_action_json`` checks like any other. A null message is passed as empty; a null or wrong
    response is rejected with the apology. Adds ``response`` and the columns of A7."""
    schema = T.StructType([f for f in messages.schema.fields if f.name != "response"] + [T.StructField("response", T.StringType())])

    def run(batches):
        parse = make_parser()
        for batch in batches:
            texts = [t or "" for t in batch.column(content).to_pylist()]
            answers = list(parse(texts)) if texts else []
            if len(answers) != len(texts):
                raise ValueError(f"the parser gave {len(answers)} responses to {len(texts)} messages")
            kept = [f.name for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(answers, pa.string())], [*kept, "response"])

    return parse_action_json(messages.mapInArrow(run, schema))


def explode_actions(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per action of accepted responses, ``action_pos`` keeps the response order."""
    return parsed.select(*keys, F.posexplode("actions").alias("action_pos", "a")).select(*keys, "action_pos", "a.*")


def validate_actions(actions: DataFrame) -> DataFrame:
    """Per-type arity rules; adds ``valid`` and a ``reason`` code (NULL when valid)."""
    t = F.col("feedback_type")
    ni = F.coalesce(F.size("item_ids"), F.lit(0))
    nc = F.coalesce(F.size("cluster_ids"), F.lit(0))
    has_text = F.coalesce(F.length("text_payload"), F.lit(0)) > 0
    reason = (
        F.when(~t.isin(*FEEDBACK_TYPES) | t.isNull(), F.lit("unknown_type"))
        .when(~F.coalesce(F.col("confidence"), F.lit(1.0)).between(0.0, 1.0), F.lit("confidence_out_of_range"))
        .when(t.isin("must_link", "cannot_link") & (ni < 2), F.lit("needs_two_items"))
        .when((t == "miscluster") & (ni < 1), F.lit("needs_items"))
        .when((t == "merge_clusters") & (nc < 2), F.lit("needs_two_clusters"))
        .when((t == "rename_cluster") & ((nc < 1) | ~has_text), F.lit("needs_cluster_and_text"))
        .when((t == "emphasize_feature") & ~has_text, F.lit("needs_text"))
        .when((t == "subcluster") & (nc < 1), F.lit("needs_cluster"))
        .when((t == "assign_outlier") & ((ni < 1) | (nc != 1)), F.lit("needs_item_and_one_cluster"))
        .when((t == "rollback") & F.col("step_number").isNull(), F.lit("needs_step"))
    )
    return actions.withColumn("reason_code", reason).withColumn("valid", reason.isNull())


def route_actions(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Per response: ``history`` if any show_history, else ``control`` for rollback/reset
    (no checkpoint, no training), else ``normal``."""
    t = F.col("feedback_type")
    g = actions.groupBy(*keys).agg(
        F.bool_or(t == "show_history").alias("_h"),
        F.bool_or(t.isin("rollback", "reset_session")).alias("_c"),
        F.count(F.lit(1)).alias("n_actions"),
    )
    route = F.when(F.col("_h"), F.lit("history")).when(F.col("_c"), F.lit("control")).otherwise(F.lit("normal"))
    return g.select(*keys, "n_actions", route.alias("route"))


def _pairs_in_list(ids: F.Column) -> F.Column:
    """All (i, j) position pairs i < j of one action's id list, in the reference's order."""
    n = F.coalesce(F.size(ids), F.lit(0))
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda p: F.transform(F.sequence(p + 1, n - 1), lambda q: F.struct(ids[p].alias("i"), ids[q].alias("j"))),
        )
    )
    empty = F.array().cast("array<struct<i:int,j:int>>")
    return F.when(n >= 2, pairs).otherwise(empty)


def merge_anchor_ranks(assignments: DataFrame, seed: int = 42, k: int = 3) -> DataFrame:
    """E6 ranking: deterministic pseudo-random rank of members per cluster; only the first ``k``
    are kept (``row_number() <= k`` runs as a partial group limit before the shuffle)."""
    key = F.pmod((F.pmod(F.col("item_id"), F.lit(ANCHOR_MOD)) * ANCHOR_MULT + seed), F.lit(ANCHOR_MOD))
    w = Window.partitionBy("cluster_id").orderBy(key, F.col("item_id"))
    return assignments.select("cluster_id", "item_id", F.row_number().over(w).alias("anchor_rank")).where(
        F.col("anchor_rank") <= k
    )


def first_members(assignments: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` members of each cluster by id (outlier targets, examples)."""
    w = Window.partitionBy("cluster_id").orderBy("item_id")
    return assignments.select("cluster_id", "item_id", F.row_number().over(w).alias("member_rank")).where(
        F.col("member_rank") <= k
    )


def _checked_place(pos: str) -> F.Column:
    """The place of a link within its action; more links than ``SUB_ORDER`` are refused, not mixed
    up with the next action's."""
    too_many = F.raise_error(F.lit("an action expands to too many links")).cast("int")
    return F.when(F.col(pos) < SUB_ORDER, F.col(pos)).otherwise(too_many)


def apply_actions(actions: DataFrame, assignments: DataFrame, session: str = "session_id") -> dict[str, DataFrame]:
    """Valid actions → ``links (session, seq, kind, i, j)``, ``flags``, ``splits``, ``labels``
    (last rename wins), ``keywords`` (distinct, lower-case)."""
    # Parsed actions feed seven expansions: materialize them once in the shared checkpoint folder.
    v = cut_lineage(validate_actions(actions).where(F.col("valid")))
    t = F.col("feedback_type")

    direct = v.where(t.isin("must_link", "cannot_link")).select(
        session, "seq", F.when(t == "must_link", "must").otherwise("cannot").alias("kind"),
        F.posexplode(_pairs_in_list(F.col("item_ids"))).alias("pos", "p"),
    ).select(session, (F.col("seq") * SUB_ORDER + _checked_place("pos")).alias("seq"), "kind",
             F.col("p.i").cast("long").alias("i"), F.col("p.j").cast("long").alias("j"))

    anchors = merge_anchor_ranks(assignments)
    merges = v.where(t == "merge_clusters").select(
        session, "seq", F.get(F.col("cluster_ids"), 0).alias("c1"), F.get(F.col("cluster_ids"), 1).alias("c2")
    )
    a1 = anchors.select(F.col("cluster_id").alias("c1"), F.col("item_id").alias("i"), F.col("anchor_rank").alias("r"))
    a2 = anchors.select(F.col("cluster_id").alias("c2"), F.col("item_id").alias("j"), F.col("anchor_rank").alias("r"))
    merge_links = merges.join(a1, "c1").join(a2, ["c2", "r"]).select(
        session, (F.col("seq") * SUB_ORDER + F.col("r") - 1).alias("seq"), F.lit("must").alias("kind"),
        F.col("i").cast("long"), F.col("j").cast("long"),
    )

    firsts = first_members(assignments).select(F.col("cluster_id").alias("c"), F.col("item_id").alias("j"), "member_rank")
    outliers = v.where(t == "assign_outlier").select(
        session, "seq", F.get(F.col("item_ids"), 0).cast("long").alias("i"), F.get(F.col("cluster_ids"), 0).alias("c")
    )
    outlier_links = outliers.join(firsts, "c").select(
        session, (F.col("seq") * SUB_ORDER + F.col("member_rank") - 1).alias("seq"), F.lit("must").alias("kind"),
        "i", F.col("j").cast("long"),
    )
    links = direct.unionByName(merge_links).unionByName(outlier_links)

    flags = v.where(t == "miscluster").select(session, "seq", F.explode("item_ids").alias("item_id"))
    flags = flags.groupBy(session, F.col("item_id").cast("long").alias("item_id")).agg(F.min("seq").alias("seq"))
    splits = v.where(t == "subcluster").select(session, "seq", F.explode("cluster_ids").alias("cluster_id"))
    splits = splits.groupBy(session, "cluster_id").agg(F.min("seq").alias("seq"))
    labels = (
        v.where(t == "rename_cluster")
        .select(session, "seq", F.get(F.col("cluster_ids"), 0).alias("cluster_id"), F.col("text_payload").alias("label"))
        .groupBy(session, "cluster_id")
        .agg(F.max_by("label", "seq").alias("label"), F.max("seq").alias("seq"))
    )
    keywords = (
        v.where(t == "emphasize_feature")
        .select(session, "seq", F.explode(TX.emphasis_keywords("text_payload")).alias("keyword"))
        .groupBy(session, "keyword")
        .agg(F.min("seq").alias("seq"))
    )
    return {"links": links, "flags": flags, "splits": splits, "labels": labels, "keywords": keywords}


def needs_training(tables: dict[str, DataFrame], session: str = "session_id") -> DataFrame:
    """A session trains only if it has any link, label, flag, split or keyword."""
    parts = [tables[n].select(session).distinct() for n in ("links", "labels", "flags", "splits", "keywords")]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct().withColumn("needs_training", F.lit(True))


def flagged_items(items: DataFrame, flags: DataFrame) -> DataFrame:
    """C17: items in the flag set (left semi join)."""
    return items.join(flags.select("item_id").distinct(), "item_id", "left_semi")


def split_members(items: DataFrame, splits: DataFrame) -> DataFrame:
    """C17: items of clusters marked for splitting (left semi join)."""
    return items.join(splits.select("cluster_id").distinct(), "cluster_id", "left_semi")
