"""Text expressions: tokens (H4), excerpts (B1), emphasis keywords (H3), message typing (H6),
step descriptions (H7). Everything is a Catalyst expression (Java regex), no Python UDF."""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode word tokens of two or more word characters, lower-cased first.
TOKEN_PATTERN = r"(?U)\b\w\w+\b"

# Fixed values (message parsing): split and filler patterns for emphasized concepts.
EMPHASIS_SPLIT = r"(?iU)\s*(?:,|;|\band\b|\bor\b|\b&\b)\s*"
EMPHASIS_NOISE = r"(?iU)\b(?:elements?|aspects?|features?|concepts?|themes?|keywords?|topics?|factors?)\b"


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    path = os.path.join(os.path.dirname(__file__), "stop_words_en.txt")
    with open(path, encoding="utf-8") as fh:
        return tuple(w.strip() for w in fh if w.strip() and not w.startswith("#"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """H4: lower-case, ``\\b\\w\\w+\\b`` tokens (Unicode word characters) as ``ARRAY<STRING>``."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


# In texts without such characters, Python's words and lower case are those of ``TOKEN_PATTERN`` in Java.
_OTHER = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_WORD = re.compile(r"\w\w+")


def simple_tokens(text: str | None) -> list[str] | None:
    """H4 in Python for texts of ASCII characters and Latin-1 letters; None for others, which are
    left to ``tokens`` (no text has no tokens)."""
    if text is None:
        return []
    return None if not text.isascii() and _OTHER.search(text) else _WORD.findall(text.lower())


def excerpt(text, max_chars: int = 160) -> Column:
    """B1: text longer than ``max_chars`` → first ``max_chars-3`` characters + ``...``."""
    t = _c(text)
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars - 3), F.lit("..."))).otherwise(t)


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def emphasis_keywords(payload) -> Column:
    """H3: split a concept payload on , ; and or & (word-bounded), strip filler words, collapse
    spaces; if nothing is left keep the stripped raw payload. Lower-cased as stored."""
    raw = _strip(_c(payload))
    parts = F.split(raw, EMPHASIS_SPLIT)
    cleaned = F.transform(
        parts, lambda t: F.regexp_replace(_strip(F.regexp_replace(t, EMPHASIS_NOISE, "")), r"\s+", " ")
    )
    kept = F.filter(cleaned, lambda t: F.length(t) > 0)
    out = F.when(F.size(kept) > 0, kept).otherwise(F.array(raw))
    return F.when(raw.isNull() | (F.length(raw) == 0), F.array().cast("array<string>")).otherwise(
        F.transform(out, lambda t: F.lower(t))
    )


# Fixed values (message typing): trigger phrases per feedback type, first match wins in this order.
HISTORY_COMMANDS = ("show history", "history", "what happened")
MESSAGE_RULES: tuple[tuple[str, str], ...] = (
    ("rollback", r"roll back|undo|rollback"),
    ("reset_session", r"reset|start over"),
    ("subcluster", r"should be split|too mixed|split into|divide cluster|split it|into subgroups"),
    ("merge_clusters", r"should be merged|are the same topic|combine|merge clusters|merged"),
    ("rename_cluster", r"rename|call cluster|name cluster|label cluster"),
    ("emphasize_feature", r"emphasize|focus on|prioritize|pay attention to"),
    ("assign_outlier", r"assign|move outlier"),
    ("miscluster", r"wrong cluster|misplaced|doesn't belong|in the wrong place"),
    ("cannot_link", r"should not be|should not be grouped|separate|keep apart|should not be with"),
    ("must_link", r"should be together|same cluster|group together|should be in the same|are similar"),
)
ITEM_LIST = r"(?i)\bitems?\s+(\d+(?:\s*(?:,\s*and|,|and)\s*\d+)*)"
CLUSTER_LIST = r"(?i)\bclusters?\s+(\d+(?:\s*(?:,\s*and|,|and)\s*\d+)*)"
STEP_NUMBER = r"(?i)\bstep\s+(\d+)"
QUOTED = r"""['"]([^'"]+)['"]"""
EMPHASIS_PAYLOAD = r"(?i)(?:emphasize|focus on|prioritize|pay attention to)\s+(.*?)(?:\s+when\b|\s+-|[.!?]|$)"


def _ids(msg: Column, pattern: str, kind: str = "bigint") -> Column:
    groups = F.regexp_extract_all(msg, F.lit(pattern), 1)
    nums = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+)"), 1)))
    return F.transform(nums, lambda n: n.try_cast(kind))


def normalized_message(message) -> Column:
    """Lower-cased, trimmed message text (the form the typing rules read)."""
    return F.lower(_strip(_c(message)))


def message_type(message, normalized: bool = False) -> Column:
    """H6 type: first matching rule on the lower-cased, trimmed message; NULL if none.
    ``normalized=True`` when ``message`` already holds ``normalized_message``."""
    m = _c(message) if normalized else normalized_message(message)
    expr = F.when(m.isin(*HISTORY_COMMANDS), F.lit("show_history"))
    for ftype, pattern in MESSAGE_RULES:
        expr = expr.when(m.rlike(pattern), F.lit(ftype))
    return expr


def _action_from_type(msg: Column, ftype: Column) -> Column:
    payload = (
        F.when(ftype == "rename_cluster", F.nullif(F.regexp_extract(msg, QUOTED, 1), F.lit("")))
        .when(ftype == "emphasize_feature", F.nullif(_strip(F.regexp_extract(msg, EMPHASIS_PAYLOAD, 1)), F.lit("")))
    )
    step = F.when(ftype == "rollback", F.nullif(F.regexp_extract(msg, STEP_NUMBER, 1), F.lit("")).try_cast("int"))
    return F.when(
        ftype.isNotNull(),
        F.struct(
            ftype.alias("feedback_type"),
            _ids(msg, ITEM_LIST, "bigint").alias("item_ids"),
            _ids(msg, CLUSTER_LIST, "int").alias("cluster_ids"),
            payload.alias("text_payload"),
            step.alias("step_number"),
            F.lit(None).cast("string").alias("reason"),
            F.lit(1.0).alias("confidence"),
        ),
    )


def classify_message(message) -> Column:
    """H6: one action struct per message (type, item ids, cluster ids, payload, step) or NULL.

    For DataFrames prefer ``classify_messages``, which evaluates the rule chain once per row."""
    msg = _c(message)
    return _action_from_type(msg, message_type(msg))


def classify_messages(df, message: str = "content", out: str = "action"):
    """H6 over a DataFrame: the type is computed in its own projection, then the action struct."""
    norm = df.withColumn("_m", normalized_message(message))
    typed = norm.withColumn("_ftype", message_type("_m", normalized=True)).drop("_m")
    return typed.withColumn(out, _action_from_type(F.col(message), F.col("_ftype"))).drop("_ftype")


def typed_actions(df, keys: list[str], message: str = "content"):
    """Rows of ``classify_messages`` that carry an action, flattened to the action fields.

    Messages without an action are dropped by exploding a filtered one-element array rather than
    by a Filter: a filter on the action would be pushed below the projections and re-evaluate
    the whole rule chain (and whatever built the message) once more per row."""
    c = classify_messages(df, message)
    one = F.explode(F.filter(F.array(F.col("action")), lambda a: a.isNotNull())).alias("action")
    return c.select(*keys, one).select(*keys, "action.*")


def describe_step(types) -> Column:
    """H7: ``Applied: t1, t2`` from an ordered array of feedback types."""
    return F.concat(F.lit("Applied: "), F.array_join(_c(types), ", "))
