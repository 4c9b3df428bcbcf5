"""Text plans: tokens, keywords, titles, examples, summaries, excerpts, message parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keywords as K
from ..sources import tables as S
from .common import SQL_FEEDBACK_LOG, finish, with_
from .registry import register


def _stop_list_sql() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in T.english_stop_words())


SQL_DOCS = "docs AS (SELECT doc_id AS item_id, CAST(doc_id % 5 AS INTEGER) AS cluster_id, lang, text FROM documents)"
SQL_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def _sql_terms(key: str) -> str:
    return f"""terms AS (SELECT {key}, term, count(*) AS n FROM (
  SELECT {key}, unnest({SQL_TOKENS}) AS term FROM docs) WHERE term NOT IN ({_stop_list_sql()})
  GROUP BY {key}, term),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, term ASC) AS rank
  FROM terms) WHERE rank <= 10),
kw AS (SELECT {key}, list_sort(list(term)) AS keywords FROM top GROUP BY {key})"""


@register(
    "tokenize",
    with_(SQL_DOCS)
    + f"""SELECT lang, term, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, unnest({SQL_TOKENS}) AS term FROM docs)
GROUP BY lang, term""",
)
def q_tokenize(spark, sf):
    d = S.doc_clusters(spark, sf)
    return finish(K.term_counts(d, ["lang"], stop_words=()))


@register(
    "cluster_keywords",
    with_(SQL_DOCS, _sql_terms("cluster_id"))
    + "SELECT CAST(cluster_id AS BIGINT) AS cluster_id, array_to_string(keywords, ', ') AS keywords FROM kw",
)
def q_cluster_keywords(spark, sf):
    kw = K.cluster_keywords(S.doc_clusters(spark, sf))
    return finish(kw.select("cluster_id", F.array_join("keywords", ", ").alias("keywords")))


@register(
    "lang_keywords",
    with_(SQL_DOCS, _sql_terms("lang")) + "SELECT lang, array_to_string(keywords, ', ') AS keywords FROM kw",
)
def q_lang_keywords(spark, sf):
    kw = K.cluster_keywords(S.doc_clusters(spark, sf), key="lang")
    return finish(kw.select("lang", F.array_join("keywords", ", ").alias("keywords")))


SQL_TITLES = """sizes AS (SELECT cluster_id, count(*) AS size FROM docs GROUP BY cluster_id),
titles AS (SELECT r.k AS cluster_id, coalesce(s.size, 0) AS size,
  CASE WHEN s.size IS NULL THEN 'Cluster ' || r.k || ' (Empty)'
       WHEN len(coalesce(kw.keywords, [])) >= 2 THEN kw.keywords[1] || '/' || kw.keywords[2]
       ELSE 'Cluster ' || r.k END AS title,
  CASE WHEN s.size IS NULL THEN [] ELSE coalesce(kw.keywords, []) END AS keywords
  FROM range(7) r(k) LEFT JOIN sizes s ON s.cluster_id = r.k LEFT JOIN kw ON kw.cluster_id = r.k)"""


@register(
    "cluster_titles",
    with_(SQL_DOCS, _sql_terms("cluster_id"), SQL_TITLES)
    + """SELECT CAST(cluster_id AS BIGINT) AS cluster_id, CAST(size AS BIGINT) AS size, title,
  array_to_string(keywords, ', ') AS keywords FROM titles""",
)
def q_cluster_titles(spark, sf):
    d = S.doc_clusters(spark, sf)
    t = K.cluster_titles(d.select("cluster_id"), K.cluster_keywords(d), 7)
    return finish(t.select("cluster_id", "size", "title", F.array_join("keywords", ", ").alias("keywords")))


SQL_RENAMES = """renames AS (SELECT CAST(event_id % 7 AS INTEGER) AS cluster_id, event_id AS seq,
  'Topic ' || CAST(user_id AS VARCHAR) AS label FROM events WHERE event_type = 'purchase'),
latest AS (SELECT cluster_id, max_by(label, seq) AS label FROM renames GROUP BY cluster_id)"""


@register(
    "apply_user_labels",
    with_(SQL_DOCS, _sql_terms("cluster_id"), SQL_TITLES, SQL_RENAMES)
    + """SELECT CAST(t.cluster_id AS BIGINT) AS cluster_id, CAST(t.size AS BIGINT) AS size,
  coalesce(l.label, t.title) AS title FROM titles t LEFT JOIN latest l USING (cluster_id)""",
)
def q_apply_user_labels(spark, sf):
    d = S.doc_clusters(spark, sf)
    labels = K.latest_labels(S.renames(spark, sf))
    t = K.cluster_titles(d.select("cluster_id"), K.cluster_keywords(d), 7, labels)
    return finish(t.select("cluster_id", "size", "title"))


SQL_EXCERPT = "CASE WHEN length(text) > 160 THEN substring(text, 1, 157) || '...' ELSE text END"


@register(
    "cluster_examples",
    with_(SQL_DOCS)
    + f"""SELECT CAST(cluster_id AS BIGINT) AS cluster_id, item_id, CAST(example_rank AS BIGINT) AS example_rank,
  {SQL_EXCERPT} AS excerpt FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) AS example_rank FROM docs)
WHERE example_rank <= 3""",
)
def q_cluster_examples(spark, sf):
    return finish(K.cluster_examples(S.doc_clusters(spark, sf)))


@register(
    "cluster_summaries",
    with_(SQL_DOCS, _sql_terms("cluster_id"), SQL_TITLES, SQL_RENAMES)
    + f""", ex AS (SELECT cluster_id, string_agg(excerpt, ' | ' ORDER BY example_rank) AS examples FROM (
  SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) AS example_rank,
  {SQL_EXCERPT} AS excerpt FROM docs) WHERE example_rank <= 3 GROUP BY cluster_id)
SELECT CAST(t.cluster_id AS BIGINT) AS cluster_id, coalesce(l.label, t.title) AS title,
  array_to_string(t.keywords, ', ') AS keywords, CAST(t.size AS BIGINT) AS size, ex.examples
FROM titles t LEFT JOIN latest l USING (cluster_id) LEFT JOIN ex USING (cluster_id) WHERE t.size > 0""",
)
def q_cluster_summaries(spark, sf):
    d = S.doc_clusters(spark, sf)
    s = K.cluster_summaries(d, 7, K.latest_labels(S.renames(spark, sf)))
    return finish(
        s.select(
            "cluster_id", "title", F.array_join("keywords", ", ").alias("keywords"), "size",
            F.array_join("examples", " | ").alias("examples"),
        )
    )


@register("excerpt", f"SELECT doc_id, {SQL_EXCERPT} AS excerpt FROM documents")
def q_excerpt(spark, sf):
    d = S.table(spark, sf, "documents")
    return finish(d.select("doc_id", T.excerpt("text").alias("excerpt")))


# ------------------------------------------------------------------------------------------
# Messages → actions (H6), emphasis keywords (H3), step descriptions (H7)
# ------------------------------------------------------------------------------------------

def _words_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in S.CONCEPT_WORDS) + "]"


SQL_MESSAGES = f"""messages AS (SELECT f.session_id, f.seq, 'user' AS role, CASE
  WHEN e.event_type = 'click' AND f.seq % 2 = 0 THEN 'Items ' || CAST(f.a AS VARCHAR) || ' and ' || CAST(f.b AS VARCHAR) || ' should be in the same cluster.'
  WHEN e.event_type = 'click' THEN 'Clusters ' || CAST(f.a % 10 AS VARCHAR) || ' and ' || CAST(f.b % 10 AS VARCHAR) || ' should be merged.'
  WHEN e.event_type = 'error' AND f.seq % 2 = 0 THEN 'Keep apart item ' || CAST(f.a AS VARCHAR) || ' from item ' || CAST(f.b AS VARCHAR) || '.'
  WHEN e.event_type = 'error' THEN 'Please divide cluster ' || CAST(f.a % 10 AS VARCHAR) || ': its texts are about two things.'
  WHEN e.event_type = 'view' AND f.seq % 2 = 0 THEN 'Item ' || CAST(f.a AS VARCHAR) || ' seems to be in the wrong cluster.'
  WHEN e.event_type = 'view' THEN 'Please rename cluster ' || CAST(f.a % 10 AS VARCHAR) || ' to ''Topic ' || CAST(f.b AS VARCHAR) || '''.'
  WHEN e.event_type = 'signup' AND f.seq % 2 = 0 THEN 'Emphasize ' || {_words_sql()}[f.a % 8 + 1] || ' and ' || {_words_sql()}[f.b % 8 + 1] || ' elements when clustering.'
  WHEN e.event_type = 'signup' THEN 'Focus on ' || {_words_sql()}[f.a % 8 + 1] || ', ' || {_words_sql()}[f.b % 8 + 1] || ' or tone.'
  WHEN f.seq % 2 = 0 THEN 'Move outlier item ' || CAST(f.a AS VARCHAR) || ' to cluster ' || CAST(f.b % 10 AS VARCHAR) || '.'
  WHEN f.a % 3 = 0 THEN 'Roll back to step ' || CAST(f.b % 10 AS VARCHAR) || '.'
  WHEN f.a % 3 = 1 THEN 'show history'
  ELSE 'Please start over.' END AS content
  FROM feedback_log f JOIN events e ON e.event_id = f.seq)"""


def _sql_rules() -> str:
    parts = [
        "CASE WHEN m IN (" + ", ".join(f"'{c}'" for c in T.HISTORY_COMMANDS) + ") THEN 'show_history'"
    ]
    for ftype, pattern in T.MESSAGE_RULES:
        parts.append(f"WHEN regexp_matches(m, '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{ftype}'")
    return " ".join(parts) + " END"


def _sql_ids(pattern: str) -> str:
    p = pattern.replace("(?i)", "(?i)")
    return (
        f"list_transform(flatten(list_transform(regexp_extract_all(content, '{p}', 1), "
        f"lambda g: regexp_extract_all(g, '(\\d+)', 1))), lambda n: CAST(n AS INTEGER))"
    )


SQL_CLASSIFIED = f"""typed AS (SELECT *, {_sql_rules()} AS feedback_type FROM (
  SELECT session_id, seq, content, lower(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS m FROM messages)),
classified AS (SELECT session_id, seq, content, feedback_type,
  {_sql_ids(T.ITEM_LIST)} AS item_ids,
  {_sql_ids(T.CLUSTER_LIST)} AS cluster_ids,
  CASE WHEN feedback_type = 'rename_cluster' THEN nullif(regexp_extract(content, '{T.QUOTED.replace(chr(39), chr(39) * 2)}', 1), '')
       WHEN feedback_type = 'emphasize_feature' THEN nullif(regexp_replace(regexp_extract(content, '{T.EMPHASIS_PAYLOAD}', 1), '^\\s+|\\s+$', '', 'g'), '')
  END AS text_payload,
  CASE WHEN feedback_type = 'rollback' THEN CAST(nullif(regexp_extract(content, '{T.STEP_NUMBER}', 1), '') AS INTEGER) END AS step_number
  FROM typed WHERE feedback_type IS NOT NULL)"""


def classified_messages(spark, sf):
    msgs = S.messages(spark, sf)
    return T.typed_actions(msgs.select("session_id", "seq", "content"), ["session_id", "seq", "content"])


@register(
    "classify_message",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED)
    + """SELECT seq, feedback_type, array_to_string(item_ids, ',') AS item_ids,
  array_to_string(cluster_ids, ',') AS cluster_ids, text_payload, CAST(step_number AS BIGINT) AS step_number
FROM classified""",
)
def q_classify_message(spark, sf):
    c = classified_messages(spark, sf)
    return finish(
        c.select(
            "seq", "feedback_type",
            F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",").alias("item_ids"),
            F.array_join(F.transform("cluster_ids", lambda x: x.cast("string")), ",").alias("cluster_ids"),
            "text_payload", "step_number",
        )
    )


# The fixed patterns of functions/text.py, in DuckDB's spelling of the flags.
_SPLIT, _NOISE = (p.replace("(?iU)", "(?i)") for p in (T.EMPHASIS_SPLIT, T.EMPHASIS_NOISE))
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQL_EMPH = (
    f"list_transform(string_split_regex({_TRIM.format('text_payload')}, '{_SPLIT}'), "
    + r"lambda t: regexp_replace("
    + _TRIM.format(f"regexp_replace(t, '{_NOISE}', '', 'g')")
    + r", '\s+', ' ', 'g'))"
)


@register(
    "emphasis_keywords",
    with_(SQL_FEEDBACK_LOG, SQL_MESSAGES, SQL_CLASSIFIED)
    + f""", parts AS (SELECT seq, text_payload, list_filter({SQL_EMPH}, lambda t: length(t) > 0) AS kws
  FROM classified WHERE feedback_type = 'emphasize_feature'),
kw AS (SELECT seq, CASE WHEN len(kws) > 0 THEN kws ELSE [regexp_replace(text_payload, '^\\s+|\\s+$', '', 'g')] END AS kws FROM parts)
SELECT seq, CAST(pos - 1 AS BIGINT) AS pos, lower(kws[pos]) AS keyword FROM (
  SELECT seq, kws, unnest(generate_series(1, len(kws))) AS pos FROM kw)""",
)
def q_emphasis_keywords(spark, sf):
    c = classified_messages(spark, sf).where(F.col("feedback_type") == "emphasize_feature")
    return finish(c.select("seq", F.posexplode(T.emphasis_keywords("text_payload")).alias("pos", "keyword")))


@register(
    "describe_step",
    with_(SQL_FEEDBACK_LOG)
    + """SELECT CAST(seq // 4 AS BIGINT) AS response_id,
  'Applied: ' || string_agg(feedback_type, ', ' ORDER BY seq) AS description
FROM feedback_log GROUP BY seq // 4""",
)
def q_describe_step(spark, sf):
    fl = S.feedback_log(spark, sf).withColumn("response_id", F.floor(F.col("seq") / 4).cast("bigint"))
    g = fl.groupBy("response_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "feedback_type"))), lambda e: e["feedback_type"]).alias(
            "types"
        )
    )
    return finish(g.select("response_id", T.describe_step("types").alias("description")))


# ------------------------------------------------------------------------------------------
# Corpus in (A1) and the built-in encoder (A2)
# ------------------------------------------------------------------------------------------

@register("load_items", "SELECT doc_id AS item_id, text FROM documents")
def q_load_items(spark, sf):
    return finish(S.load_items(spark, f"{sf.rstrip('/')}/documents.parquet", id_col="doc_id"))


@register(
    "encode_documents",
    f"""WITH toks AS (SELECT doc_id AS item_id, unnest({SQL_TOKENS}) AS term FROM documents),
hv AS (SELECT item_id, CAST(('0x' || substr(md5(term), 1, 6))::INTEGER AS BIGINT) AS v FROM toks),
cnt AS (SELECT item_id, v % 64 AS bucket, sum(CASE WHEN (v // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS c FROM hv GROUP BY ALL),
dense AS (SELECT d.doc_id AS item_id, r.k AS dim, coalesce(c.c, 0.0) AS x FROM documents d CROSS JOIN range(64) r(k)
  LEFT JOIN cnt c ON c.item_id = d.doc_id AND c.bucket = r.k),
nrm AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM dense GROUP BY item_id)
SELECT item_id, CAST(dim AS BIGINT) AS dim, round(x / CASE WHEN n = 0 THEN 1.0 ELSE n END, 6) AS value FROM dense JOIN nrm USING (item_id)""",
)
def q_encode_documents(spark, sf):
    from ..sources import encode as E

    docs = S.load_items(spark, f"{sf.rstrip('/')}/documents.parquet", id_col="doc_id")
    h = E.hash_encode(docs, 64)
    return finish(h.select("item_id", F.posexplode("h").alias("dim", "value")))
