"""Table sources and the deterministic derived views every query starts from.

All views are plain DataFrame transformations of the driver tables, so Catalyst prunes
columns and pushes filters into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_items(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_col: str | None = "item_id",
    text_col: str = "text",
    order_by: list[str] | None = None,
    **options,
) -> DataFrame:
    """A1: corpus in as ``(item_id BIGINT, text STRING)``.

    An explicit id column is required; without one the caller names a stable order and ids are
    places in it from 0 (never ``monotonically_increasing_id``, which changes on retry).
    """
    reader = spark.read.options(**options)
    df = reader.format(fmt).load(path)
    if fmt == "text" and text_col not in df.columns:
        df = df.withColumnRenamed("value", text_col)
    if id_col and id_col in df.columns:
        return df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    if not order_by:
        raise ValueError("load_items needs an id column or an explicit order_by for positional ids")
    # rows sorted into ranges, numbered within each, plus the size of all ranges before it
    ranged = cut_lineage(df.repartitionByRange(*order_by).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row per shuffle partition
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order_by))
    numbered = ranged.withColumn("_place", place).join(before, "_range")
    return numbered.select((F.col("_before") + F.col("_place") - 1).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))


# ---------------------------------------------------------------------------------------------
# Derived views (FIXTURES §3); the DuckDB oracle bodies in plans/oracle.py mirror these.
# ---------------------------------------------------------------------------------------------

def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, cluster_id, z)`` from ``embeddings``; the label is the given assignment."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("item_id"),
        F.col("label").cast("int").alias("cluster_id"),
        V.as_double_array("embedding").alias("z"),
    )


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items joined to their document text (``doc_id = vec_id``)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return items(spark, sf_dir).join(d, "item_id")


def heads(spark: SparkSession, sf_dir: str, num_heads: int = 2) -> DataFrame:
    """Multi-head view ``(item_id, cluster_id, heads ARRAY<ARRAY<DOUBLE>>)``, each head unit norm."""
    it = items(spark, sf_dir)
    return it.select(
        "item_id", "cluster_id", V.normalize_heads(V.split_heads("z", num_heads)).alias("heads")
    )


def prev_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("item_id"),
        ((F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)) % 10).cast("int").alias("cluster_id"),
    )


def doc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"),
        (F.col("doc_id") % 5).cast("int").alias("cluster_id"),
        "lang",
        "text",
    )


FEEDBACK_LOG_SQL = """
SELECT user_id AS session_id, event_id AS seq,
       CASE event_type WHEN 'click' THEN 'must_link' WHEN 'error' THEN 'cannot_link'
            WHEN 'view' THEN 'miscluster' WHEN 'signup' THEN 'emphasize_feature'
            ELSE 'assign_outlier' END AS feedback_type,
       (event_id * 13 + user_id) % 40 AS a, (event_id * 29 + 7) % 40 AS b
FROM events
"""


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed feedback events derived from ``events`` (one pair ``a, b`` per event)."""
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return ev.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.when(t == "click", "must_link")
        .when(t == "error", "cannot_link")
        .when(t == "view", "miscluster")
        .when(t == "signup", "emphasize_feature")
        .otherwise("assign_outlier")
        .alias("feedback_type"),
        ((F.col("event_id") * 13 + F.col("user_id")) % 40).alias("a"),
        ((F.col("event_id") * 29 + 7) % 40).alias("b"),
        "ts",
    )


def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """must/cannot events of the feedback log as ``(session_id, seq, kind, i, j)``."""
    fl = feedback_log(spark, sf_dir)
    return fl.where(F.col("feedback_type").isin("must_link", "cannot_link")).select(
        "session_id",
        "seq",
        F.when(F.col("feedback_type") == "must_link", "must").otherwise("cannot").alias("kind"),
        F.col("a").alias("i"),
        F.col("b").alias("j"),
    )


# Fixed values (message fixture): concept words used to build emphasis messages.
CONCEPT_WORDS = ("genre", "tone", "mystery", "suspense", "action", "comedy", "drama", "thriller")


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename events: every 'purchase' event names cluster ``event_id % 7`` after its user."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(
        (F.col("event_id") % 7).cast("int").alias("cluster_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("Topic "), F.col("user_id").cast("string")).alias("label"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat message per event, built from the event's ids and a trigger phrase."""
    # one scan: the pair columns are the feedback-log formulas (no self-join of events)
    fl = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        "event_type",
        ((F.col("event_id") * 13 + F.col("user_id")) % 40).alias("a"),
        ((F.col("event_id") * 29 + 7) % 40).alias("b"),
    )
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    a10, b10 = (F.col("a") % 10).cast("string"), (F.col("b") % 10).cast("string")
    words = F.array(*[F.lit(w) for w in CONCEPT_WORDS])
    wa = F.element_at(words, (F.col("a") % 8 + 1).cast("int"))
    wb = F.element_at(words, (F.col("b") % 8 + 1).cast("int"))
    odd = F.col("seq") % 2 == 1
    t = F.col("event_type")
    content = (
        F.when((t == "click") & ~odd, F.concat(F.lit("Items "), a, F.lit(" and "), b, F.lit(" should be in the same cluster.")))
        .when(t == "click", F.concat(F.lit("Clusters "), a10, F.lit(" and "), b10, F.lit(" should be merged.")))
        .when((t == "error") & ~odd, F.concat(F.lit("Keep apart item "), a, F.lit(" from item "), b, F.lit(".")))
        .when(t == "error", F.concat(F.lit("Please divide cluster "), a10, F.lit(": its texts are about two things.")))
        .when((t == "view") & ~odd, F.concat(F.lit("Item "), a, F.lit(" seems to be in the wrong cluster.")))
        .when(t == "view", F.concat(F.lit("Please rename cluster "), a10, F.lit(" to 'Topic "), b, F.lit("'.")))
        .when((t == "signup") & ~odd, F.concat(F.lit("Emphasize "), wa, F.lit(" and "), wb, F.lit(" elements when clustering.")))
        .when(t == "signup", F.concat(F.lit("Focus on "), wa, F.lit(", "), wb, F.lit(" or tone.")))
        .when(~odd, F.concat(F.lit("Move outlier item "), a, F.lit(" to cluster "), b10, F.lit(".")))
        .when(F.col("a") % 3 == 0, F.concat(F.lit("Roll back to step "), b10, F.lit(".")))
        .when(F.col("a") % 3 == 1, F.lit("show history"))
        .otherwise(F.lit("Please start over."))
    )
    return fl.select("session_id", "seq", F.lit("user").alias("role"), content.alias("content"))
