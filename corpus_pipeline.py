"""The training-corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)`` and returns a table that
is written as Parquet and read again as the next stage's documents. All but the last keep the
columns of ``docs``, whatever further columns there are. ``run`` applies them to ``documents``.

Defined results: rows with null text have no language and go in the first stage; where no row has a
usable language, that stage keeps every text with a letter; the near-dedup stage judges each text by
itself, also where several texts share an id, and keeps one of rows that repeat; rows without id
pass the dedup stages unchanged; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steerclust.llm import cost_packing, language_id, odd_sketch_dedup, positional_index, substring_dedup
from steerclust.llm.common import materialize, prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` under names of our own, so that no column of theirs can clash: ``c0, c1, ...`` and
    the row key ``_id``, ``_hash`` (hash of the text, as the operators give it)."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{names.index('text')}"), F.lit(""))
    return plain.withColumn("_id", F.col(f"c{names.index('doc_id')}").cast("long")).withColumn("_hash", F.xxhash64(text)), names


def _named(plain: DataFrame, names: list[str]) -> DataFrame:
    return plain.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language stay; a missing language is filled in."""
    prepare(spark)
    model = language_id.fit(docs)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    if not model.languages:
        return _named(plain.where(F.col(f"c{names.index('text')}").rlike("\\p{L}")), names)
    known = language_id.predict(plain, model, f"c{names.index('text')}").where(F.col("lang_pred") != language_id.UNKNOWN)
    lang = f"c{names.index('lang')}"
    return _named(known.withColumn(lang, F.coalesce(F.col(lang), F.col("lang_pred"))), names)


def _with_nodes(plain: DataFrame) -> DataFrame:
    """``plain`` with ``_node``: the id, but a number of its own for each text where several texts
    have that id. These numbers lie above all ids (below, if there is no room)."""
    keys = plain.select("_id", "_hash").distinct()
    several = keys.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id")
    shared = keys.join(several, "_id", "left_semi").repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash")
    shared = materialize(shared.withColumn("_rank", F.monotonically_increasing_id()), "shared-ids")
    if shared.isEmpty():
        return plain.withColumn("_node", F.col("_id"))
    low, high = plain.agg(F.min("_id"), F.max("_id")).first()
    first = high + 1 if high < 1 << 62 else low - (1 << 62)
    shared = shared.select("_id", "_hash", (F.lit(first) + F.col("_rank")).alias("_own"))
    return plain.join(shared, ["_id", "_hash"], "left").withColumn("_node", F.coalesce("_own", "_id")).drop("_own")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    keyed, names = _keyed(docs)
    plain = _with_nodes(keyed.where(F.col("_id").isNotNull()))
    text = f"c{names.index('text')}"
    found = odd_sketch_dedup.near_duplicates(plain.select("_node", text), "_node", text).where("kept")
    keys = found.select(F.col("doc_id").alias("_node")).distinct()
    chosen = plain.join(keys, "_node", "left_semi").dropDuplicates(["_node"]).select(*keyed.columns)
    return _named(chosen.union(keyed.where(F.col("_id").isNull())), names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from texts; documents of nothing else go."""
    found = substring_dedup.substring_dedup(docs).where("n_removed > 0")
    cut = materialize(
        found.select(
            F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "kept_text", (F.col("n_removed") == F.col("n_words")).alias("gone")
        ).dropDuplicates(["_id", "_hash"]),
        "cut",
    )
    plain, names = _keyed(docs)
    text, chars = f"c{names.index('text')}", f"c{names.index('n_chars')}"
    joined = plain.join(cut, ["_id", "_hash"], "left").where("gone is null or not gone")
    joined = joined.withColumn(chars, F.when(F.col("gone").isNull(), F.col(chars)).otherwise(F.length("kept_text").cast("long")))
    return _named(joined.withColumn(text, F.coalesce("kept_text", text)), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding benchmark passages go."""
    found = positional_index.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = materialize(found.where("contaminated").select("doc_id", "row_hash").distinct(), "contaminated")
    plain, names = _keyed(docs)
    clean = plain.join(bad, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("row_hash")), "left_anti")
    return _named(clean, names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens."""
    return cost_packing.packed(docs).drop("row_hash")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_identified),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Packing counts the tokens of a vocabulary file, which SQL cannot express; the stages are tested
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
