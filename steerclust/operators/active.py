"""Active learning: candidate pool (G1, F2), dedupe (G2), asked items (G3, B6), questions.

The pool is bounded by construction (top_items + top_pairs + top_clusters rows), so its final
ordering windows run over a handful of rows; everything that feeds it (uncertainty scores,
boundary pairs, cluster variances) is a distributed job over the whole item table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..session import cut_lineage
from . import centroids as C
from . import neighbors as N
from . import uncertainty as U

BRANCH_ORDER = {"item_uncertain": 0, "pair_boundary": 1, "cluster_high_variance": 2}


def _excerpts(items_text: DataFrame) -> DataFrame:
    return items_text.select("item_id", T.excerpt("text").alias("excerpt"))


def candidate_pool(
    items: DataFrame,
    texts: DataFrame,
    cents: DataFrame,
    top_items: int = 6,
    top_pairs: int = 6,
    top_clusters: int = 3,
    vec: str = "z",
    dedupe: bool = True,
) -> DataFrame:
    """G1: uncertain items, boundary pairs (search-based), high-variance clusters — in that order —
    with metrics, display text and a ``position``; then G2: first candidate per display text.
    ``texts(item_id, text)`` only supplies display excerpts (left joins: items without text stay)."""
    it = items.select("item_id", "cluster_id", vec)
    ex = _excerpts(texts)
    scores = U.item_uncertainty(it, cents)
    w_u = Window.orderBy(*U.uncertain_order())  # bounded by the limit below
    top = U.top_uncertain_items(scores, 2 * top_pairs).withColumn("urank", F.row_number().over(w_u) - 1)

    items = (
        top.where(F.col("urank") < top_items)
        .join(ex, "item_id", "left")
        .select(
            F.lit("item_uncertain").alias("type"),
            F.col("urank").alias("rank"),
            F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("candidate_id"),
            F.array(F.col("item_id")).alias("ids"),
            F.array(F.col("cluster_id")).alias("clusters"),
            F.col("excerpt").alias("text"),
            F.lit(None).cast("array<string>").alias("texts"),
            F.lit(None).cast("array<string>").alias("examples"),
            F.col("dist_to_centroid").alias("metric_1"),
            F.col("margin").alias("metric_2"),
        )
    )

    seeds = top.where(F.col("urank") < 10).select(F.col("item_id").alias("seed_id"), F.col("urank").alias("seed_rank"))
    bp = N.boundary_pairs_knn(it, seeds, max_pairs=2 * top_pairs, vec=vec).where(F.col("pair_rank") <= top_pairs)
    lab = it.select("item_id", "cluster_id")
    pairs = (
        bp.join(ex.select(F.col("item_id").alias("i"), F.col("excerpt").alias("ti")), "i", "left")
        .join(ex.select(F.col("item_id").alias("j"), F.col("excerpt").alias("tj")), "j", "left")
        .join(lab.select(F.col("item_id").alias("i"), F.col("cluster_id").alias("ci")), "i")
        .join(lab.select(F.col("item_id").alias("j"), F.col("cluster_id").alias("cj")), "j")
        .select(
            F.lit("pair_boundary").alias("type"),
            (F.col("pair_rank") - 1).alias("rank"),
            F.concat(F.lit("pair_"), F.col("i").cast("string"), F.lit("_"), F.col("j").cast("string")).alias("candidate_id"),
            F.array("i", "j").alias("ids"),
            F.array("ci", "cj").alias("clusters"),
            F.lit(None).cast("string").alias("text"),
            F.array("ti", "tj").alias("texts"),
            F.lit(None).cast("array<string>").alias("examples"),
            F.col("distance").alias("metric_1"),
            F.lit(None).cast("double").alias("metric_2"),
        )
    )

    hv = C.high_variance_clusters(it, cents, 0.8, vec)
    w_c = Window.orderBy("cluster_id")  # at most K rows
    hv = hv.withColumn("crank", F.row_number().over(w_c) - 1).where(F.col("crank") < top_clusters)
    w_e = Window.partitionBy("cluster_id").orderBy("item_id")
    examples = (
        it.select("item_id", "cluster_id")
        .join(hv.select("cluster_id"), "cluster_id", "left_semi")
        .withColumn("er", F.row_number().over(w_e))
        .where(F.col("er") <= 3)
        .join(ex, "item_id", "left")
        .groupBy("cluster_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("er", "excerpt"))), lambda e: e["excerpt"]).alias("examples"))
    )
    clusters = hv.join(examples, "cluster_id", "left").select(
        F.lit("cluster_high_variance").alias("type"),
        F.col("crank").alias("rank"),
        F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")).alias("candidate_id"),
        F.array().cast("array<bigint>").alias("ids"),
        F.array(F.col("cluster_id")).alias("clusters"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("array<string>").alias("texts"),
        "examples",
        F.col("variance").alias("metric_1"),
        F.col("size").cast("double").alias("metric_2"),
    )
    branch = F.create_map(*[x for k, v in BRANCH_ORDER.items() for x in (F.lit(k), F.lit(v))])
    pool = items.unionByName(pairs).unionByName(clusters).withColumn("branch", branch[F.col("type")])
    pool = pool.withColumn("display_key", F.coalesce(F.col("text"), F.to_json("texts"), F.to_json("examples")))
    w = Window.orderBy("branch", "rank")  # bounded pool
    pool = pool.withColumn("position", F.row_number().over(w) - 1)
    if not dedupe:
        return pool
    first = Window.partitionBy("display_key").orderBy("position")
    return pool.withColumn("_k", F.row_number().over(first)).where(F.col("_k") == 1).drop("_k")


def asked_items(*surfaced: DataFrame) -> DataFrame:
    """Union of the item ids already surfaced in questions (``item_id`` columns)."""
    u = surfaced[0].select("item_id")
    for s in surfaced[1:]:
        u = u.unionByName(s.select("item_id"))
    return u.distinct()


def exclude_already_asked(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """Drop a candidate whose id set is non-empty and wholly asked; clusters (no ids) stay;
    if that drops everything, keep the pool unfiltered."""
    ex = pool.select("candidate_id", F.explode("ids").alias("item_id"))
    flagged = ex.join(asked.withColumn("_a", F.lit(1)), "item_id", "left").groupBy("candidate_id").agg(
        F.min(F.coalesce("_a", F.lit(0))).alias("_all_asked")
    )
    p = pool.join(flagged, "candidate_id", "left").withColumn(
        "_drop", F.coalesce(F.col("_all_asked") == 1, F.lit(False)) & (F.size("ids") > 0)
    )
    w = Window.partitionBy()  # bounded pool
    p = p.withColumn("_kept", F.sum(F.when(~F.col("_drop"), 1).otherwise(0)).over(w))
    return p.where(~F.col("_drop") | (F.col("_kept") == 0)).drop("_all_asked", "_drop", "_kept")


def propose_questions(pool: DataFrame, max_questions: int = 3) -> DataFrame:
    """G5 + F3 (default rule, no model): round-robin over the three branches by rank; a candidate
    that shares an item id with an earlier one in that order is skipped; at most
    ``max_questions``. Adds ``question_rank``."""
    return _pick(pool, Window.orderBy("rank", "branch"), max_questions)  # bounded pool


def rank_with(pool: DataFrame, make_ranker: Callable[[], Callable[[pd.DataFrame], np.ndarray]], max_questions: int = 3) -> DataFrame:
    """G5 with a plug-in question ranker: ``make_ranker()`` is called once per Python worker and
    gives each row of a batch of candidates a score (null: not asked). The best come first, ties in
    the default order; no item is used twice. Adds ``ranker_score`` and ``question_rank``."""
    schema = ST.StructType([*pool.schema.fields, ST.StructField("ranker_score", ST.DoubleType())])

    def run(batches):
        score = make_ranker()
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(ranker_score=np.asarray(score(pdf), dtype=np.float64))

    scored = pool.mapInPandas(run, schema).where("ranker_score is not null and not isnan(ranker_score)")
    return _pick(scored, Window.orderBy(F.desc("ranker_score"), "rank", "branch"), max_questions)


def _pick(pool: DataFrame, order: WindowSpec, max_questions: int) -> DataFrame:
    # the pool is a handful of rows behind a long plan, and is read three times below
    p = cut_lineage(pool.withColumn("rr", F.row_number().over(order)))
    ids = p.select("candidate_id", "rr", F.explode("ids").alias("item_id"))
    first_use = ids.groupBy("item_id").agg(F.min("rr").alias("first_rr"))
    clash = ids.join(first_use, "item_id").where(F.col("first_rr") < F.col("rr")).select("candidate_id").distinct()
    ok = p.join(clash, "candidate_id", "left_anti")
    w_q = Window.orderBy("rr")
    return ok.withColumn("question_rank", F.row_number().over(w_q)).where(F.col("question_rank") <= max_questions)
