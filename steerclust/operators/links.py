"""Must/cannot link store as DataFrame jobs.

The reference applies link events one at a time; the end state has a closed form (SURVEY §2-P):

* must set = every distinct non-self must pair;
* a cannot event at time t is kept iff its endpoints are *not* connected by must events with
  seq < t, and no must event on the same pair comes after t; a pair survives iff one of its
  cannot events is kept.

"Connected using edges with seq < t" is "minimax path weight < t". That weight is read off a
Borůvka merge tree (King 1997): every round each component takes its minimum-seq incident edge,
hooks to it, and pointer-jumps to a root; the tree edge carries the seq taken. The max edge on
the tree path between two items equals the max edge on their minimum-spanning-forest path.
Rounds are O(log n); every round is a few joins and grouped minima keyed by (session, node), so
a single huge session is spread over all tasks (no per-session group, no driver state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage

S = "session_id"


def canonical_pairs(events: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """``(lo, hi) = (least, greatest)``; self pairs are dropped."""
    return events.where(F.col(a) != F.col(b)).withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))


def must_edges(events: DataFrame) -> DataFrame:
    """Distinct must pairs with the first seq at which each appeared: ``(session_id, u, v, w)``."""
    m = canonical_pairs(events.where(F.col("kind") == "must"))
    return m.groupBy(S, F.col("lo").alias("u"), F.col("hi").alias("v")).agg(F.min("seq").alias("w"))


def boruvka_tree(edges: DataFrame) -> tuple[DataFrame, int]:
    """Borůvka merge tree of a weighted graph with unique weights per session.

    ``edges``: ``(session_id, u, v, w)``. Returns ``(tree, levels)`` with tree rows
    ``(level, session_id, node, parent, w)``: node at ``level`` hooks to ``parent`` at
    ``level + 1`` through an edge of weight ``w``.
    """
    spark = edges.sparkSession
    cur = cut_lineage(edges.select(S, "u", "v", "w"))
    tree_parts = []
    level = 0
    while not cur.isEmpty():
        inc = cur.select(S, F.col("u").alias("x"), F.col("v").alias("y"), "w").unionByName(
            cur.select(S, F.col("v").alias("x"), F.col("u").alias("y"), "w")
        )
        choice = inc.groupBy(S, "x").agg(F.min(F.struct("w", "y")).alias("m")).select(
            S, "x", F.col("m.y").alias("y"), F.col("m.w").alias("w")
        )
        back = choice.select(S, F.col("x").alias("y"), F.col("y").alias("yy"))
        hooked = choice.join(back, [S, "y"], "left").select(
            S,
            "x",
            F.when((F.col("yy") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("p"),
            "w",
        )
        ptr = cut_lineage(hooked)
        while True:
            # pointer doubling: q = p(p(x)); in the same pass test whether q is already a root
            # (p(q) == q), so no extra round is needed to confirm convergence
            look = ptr.select(S, F.col("x").alias("_k"), F.col("p").alias("_v"))
            j = (
                ptr.join(look.withColumnRenamed("_k", "p").withColumnRenamed("_v", "q"), [S, "p"], "left")
                .withColumn("q", F.coalesce("q", "p"))
                .join(look.withColumnRenamed("_k", "q").withColumnRenamed("_v", "r"), [S, "q"], "left")
                .select(S, "x", F.col("q").alias("p"), "w", (F.coalesce("r", "q") != F.col("q")).alias("_open"))
            )
            j = cut_lineage(j)
            ptr = j.drop("_open")
            if j.where(F.col("_open")).isEmpty():
                break
        tree_parts.append(ptr.select(F.lit(level).alias("level"), S, F.col("x").alias("node"), F.col("p").alias("parent"), "w"))
        ru = ptr.select(S, F.col("x").alias("u"), F.col("p").alias("ru"))
        rv = ptr.select(S, F.col("x").alias("v"), F.col("p").alias("rv"))
        relabeled = cur.join(ru, [S, "u"]).join(rv, [S, "v"]).where(F.col("ru") != F.col("rv"))
        cur = cut_lineage(
            relabeled.groupBy(S, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(
                F.min("w").alias("w")
            )
        )
        level += 1
    if not tree_parts:
        empty = spark.createDataFrame([], "level int, session_id long, node long, parent long, w long")
        return empty, 0
    tree = tree_parts[0]
    for t in tree_parts[1:]:
        tree = tree.unionByName(t)
    return cut_lineage(tree), level


def bottleneck(pairs: DataFrame, tree: DataFrame, levels: int) -> DataFrame:
    """I4: for ``(session_id, a, b, …)`` the smallest possible maximum seq on a must path between
    a and b (NULL = never connected). Climbs both ends one tree level per join."""
    q = pairs.withColumn("_aa", F.col("a")).withColumn("_ab", F.col("b")).withColumn(
        "_mx", F.lit(None).cast("long")
    ).withColumn("_met", F.col("a") == F.col("b")).withColumn("_dead", F.lit(False))
    for level in range(levels):
        t = tree.where(F.col("level") == level)
        ta = t.select(S, F.col("node").alias("_aa"), F.col("parent").alias("_pa"), F.col("w").alias("_wa"))
        tb = t.select(S, F.col("node").alias("_ab"), F.col("parent").alias("_pb"), F.col("w").alias("_wb"))
        j = q.join(ta, [S, "_aa"], "left").join(tb, [S, "_ab"], "left")
        active = ~F.col("_met") & ~F.col("_dead")
        gone = active & (F.col("_pa").isNull() | F.col("_pb").isNull())
        step = active & ~gone
        q = j.select(
            *[c for c in q.columns if c not in ("_aa", "_ab", "_mx", "_met", "_dead")],
            F.when(step, F.col("_pa")).otherwise(F.col("_aa")).alias("_aa"),
            F.when(step, F.col("_pb")).otherwise(F.col("_ab")).alias("_ab"),
            F.when(step, F.greatest(F.coalesce("_mx", F.lit(-1)), "_wa", "_wb")).otherwise(F.col("_mx")).alias("_mx"),
            (F.col("_met") | (step & (F.col("_pa") == F.col("_pb")))).alias("_met"),
            (F.col("_dead") | gone).alias("_dead"),
        )
        if level % 4 == 3:
            q = cut_lineage(q)
    return q.select(
        *[c for c in pairs.columns],
        F.when(F.col("_met") & (F.col("a") != F.col("b")), F.col("_mx")).alias("bottleneck"),
    )


def cannot_events_status(events: DataFrame, tree: DataFrame | None = None, levels: int | None = None) -> DataFrame:
    """Every non-self cannot event with its fate: ``kept``, ``ignored_connected`` (endpoints
    already joined by earlier must links) or ``removed_by_must`` (same pair must-linked later)."""
    if tree is None:
        events = _materialize(events)
        tree, levels = boruvka_tree(must_edges(events))
    c = canonical_pairs(events.where(F.col("kind") == "cannot")).select(S, "seq", "lo", "hi")
    bn = bottleneck(c.withColumn("a", F.col("lo")).withColumn("b", F.col("hi")), tree, levels)
    last_must = (
        canonical_pairs(events.where(F.col("kind") == "must"))
        .groupBy(S, "lo", "hi")
        .agg(F.max("seq").alias("last_must"))
    )
    j = bn.join(last_must, [S, "lo", "hi"], "left")
    status = (
        F.when(F.col("bottleneck").isNotNull() & (F.col("bottleneck") < F.col("seq")), F.lit("ignored_connected"))
        .when(F.col("last_must").isNotNull() & (F.col("last_must") > F.col("seq")), F.lit("removed_by_must"))
        .otherwise(F.lit("kept"))
    )
    return j.select(S, "seq", "lo", "hi", status.alias("status"))


def _materialize(events: DataFrame) -> DataFrame:
    return cut_lineage(events.select(S, "seq", "kind", "i", "j"))


def resolve_links(events: DataFrame, with_tree: bool = False):
    """Exact end state of the sequential store: ``(session_id, kind, i, j)`` with i < j.
    ``with_tree=True`` also returns the merge tree and its depth for reuse."""
    events = _materialize(events)
    tree, levels = boruvka_tree(must_edges(events))
    must = must_edges(events).select(S, F.lit("must").alias("kind"), F.col("u").alias("i"), F.col("v").alias("j"))
    st = cannot_events_status(events, tree, levels)
    cannot = (
        st.where(F.col("status") == "kept")
        .select(S, F.lit("cannot").alias("kind"), F.col("lo").alias("i"), F.col("hi").alias("j"))
        .distinct()
    )
    out = must.unionByName(cannot)
    return (out, tree, levels) if with_tree else out


def must_link_components(events: DataFrame, tree: DataFrame | None = None, levels: int | None = None) -> DataFrame:
    """Connected components of the must graph per session: ``(session_id, item, component)``
    with component = smallest item id; items without must links are not nodes. A merge tree
    already built for the same events can be passed in."""
    edges = cut_lineage(must_edges(events))
    if tree is None:
        tree, levels = boruvka_tree(edges)
    nodes = edges.select(S, F.col("u").alias("item")).unionByName(edges.select(S, F.col("v").alias("item"))).distinct()
    cur = nodes.withColumn("anc", F.col("item"))
    for level in range(levels):
        t = tree.where(F.col("level") == level).select(S, F.col("node").alias("anc"), F.col("parent").alias("_p"))
        cur = cur.join(t, [S, "anc"], "left").select(S, "item", F.coalesce("_p", "anc").alias("anc"))
        if level % 4 == 3:
            cur = cut_lineage(cur)
    comp = cur.groupBy(S, "anc").agg(F.min("item").alias("component"))
    return cur.join(comp, [S, "anc"]).select(S, "item", "component")


def latent_conflicts(links: DataFrame, events: DataFrame) -> DataFrame:
    """Cannot links kept by the order rule whose endpoints *are* connected by the final must set
    (the reference does not re-check them)."""
    events = _materialize(events)
    tree, levels = boruvka_tree(must_edges(events))
    c = links.where(F.col("kind") == "cannot").select(S, F.col("i").alias("a"), F.col("j").alias("b"))
    bn = bottleneck(c, tree, levels)
    return bn.where(F.col("bottleneck").isNotNull()).select(S, F.col("a").alias("i"), F.col("b").alias("j"), "bottleneck")


# ------------------------------------------------------------------------------------------
# Constraint evaluation against an assignment and vectors
# ------------------------------------------------------------------------------------------

def _with_endpoints(links: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    a = table.select(F.col("item_id").alias("i"), *[F.col(c).alias(c + "_i") for c in cols])
    b = table.select(F.col("item_id").alias("j"), *[F.col(c).alias(c + "_j") for c in cols])
    return links.join(a, "i").join(b, "j")


def constraint_satisfaction(links: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of must pairs with equal labels and cannot pairs with different ones; no pairs → 1.0."""
    keys = keys or []
    j = _with_endpoints(links, labels, ["cluster_id"])
    same = F.col("cluster_id_i") == F.col("cluster_id_j")
    must, cannot = F.col("kind") == "must", F.col("kind") == "cannot"
    agg = j.groupBy(*keys).agg(
        F.count(F.when(must, 1)).alias("total_must_links"),
        F.count(F.when(cannot, 1)).alias("total_cannot_links"),
        F.count(F.when(must & same, 1)).alias("satisfied_must_links"),
        F.count(F.when(cannot & ~same, 1)).alias("satisfied_cannot_links"),
    )
    return agg.select(
        *keys,
        "total_must_links",
        "total_cannot_links",
        "satisfied_must_links",
        "satisfied_cannot_links",
        F.when(F.col("total_must_links") > 0, F.col("satisfied_must_links") / F.col("total_must_links"))
        .otherwise(F.lit(1.0))
        .alias("must_link_satisfaction"),
        F.when(F.col("total_cannot_links") > 0, F.col("satisfied_cannot_links") / F.col("total_cannot_links"))
        .otherwise(F.lit(1.0))
        .alias("cannot_link_satisfaction"),
    )


def link_distances(links: DataFrame, vectors: DataFrame, vec: str = "heads") -> DataFrame:
    """Per link the learned distance (min over heads; plain Euclidean for flat vectors)."""
    j = _with_endpoints(links, vectors, [vec])
    multi = isinstance(vectors.schema[vec].dataType.elementType, type(vectors.schema[vec].dataType))
    d = V.head_min_distance(vec + "_i", vec + "_j") if multi else V.euclidean(vec + "_i", vec + "_j")
    return j.select(*links.columns, d.alias("distance"))


def constraint_distances(links: DataFrame, vectors: DataFrame, vec: str = "heads", keys: list[str] | None = None) -> DataFrame:
    """Mean learned distance of must and cannot pairs and their ratio (separation).
    Separation: must avg 0 → +inf if cannot avg > 0 else 1.0; NULL if either side is empty."""
    keys = keys or []
    d = link_distances(links, vectors, vec)
    agg = d.groupBy(*keys).agg(
        F.avg(F.when(F.col("kind") == "must", F.col("distance"))).alias("avg_must_link_distance"),
        F.avg(F.when(F.col("kind") == "cannot", F.col("distance"))).alias("avg_cannot_link_distance"),
    )
    m, c = F.col("avg_must_link_distance"), F.col("avg_cannot_link_distance")
    sep = (
        F.when(m.isNull() | c.isNull(), F.lit(None).cast("double"))
        .when(m > 0, c / m)
        .when(c > 0, F.lit(float("inf")))
        .otherwise(F.lit(1.0))
    )
    return agg.select(*keys, m, c, sep.alias("constraint_separation_score"))


def constraint_improvements(links: DataFrame, baseline: DataFrame, current: DataFrame, vec: str = "heads") -> DataFrame:
    """C11: per link baseline vs current learned distance; improvement = baseline − current for
    must, current − baseline for cannot."""
    b = link_distances(links, baseline, vec).withColumnRenamed("distance", "baseline_distance")
    c = link_distances(links, current, vec).withColumnRenamed("distance", "current_distance")
    j = b.join(c, links.columns)
    imp = F.when(F.col("kind") == "must", F.col("baseline_distance") - F.col("current_distance")).otherwise(
        F.col("current_distance") - F.col("baseline_distance")
    )
    return j.withColumn("improvement", imp)
