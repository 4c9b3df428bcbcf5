"""Incremental link store (I5, J2): what a stream must remember of a session to resolve its links exactly.

Three facts make the state small and every batch independent of the history's length:

* the minimum spanning forest of old and new must edges is that of the old forest and the new edges
  (cycle rule), so of all must events only the forest is kept, at most one edge per item;
* a must link on a pair decides every cannot event on the same pair: an earlier one is removed by
  it, a later one ignored, since the pair was connected by then. A cannot pair lives iff it has no
  must event and one of its cannot events came before its ends were connected;
* both reasons only ever become true, so a cannot event that is dead stays dead, and only live ones
  are kept and looked at again.

Rows may come late and in any order. One case needs the set of must pairs: a cannot event older than
the session's newest must event. The set is only read for sessions of such events.

State tables are Parquet, a version per batch of the buckets (of sessions) that it touched. A batch
writes its must pairs, then its state, then the manifest (``bucket, version``, always complete): a
reader goes by the newest manifest, so a batch that stops half-way leaves the state as it was, and
one that runs again writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links as L
from ..session import cut_lineage

EVENTS = "session_id long, seq long, kind string, i long, j long"
# kind: forest (edge i, j of weight seq), cannot (live event), newest (seq of the newest must event)
STATE = "session_id long, kind string, seq long, i long, j long"
S = L.S


def fold(state: DataFrame, events: DataFrame, must_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(state, must pairs)`` of the sessions of ``events`` after them. ``state``: those sessions'
    rows before; ``must_pairs(session_id, i, j)``: the pairs known before (only looked up for
    cannot events older than a must event)."""
    pairs = cut_lineage(L.canonical_pairs(events.dropDuplicates([S, "seq", "kind", "i", "j"])).select(S, "seq", "kind", "lo", "hi"))
    must = pairs.where("kind = 'must'")
    new_pairs = must.select(S, F.col("lo").alias("i"), F.col("hi").alias("j")).distinct()
    old_edges = state.where("kind = 'forest'").select(S, F.col("i").alias("u"), F.col("j").alias("v"), F.col("seq").alias("w"))
    edges = old_edges.unionByName(must.select(S, F.col("lo").alias("u"), F.col("hi").alias("v"), F.col("seq").alias("w")))
    edges = cut_lineage(edges.groupBy(S, "u", "v").agg(F.min("w").alias("w")))
    tree, levels = L.boruvka_tree(edges)
    forest = edges.join(tree.select(S, "w").distinct(), [S, "w"], "left_semi")

    newest = state.where("kind = 'newest'").select(S, "seq").unionByName(must.select(S, "seq")).groupBy(S).agg(F.max("seq").alias("newest"))
    live = state.where("kind = 'cannot'").select(S, "seq", F.col("i").alias("lo"), F.col("j").alias("hi"))
    fresh = pairs.where("kind = 'cannot'").select(S, "seq", "lo", "hi")
    live = live.unionByName(fresh).distinct()
    key = [S, "lo", "hi"]
    live = live.join(new_pairs.toDF(*key), key, "left_anti")
    late = fresh.join(newest, S).where("seq < newest").select(S).distinct()
    known = must_pairs.join(late, S, "left_semi").toDF(*key)
    live = live.join(known, key, "left_anti")
    met = L.bottleneck(live.withColumn("a", F.col("lo")).withColumn("b", F.col("hi")), tree, levels)
    live = met.where("bottleneck is null or bottleneck > seq")

    none = F.lit(None).cast("long")
    after = (
        forest.select(S, F.lit("forest").alias("kind"), F.col("w").alias("seq"), F.col("u").alias("i"), F.col("v").alias("j"))
        .unionByName(live.select(S, F.lit("cannot").alias("kind"), "seq", F.col("lo").alias("i"), F.col("hi").alias("j")))
        .unionByName(newest.select(S, F.lit("newest").alias("kind"), F.col("newest").alias("seq"), none.alias("i"), none.alias("j")))
    )
    return after, new_pairs


class LinkStore:
    """The tables of a link store below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.state_path, self.must_path, self.manifest_path = (f"{root}/{n}" for n in ("link-state", "must-pairs", "manifest"))
        self._create(STATE, self.state_path, "version long, bucket int")
        self._create("session_id long, i long, j long", self.must_path, "version long, bucket int")
        self._create("bucket int, at long", self.manifest_path, "version long")

    def _create(self, schema: str, path: str, parts: str) -> None:
        names = [p.split()[0] for p in parts.split(", ")]
        self.spark.createDataFrame([], f"{schema}, {parts}").write.mode("ignore").partitionBy(*names).parquet(path)

    def _read(self, path: str, schema: str, parts: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, {parts}").parquet(path)

    def bucket_of(self):
        return F.pmod(F.xxhash64(S), F.lit(self.buckets)).cast("int")

    def current(self) -> dict[int, int]:
        """The version that holds each bucket (``buckets`` entries at most)."""
        rows = self._read(self.manifest_path, "bucket int, at long", "version long")
        last = rows.agg(F.max("version")).first()[0]
        return {} if last is None else {r["bucket"]: r["at"] for r in rows.where(F.col("version") == last).collect()}

    def _of(self, held: dict[int, int]) -> DataFrame:
        rows = self._read(self.state_path, STATE, "version long, bucket int")
        wanted = F.lit(False)
        for version in sorted(set(held.values())):
            wanted = wanted | ((F.col("version") == version) & F.col("bucket").isin([b for b, v in held.items() if v == version]))
        return rows.where(wanted)

    def state(self) -> DataFrame:
        return self._of(self.current()).drop("version", "bucket")

    def must_pairs(self) -> DataFrame:
        return self._read(self.must_path, "session_id long, i long, j long", "version long, bucket int")

    def add(self, events: DataFrame, version: int) -> None:
        """Takes in a batch of link events; ``version`` numbers the batches."""
        held = self.current()
        rows = cut_lineage(events.select(S, "seq", "kind", "i", "j").withColumn("bucket", self.bucket_of()))
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # <= buckets
        if not touched:
            return
        sessions = rows.select(S).distinct()
        before = self._of({b: v for b, v in held.items() if b in touched}).drop("version", "bucket")
        own = before.join(sessions, S, "left_semi")
        known = self.must_pairs().where(F.col("bucket").isin(touched) & (F.col("version") != version)).select(S, "i", "j")
        after, pairs = fold(own, rows.drop("bucket"), known)
        whole = after.unionByName(before.join(sessions, S, "left_anti"))
        dynamic = {"partitionOverwriteMode": "dynamic"}
        for table, path in ((pairs, self.must_path), (whole, self.state_path)):
            tagged = table.withColumn("version", F.lit(version).cast("long")).withColumn("bucket", self.bucket_of())
            tagged.write.mode("overwrite").options(**dynamic).partitionBy("version", "bucket").parquet(path)
        now = sorted((held | {b: version for b in touched}).items())
        manifest = self.spark.createDataFrame([(b, v, version) for b, v in now], "bucket int, at long, version long").coalesce(1)
        manifest.write.mode("overwrite").options(**dynamic).partitionBy("version").parquet(self.manifest_path)

    def links(self) -> DataFrame:
        """The resolved links: ``session_id, kind, i, j``."""
        must = self.must_pairs().select(S, F.lit("must").alias("kind"), "i", "j").distinct()
        return must.unionByName(self.state().where("kind = 'cannot'").select(S, "kind", "i", "j").distinct())
