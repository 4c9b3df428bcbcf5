"""Streaming jobs equal their batch twins; approximate joins reach a recall floor."""

from pyspark.sql import functions as F

from steerclust.operators import links as L
from steerclust.operators import neighbors as N
from steerclust.sources import tables as S
from steerclust.streaming import feedback_stream as FS

SF01 = "/root/testdata/sf0.01"


def test_stream_links_equals_batch(spark, tmp_path):
    ev = S.link_events(spark, SF01)
    src = FS.write_files(ev, str(tmp_path / "src"), files=5)
    path = FS.stream_links(spark, src, ev.schema, root=str(tmp_path / "out"))
    got = set(tuple(r) for r in spark.read.parquet(path).select("session_id", "kind", "i", "j").collect())
    want = set(tuple(r) for r in L.resolve_links(ev).collect())
    assert got == want and len(want) == 2811


def test_ivf_and_lsh_recall(spark):
    it = S.items(spark, SF01)
    exact = N.knn_exact(it, 10)
    cells = it.where(F.col("item_id") < 16).select(F.col("item_id").cast("int").alias("cluster_id"), F.col("z").alias("mu"))
    ivf = N.knn_ivf(it, cells, k=10, nprobe=16)
    assert N.recall_at_k(ivf, exact).first()[0] == 1.0  # probing every cell is exact
    lsh = N.knn_lsh(it, k=10, planes=4, tables=8)
    assert N.recall_at_k(lsh, exact).first()[0] >= 0.3


def test_wide_search_recall(spark):
    from steerclust.plans.registry import queries

    for sf in ("/root/testdata/sf0.001", SF01):
        found = queries()["knn_ivf_wide"](spark, sf)
        assert N.recall_at_k(found, N.knn_exact(S.items(spark, sf), 10)).first()[0] >= 0.9
