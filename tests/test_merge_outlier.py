"""Merge anchors pair min(3, |c1|, |c2|) members; outliers link to the first three members."""

from steerclust.operators import feedback as FB

COLS = "session_id long, seq long, feedback_type string, item_ids array<int>, cluster_ids array<int>, text_payload string, step_number int, reason string, confidence double"


def test_merge_and_outlier_links(spark):
    labels = spark.createDataFrame([(i, 0 if i < 5 else 1) for i in range(7)], "item_id long, cluster_id int")
    acts = spark.createDataFrame(
        [(1, 1, "merge_clusters", None, [0, 1], None, None, None, 1.0), (1, 2, "assign_outlier", [6], [0], None, None, None, 1.0)],
        COLS,
    )
    t = FB.apply_actions(acts, labels)
    rows = t["links"].orderBy("seq").collect()
    merge = [r for r in rows if r["seq"] // FB.SUB_ORDER == 1]
    outl = [r for r in rows if r["seq"] // FB.SUB_ORDER == 2]
    assert len(merge) == 2  # min(3, 5, 2)
    assert {r["j"] for r in merge} == {5, 6} and all(r["i"] < 5 for r in merge)
    assert [(r["i"], r["j"]) for r in outl] == [(6, 0), (6, 1), (6, 2)]
    again = FB.apply_actions(acts, labels)["links"].orderBy("seq").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]
