"""Rounds with many centres, simple texts read in Python, and gradients of a round's loss."""

import numpy as np
from pyspark.sql import functions as F

from steerclust.functions import text as TX
from steerclust.operators import keywords as K
from steerclust.operators import kmeans as KM
from steerclust.sources import encode as E

TEXTS = ["Straße café_9 a bb ÀÉ x² İstanbul ΣΑΣ", None, "", "plain words and WORDS 12 3", "É na‍me ½ x_y", "¿Qué tal, año ñandú? µm", "dup dup dup"]


def test_simple_texts_have_the_tokens_of_catalyst(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string")
    want = {r["item_id"]: r["t"] or [] for r in docs.select("item_id", TX.tokens("text").alias("t")).collect()}
    simple = {i: TX.simple_tokens(t) for i, t in enumerate(TEXTS)}
    assert {i for i, t in simple.items() if t is None} == {0, 4, 5}  # left to Catalyst
    assert all(simple[i] == want[i] for i in simple if simple[i] is not None)
    counts = {(r["item_id"], r["term"]): r["n"] for r in K.term_counts(docs, ["item_id"], stop_words=["and"]).collect()}
    assert counts == {(i, w): t.count(w) for i, t in want.items() for w in t if w != "and"}
    again = {r["item_id"]: r["h"] for r in E.hash_encode(docs, 16).collect()}
    for i, t in want.items():
        alone = spark.createDataFrame([(0, " ".join(t))], "item_id long, text string")
        np.testing.assert_allclose(again[i], E.hash_encode(alone, 16).first()["h"])


def test_rounds_that_meet_moved_centres_only_equal_whole_rounds():
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(size=(400, 6)).round(1), np.zeros((4, 6))])
    old, ids = X[:60].copy(), np.arange(60)[::-1].copy()
    old[7] = old[3]  # equal centres: the lowest id
    state = None
    new = old
    for step in range(4):
        search = KM.Search(ids, None if state is None else old, new)
        search.start()
        at, dist = search.of(X, state)
        k, d = KM.Nearest(new, ids).of(X)
        assert (ids[at] == k).all() and np.allclose(dist, d)
        state, old, new = (at, dist), new, new.copy()
        new[step * 5 : step * 5 + 9] += rng.normal(size=(9, 6)) / 3
        new[3] = new[7]


def test_single_precision_scores_leave_the_nearest(monkeypatch):
    rng = np.random.default_rng(2)
    C = rng.normal(size=(300, 16))
    C[1::2] = C[::2] + 1e-9 * rng.normal(size=(150, 16))  # told apart in double precision only
    X = C + 1e-10 * rng.normal(size=C.shape)
    single = KM.Nearest(C, np.arange(300))
    assert single.scored.dtype == np.float32
    monkeypatch.setattr(KM, "SINGLE_CENTRES", 1000)
    assert (single.of(X)[0] == KM.Nearest(C, np.arange(300)).of(X)[0]).all()


def test_lloyd_with_many_centres(spark, monkeypatch):
    X = np.random.default_rng(3).normal(size=(900, 4)).round(1)
    pts = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "item_id long, z array<double>")
    start, ids = {0: X[:300].copy()}, np.arange(300)
    monkeypatch.setattr(KM, "CARRIED", 3)
    many = KM.lloyd_rounds(pts, ids, start, 30, 1e-6, "z")
    monkeypatch.setattr(KM, "SINGLE_CENTRES", 1000)
    whole = KM.lloyd_rounds(pts, ids, start, 30, 1e-6, "z")
    np.testing.assert_allclose(many[0][0], whole[0][0])
    assert many[2] == whole[2] and np.isclose(many[1][0], whole[1][0])
    assert (start[0] == X[:300]).all()


def test_rows_of_repeated_items_in_the_loss(spark):
    """An item that comes twice meets both of its clusters, as in a join."""
    from steerclust.operators import metric as M

    rng = np.random.default_rng(4)
    H = rng.normal(size=(12, 5))
    ids = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None]
    base = spark.createDataFrame([(i, h.tolist()) for i, h in zip(ids, H)], "item_id long, h array<double>")
    assign = spark.createDataFrame([(i, n % 3 if n != 4 else None) for n, i in enumerate(ids)], "item_id long, cluster_id int")
    W, b = M.init_adapter(2, 5)
    cents = spark.createDataFrame([(k, rng.normal(size=(2, 5)).tolist()) for k in range(2)], "cluster_id int, mu array<array<double>>")
    links = spark.createDataFrame([("must", 0, 1), ("cannot", 2, 5), ("cannot", 0, 99)], "kind string, i long, j long")
    args = {
        "links": links, "flags": spark.createDataFrame([(0,), (0,), (6,)], "item_id long"), "splits": spark.createDataFrame([(0,), (9,), (None,)], "cluster_id int"),
        "labels_h": spark.createDataFrame([(1, H[3].tolist()), (8, H[4].tolist())], "cluster_id int, label_h array<double>"),
        "keywords_h": spark.createDataFrame([("x", H[5].tolist()), ("y", H[6].tolist())], "keyword string, kw_h array<double>"),
    }
    loss, vals, dW, db = M.loss_and_grad(base, W, b, assign, cents, **args)
    assert np.isclose(loss, M.loss_only(base, W, b, assign, cents, **args))
    rows = base.where(F.col("item_id").isNotNull()).join(assign, "item_id").where("cluster_id in (0, 1)").count()
    assert rows > 8 and set(vals) == {"cluster", "must_link", "cannot_link", "miscluster", "cluster_split", "concept", "keyword"}
