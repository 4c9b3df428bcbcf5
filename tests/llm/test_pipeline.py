"""The pipeline's stages against brute-force versions of their decisions."""

import corpus_pipeline
from steerclust.llm import registry
from test_operators import components_of, removed


def step(spark, docs, folder, k):
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    if k < 4:
        assert out.columns == docs.columns
    return out


def test_stages(spark, docs, folder):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    rows = lambda d: order([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])
    first = step(spark, docs, folder, 0)
    assert rows(first) == [r for r in rows(docs) if r[0] not in (4, 5, 6, 12)]
    assert first.where("lang is null").count() == 0

    second = step(spark, docs, folder, 1)
    root, _ = components_of(rows(docs))
    want = {(i, t) for i, t in rows(docs) if i is None or root[i] == i}
    assert rows(second) == order(want)

    third = step(spark, docs, folder, 2)
    cut = removed(rows(docs))
    gone = {i for i, n, k, _ in cut if n and n == k}
    changed = {i for i, n, k, _ in cut if k}
    after = rows(third)
    assert {i for i, _ in after} == {i for i, _ in rows(docs)} - gone
    assert {r for r in after if r[0] not in changed} == {r for r in rows(docs) if r[0] not in changed}
    assert dict(after)[9] == "x y z <|endoftext|> q"

    fourth = step(spark, docs, folder, 3)
    bad = {r["doc_id"] for r in registry.queries()["op6_positional_index"](spark, folder).collect() if r["contaminated"]}
    assert bad and rows(fourth) == [r for r in rows(docs) if r[0] not in bad]

    last = step(spark, docs, folder, 4)
    assert {r["doc_id"] for r in last.collect()} == {i for i, _ in rows(docs)}


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.collect()}
    assert not ids & {2, 3, 4, 5, 6, 12} and 11 in ids


def test_empty(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
