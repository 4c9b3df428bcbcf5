"""The incremental link store against the batch job and a sequential replay; what a batch reads."""

import random

import pytest

from steerclust.operators import links as L
from steerclust.streaming import feedback_stream as FS
from steerclust.streaming.link_state import EVENTS, LinkStore


def replayed(events):
    """One event after another, as the store is defined."""
    links = {}
    for session in {e[0] for e in events}:
        must, cannot, group = set(), set(), {}
        find = lambda x, g=group: x if g.get(x, x) == x else find(g[x])  # noqa: E731, B023
        for _, _, kind, i, j in sorted(e for e in events if e[0] == session):
            pair = (min(i, j), max(i, j))
            if i == j:
                continue
            if kind == "must":
                must.add(pair)
                cannot.discard(pair)
                group[find(i)] = find(j)
            elif find(i) != find(j):
                cannot.add(pair)
        links[session] = {("must", *p) for p in must} | {("cannot", *p) for p in cannot}
    return {(s, *x) for s, v in links.items() for x in v}


def some_events(rng, sessions, many, items):
    return [
        (s, 10 * k + rng.randrange(10), rng.choice(["must", "cannot", "cannot"]), rng.randrange(items), rng.randrange(items))
        for s in range(sessions)
        for k in range(many)
    ]


def got(store):
    return {tuple(r) for r in store.links().collect()}


@pytest.mark.parametrize("seed", [1])
def test_batches_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = some_events(rng, 4, 30, 12)
    rng.shuffle(events)
    store = LinkStore(spark, str(tmp_path), buckets=3)
    for version, lo in enumerate(range(0, len(events), 40)):
        batch = events[lo : lo + 40] + events[:3]  # some rows come twice
        store.add(spark.createDataFrame(batch, EVENTS), version)
        if version == 1:
            store.add(spark.createDataFrame(batch, EVENTS), version)  # a batch that is run again
            assert got(store) == replayed(events[: lo + 40])
    assert got(store) == replayed(events)
    assert got(store) == {tuple(r) for r in L.resolve_links(spark.createDataFrame(events, EVENTS)).collect()}


def test_a_batch_that_stops_half_way_changes_nothing(spark, tmp_path):
    store = LinkStore(spark, str(tmp_path), buckets=2)
    store.add(spark.createDataFrame([(1, 1, "must", 1, 2), (1, 2, "cannot", 3, 4)], EVENTS), 0)
    before, held = got(store), store.current()
    later = spark.createDataFrame([(1, 0, "must", 3, 4)], EVENTS)
    store.add(later, 1)
    manifest = spark.read.parquet(store.manifest_path)
    assert manifest.where("version = 0").count() == len(held)
    store.current = lambda: held  # as a reader that finds no manifest of the second batch
    assert {x for x in got(store) if x[1] == "cannot"} == {x for x in before if x[1] == "cannot"}
    del store.current
    assert got(store) == {(1, "must", 1, 2), (1, "must", 3, 4)}


def test_state_does_not_grow_with_history(spark, tmp_path):
    rng = random.Random(3)
    items, store, sizes = 15, LinkStore(spark, str(tmp_path), buckets=1), []
    for version in range(3):
        batch = [(1, 1000 * version + k, "must" if k % 3 else "cannot", rng.randrange(items), rng.randrange(items)) for k in range(200)]
        store.add(spark.createDataFrame(batch, EVENTS), version)
        sizes.append({r["kind"]: r["count"] for r in store.state().groupBy("kind").count().collect()})
    assert all(s["forest"] == items - 1 and s["newest"] == 1 for s in sizes)
    assert len({s.get("cannot", 0) for s in sizes}) == 1  # all items were connected after the first batch


def test_stream_of_files_in_any_order(spark, tmp_path):
    events = some_events(random.Random(7), 5, 30, 10)
    src = FS.write_files(spark.createDataFrame(events, EVENTS), str(tmp_path / "src"), files=6)
    path = FS.stream_links(spark, src, spark.createDataFrame([], EVENTS).schema, root=str(tmp_path / "out"), buckets=4, max_files_per_trigger=2)
    assert {tuple(r) for r in spark.read.parquet(path).select("session_id", "kind", "i", "j").collect()} == replayed(events)


def test_empty_batch(spark, tmp_path):
    store = LinkStore(spark, str(tmp_path))
    store.add(spark.createDataFrame([], EVENTS), 0)
    store.add(spark.createDataFrame([(1, 1, "must", 5, 5)], EVENTS), 1)
    assert got(store) == set()
