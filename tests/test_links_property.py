"""The order-exact link rule against a direct sequential replay of the store."""

import random

from steerclust.operators import links as L


def replay(events):
    """Sequential store: must removes a cannot on the same pair; cannot ignored when connected."""
    must, cannot, adj = set(), set(), {}

    def connected(a, b):
        seen, stack = {a}, [a]
        while stack:
            x = stack.pop()
            if x == b:
                return True
            for y in adj.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        return False

    for _, kind, i, j in sorted(events):
        if i == j:
            continue
        p = (min(i, j), max(i, j))
        if kind == "must":
            cannot.discard(p)
            must.add(p)
            adj.setdefault(i, set()).add(j)
            adj.setdefault(j, set()).add(i)
        else:
            if i in adj and j in adj and connected(i, j):
                continue
            must.discard(p)
            cannot.add(p)
    return must, cannot


def test_resolve_links_matches_replay(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for s in range(30):
        ev = []
        n_items = rng.randint(3, 12)
        for seq in range(rng.randint(1, 40)):
            ev.append((seq, rng.choice(["must", "cannot"]), rng.randrange(n_items), rng.randrange(n_items)))
        expected[s] = replay(ev)
        rows += [(s, seq, k, i, j) for seq, k, i, j in ev]
    df = spark.createDataFrame(rows, "session_id long, seq long, kind string, i long, j long")
    got = {}
    for r in L.resolve_links(df).collect():
        got.setdefault(r["session_id"], (set(), set()))[0 if r["kind"] == "must" else 1].add((r["i"], r["j"]))
    for s, (m, c) in expected.items():
        gm, gc = got.get(s, (set(), set()))
        assert gm == m, s
        assert gc == c, s


def test_components_match_union_find(spark):
    rng = random.Random(3)
    rows = []
    for s in range(10):
        for seq in range(rng.randint(1, 30)):
            rows.append((s, seq, "must", rng.randrange(25), rng.randrange(25)))
    df = spark.createDataFrame(rows, "session_id long, seq long, kind string, i long, j long")
    comp = {(r["session_id"], r["item"]): r["component"] for r in L.must_link_components(df).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, _, _, i, j in rows:
        if i != j:
            a, b = find((s, i)), find((s, j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    for (s, item), c in comp.items():
        assert find((s, item)) == find((s, c))
        members = [k for k in comp if k[0] == s and find(k) == find((s, item))]
        assert c == min(k[1] for k in members)
