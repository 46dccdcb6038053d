"""Hard negatives and vector codes against brute force in whole numbers."""

import hashlib
from math import floor

import numpy as np
import pytest

from casewright.llm import hard_negatives, vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, code string"


def clustered(seed: int, n: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.4) / 4


def odd_rows(dim: int):
    return [(900, None, 1, "", ""), (901, [0.1] * (dim - 1) + [None], 1, "", ""), (902, [float("nan")] * dim, 1, "", ""), (903, [float("inf")] * dim, 2, "", ""), (None, [0.1] * dim, 1, "", ""), (904, [], 1, "", "")]


def negatives_of(rows, anchors):
    whole = [(k, [floor(256 * x) for x in v], lab) for k, v, lab, *_ in rows if k is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, (a, va, la) in enumerate(whole):
        if a not in anchors:
            continue
        s = [sum(x * y for x, y in zip(va, v)) for _, v, _ in whole]
        same = sorted((-s[j], k, j) for j, (k, _, lab) in enumerate(whole) if lab == la and j != i)[:5]
        for ps, p, _ in same:
            fit = sorted((-s[j], k) for j, (k, _, lab) in enumerate(whole) if lab != la and 50 * -ps <= 100 * s[j] <= 95 * -ps)[:3]
            out += [(a, p, r + 1, k, -ps, -ns) for r, (ns, k) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("tile", [4096, 60])
def test_hard_negatives(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    v = clustered(1, 300, 6)
    v[50] = v[0]  # equal vectors, ties
    v[120:140] = v[7]
    v[200] = 0
    rows = [(i, x, None if i % 41 == 5 else int(i % 4 if i < 200 else 3), "x", "y") for i, x in enumerate(v.tolist())]
    rows += [(7, rows[7][1], 3, "x", "y"), (50, v[80].tolist(), 0, "", ""), *odd_rows(6)]  # repeated keys
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, hard_negatives.mine(df, df["vec_id"] % 10 == 0).collect()))
    assert got == negatives_of(rows, set(range(0, 1000, 10))) and len(got) > 100
    assert hard_negatives.mine(df.limit(0), df["vec_id"] % 10 == 0).count() == 0


def test_blocks_are_neither_broadcast_nor_copied(spark, monkeypatch):
    met, meet = [], hard_negatives._meet
    monkeypatch.setattr(hard_negatives, "_meet", lambda *a: (met.append(meet(*a)), met[-1])[1])
    rows = [(i, x, i % 2, "", "") for i, x in enumerate(clustered(3, 60, 4).tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    hard_negatives.mine(df, df["vec_id"] % 5 == 0)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in met]
    assert len(plans) == 2 and all("CartesianProduct" in p and "Exchange" not in p and "Broadcast" not in p for p in plans)


def test_hard_negatives_of_large_numbers(spark):
    v = (np.random.default_rng(2).normal(size=(40, 5)) * 2e5).tolist()
    rows = [(i, x, i % 2, "", "") for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, hard_negatives.mine(df, df["vec_id"] % 5 == 0).collect())) == negatives_of(rows, set(range(0, 100, 5)))


def test_bounds_shut_out_candidates():
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(4, 8)) * 100).astype(np.int64)
    anchors = np.concatenate([m + rng.integers(-2, 3, m.shape) for _ in range(5)])
    order, parent = hard_negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(20)) and (parent < 0).sum() == 1
    tile = (rng.normal(size=(500, 8)) * 100).astype(np.int64)
    walk = hard_negatives.Walk(anchors, tile)
    for a in order.tolist():
        low, high = walk.bounds(a, parent[a])
        exact = tile @ anchors[a]
        assert (low <= exact).all() and (exact <= high).all()
        walk.settle(a, np.flatnonzero(high >= np.sort(exact)[-5]))
    assert walk.scored < 0.5 * 20 * 500


def codes_of(rows, entries, rounds=4):
    kept = sorted((r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1]))
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    whole = [[floor(1024 * x) for x in r[1]] for r in kept]
    edges = [dim * i // 4 for i in range(5)]
    books = [[w[a:b] for w in whole[:entries]] for a, b in zip(edges, edges[1:])]

    def nearest(p, book):
        return min((sum((x - y) ** 2 for x, y in zip(p, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for q, (a, b) in enumerate(zip(edges, edges[1:])):
            own = [nearest(w[a:b], books[q])[1] for w in whole]
            for k in range(len(books[q])):
                mine = [w[a:b] for w, o in zip(whole, own) if o == k]
                if mine:
                    books[q][k] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, total = [], {}
    for r, w in zip(kept, whole):
        got = [nearest(w[a:b], books[q]) for q, (a, b) in enumerate(zip(edges, edges[1:]))]
        error = sum(d for d, _ in got)
        total[r[2]] = total.get(r[2], 0) + error
        out.append([r[0], "".join(f"{k:02x}" for _, k in got), error, r[2]])
    return sorted((k, c, e, total[lab], sha) for k, c, e, lab in out)


@pytest.mark.parametrize(("shard", "factor"), [(4096, 1.0), (50, 1.0), (4096, 3e4)])
def test_vector_codes(spark, monkeypatch, shard, factor):
    monkeypatch.setattr(vector_codes, "SHARD", shard)
    v = clustered(5, 400, 10) * factor
    v[5] = v[3]  # equal entries: ties go to the lower one
    v[100:180] = v[3]
    rows = [(i, x, None if i % 5 == 0 else i % 3, "x", "y") for i, x in enumerate(v.tolist())]
    rows += [(7, v[9].tolist(), 1, "", ""), (8, [0.5] * 4, 1, "", ""), *odd_rows(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, vector_codes.compress(df, entries=20).collect()))
    assert got == codes_of(rows, 20)


def test_vector_codes_of_few_rows(spark):
    df = spark.createDataFrame([(3, [0.5, -0.5], 1, "", ""), (4, [0.1, 0.2], None, "", "")], SCHEMA)
    got = sorted(map(tuple, vector_codes.compress(df).collect()))
    assert got == codes_of([tuple(r) for r in df.collect()], 256) and got[0][1] == "00000000"
    assert vector_codes.compress(df.limit(0)).count() == 0


def test_trees_own_balls_whole():
    points = (clustered(8, 3000, 4) * 1000).astype(np.int64)
    tree = vector_codes.Tree(points)
    entries = points[:16]
    whole = sum(int(tree.count[n]) for n, _, rows in tree.owners(entries.astype(float)) if rows is None)
    code, error = vector_codes.assign(tree, entries)
    plain, plain_error = vector_codes.assign_plain(points, entries)
    assert (code == plain).all() and (error == plain_error).all() and whole > 400
    gap = points[tree.rows_below(tree.root)] - tree.centre[tree.root]
    assert len(gap) == 3000 and np.sqrt((gap**2).sum(1)).max() <= tree.radius[tree.root]
