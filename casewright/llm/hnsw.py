"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Equal vectors collapse to one class before anything else. Classes are dealt to shards of bounded size by a hash; each
shard is one row of an index table: its vectors and, per level, a flat array of neighbour numbers (-1: none). Blocks of
queries meet every shard in a product of the tables' files, each search walks down the levels greedily and then keeps a beam on the lowest one, and the
shards' results are merged by exact cosine. A shard's graph is built at once: what insertion in random order would
link, each node's diverse nearest among the nodes before it, is taken from the shard's own similarity matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.shared import stage_table

SHARD = 4096
LINKS = 16
CANDIDATES = 48
STEP = 8
#: Queries that walk in step: what they look up stays in a core's cache.
STRIDE = 128


def usable(vector: str) -> F.Column:
    """Vectors that take part: not null, without null, NaN or infinite components, not all zero."""
    c = F.col(vector)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & fine & F.exists(c, lambda x: x != 0)


def classes(table: DataFrame, key: str, vector: str, members: int) -> DataFrame:
    """(class, rep, v array<double>, dim, ids): distinct vectors, their smallest key and their `members` smallest keys. A
    key that repeats with other vectors is the rep of several classes, so a class has a number of its own; numbers hold
    in a table that is written once.

    The ranking limit is applied before the shuffle too, so a vector that a third of all rows share is a few rows a
    task. Rows that repeat key and vector count once; null keys take no part.
    """
    rows = table.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0 and 0 are one
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    least = rows.distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= members)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("class"), F.element_at("ids", 1).alias("rep"), "v", F.size("v").alias("dim"), "ids")


def diverse(sims: np.ndarray, owner: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Mask of the candidates (sorted by falling similarity, -1: none) to link: each is nearer to the owner than to any
    one chosen before, at most `most`."""
    n, c = cand.shape
    own = np.where(cand >= 0, sims[owner[:, None], cand], -np.inf)
    taken, count = np.zeros((n, c), bool), np.zeros(n, int)
    worst = np.full((n, c), -np.inf, np.float32)  # of each candidate to the chosen ones
    for k in range(c):
        ok = (cand[:, k] >= 0) & (worst[:, k] < own[:, k]) & (count < most)
        taken[ok, k] = True
        count += ok
        rows = np.flatnonzero(ok)
        if len(rows) and k + 1 < c:
            near = sims[cand[rows, k][:, None], np.maximum(cand[rows, k + 1 :], 0)]
            worst[rows, k + 1 :] = np.maximum(worst[rows, k + 1 :], near)
    return taken


def _level(sims: np.ndarray, nodes: np.ndarray, most: int, first: bool) -> np.ndarray:
    """Flat neighbour array (n, width) of one level, numbers of the shard; nodes in insertion order."""
    n, m = len(nodes), len(sims)
    width = 2 * most if first else most
    flat = np.full((m, width), -1, np.int32)
    if n < 2:
        return flat
    local = sims[np.ix_(nodes, nodes)].copy()
    local[np.triu_indices(n)] = -np.inf
    c = min(CANDIDATES, n - 1)
    order = np.argpartition(-local, c - 1, axis=1)[:, :c]
    got = np.take_along_axis(local, order, 1)
    rank = np.argsort(-got, axis=1, kind="stable")
    order, got = np.take_along_axis(order, rank, 1), np.take_along_axis(got, rank, 1)
    cand = np.where(np.isfinite(got), nodes[order], -1)
    pick = diverse(sims, nodes, cand, most)
    a, b = np.repeat(nodes, pick.sum(1)), cand[pick]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.lexsort((-sims[a, b], a))
    a, b = a[rank], b[rank]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    wide = np.full((m, int(place.max()) + 1 if len(a) else 1), -1, np.int32)
    wide[a, place] = b
    full = np.flatnonzero((wide >= 0).sum(1) > width)
    if len(full):
        for s in range(0, len(full), 512):
            part = full[s : s + 512]
            keep = diverse(sims, part, wide[part], width)
            for row, k in zip(part.tolist(), keep):
                chosen = wide[row][k]
                wide[row] = -1
                wide[row, : len(chosen)] = chosen
    flat[:, : min(width, wide.shape[1])] = wide[:, :width]
    return flat


def build(vectors: np.ndarray, links: int = LINKS, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest up: (node numbers, flat neighbours). vectors: unit float32 rows of one shard."""
    n = len(vectors)
    sims = vectors @ vectors.T
    height = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
    out = []
    for level in range(int(height.max()) + 1 if n else 0):
        nodes = np.flatnonzero(height >= level)
        out.append((nodes.astype(np.int32), _level(sims, nodes, links, level == 0)))
    return out


def search(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int) -> np.ndarray:
    """(q, beam) numbers of the nodes found (-1: none), nearest first: all queries of a block walk in step.

    A walk scores about a third of a shard's nodes, one gathered row each, so a block's scores come from one matrix product
    and the walks look them up. On the lowest level a step expands the `STEP` nearest nodes that are not expanded yet.
    """
    q, n = len(queries), len(vectors)
    score = queries @ vectors.T
    every = np.arange(q)
    at = np.full(q, int(levels[-1][0][0]))
    sim = score[every, at]
    for _, flat in levels[:0:-1]:
        live = every
        while len(live):
            near = flat[at[live]]
            s = np.where(near >= 0, score[live[:, None], near], -np.inf)
            k = s.argmax(1)
            top = s[np.arange(len(live)), k]
            better = top > sim[live]
            live, k, top, near = live[better], k[better], top[better], near[better]
            at[live], sim[live] = near[np.arange(len(live)), k], top
    flat = np.vstack([levels[0][1], np.full((1, levels[0][1].shape[1]), -1, np.int32)])  # the last row: of no node
    ids, sims = np.full((q, beam), -1, np.int32), np.full((q, beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = at, sim
    seen, done = np.zeros((q, n + 1), bool), np.ones((q, beam), bool)
    seen[every, at], done[:, 0], seen[:, n] = True, False, True  # -1: no node, seen
    live = every
    while len(live):
        row = live[:, None]
        pick = np.argsort(done[live], axis=1, kind="stable")[:, :STEP]
        node = np.where(done[row, pick], n, ids[row, pick])
        done[row, pick] = True
        lists, fresh = [], []
        for e in range(pick.shape[1]):  # one after the other: lists may share nodes
            near = flat[node[:, e]]
            new = ~seen[row, near]
            seen[row, near] = True
            lists.append(near)
            fresh.append(new)
        near, fresh = np.concatenate(lists, 1), np.concatenate(fresh, 1)
        both = np.concatenate([sims[live], np.where(fresh, score[row, near], -np.inf)], 1)
        order = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
        got = np.take_along_axis(both, order, 1)
        rank = np.argsort(-got, axis=1, kind="stable")
        order = np.take_along_axis(order, rank, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
        sims[live] = np.take_along_axis(got, rank, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), order, 1) | np.isinf(sims[live])
        live = live[~done[live].all(1)]
    return np.where(np.isfinite(sims), ids, -1)


def index(found: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """One row a shard: (dim, shard, n, classes, reps, vectors, nodes, flats) of classes(); arrays as flat binaries."""
    sizes = {r["dim"]: r["count"] for r in found.groupBy("dim").count().collect()}  # one row a vector length
    shards = F.element_at(F.create_map(*(F.lit(x) for d, n in sorted(sizes.items()) for x in (d, max(1, -(-n // shard))))) if sizes else F.create_map(F.lit(0), F.lit(1)), F.col("dim"))
    dealt = found.select("class", "rep", "v", "dim", F.pmod(F.xxhash64("class"), shards.cast("long")).cast("int").alias("shard"))

    def make(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group)).sort_by([("rep", "ascending"), ("class", "ascending")])  # a shard: bounded by its size
        dim = table.column("dim")[0].as_py()
        raw = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        levels = build(unit(raw))
        yield pa.RecordBatch.from_pylist([{
            "dim": dim, "shard": table.column("shard")[0].as_py(), "n": len(raw), "classes": table.column("class").to_numpy().astype("<i8").tobytes(), "reps": table.column("rep").to_numpy().astype("<i8").tobytes(), "vectors": raw.astype("<f8").tobytes(),
            "nodes": [x.astype("<i4").tobytes() for x, _ in levels], "flats": [y.astype("<i4").tobytes() for _, y in levels],
        }], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("n", pa.int32()), ("classes", pa.binary()), ("reps", pa.binary()), ("vectors", pa.binary()), ("nodes", pa.list_(pa.binary())), ("flats", pa.list_(pa.binary()))]))

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(make(iter(table.to_batches()))))

    files = max(1, min(1000, sum(-(-n // shard) for n in sizes.values())))
    return dealt.repartition(files, "dim", "shard").groupBy("dim", "shard").applyInArrow(whole, "dim int, shard int, n int, classes binary, reps binary, vectors binary, nodes array<binary>, flats array<binary>")


def unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(1, keepdims=True)
    scaled = raw / big
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled by the largest components, so no square over- or underflows."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def nearest(table: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 5, beam: int = 80, block: int = 1024, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, key, score): of each query row its k nearest rows of the table but its own, by cosine.

    Ties go to the smaller key. Vectors that are null, zero or hold null or non-finite components take no part, nor do
    null keys; vectors of different lengths are never compared. Rows that repeat key and vector count once; a key that
    repeats with another vector is another row, as query and as candidate.
    """
    found = stage_table(classes(table, key, vector, k + 1), "vector-classes")
    graph = stage_table(index(found, shard=shard), "hnsw-index")
    asked = queries.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    asked = stage_table(asked.select("query_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("asked")), "queries")
    number = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("asked"), F.lit(number)))
    blocks = dealt.repartition(max(1, min(1000, number // 4)), "dim", "_block").groupBy("dim", "_block").agg(F.collect_list("asked").alias("q"), F.flatten(F.collect_list("v")).alias("qv"))
    # a product of the files: shards and blocks are neither copied for each other nor broadcast
    both = graph.join(stage_table(blocks.drop("_block"), "query-blocks").hint("shuffle_replicate_nl"), "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                n, dim = row["n"].as_py(), row["dim"].as_py()
                raw = np.frombuffer(row["vectors"].as_py(), "<f8").reshape(n, dim)
                reps, numbers = (np.frombuffer(row[c].as_py(), "<i8") for c in ("reps", "classes"))
                levels = [(np.frombuffer(x, "<i4"), np.frombuffer(y, "<i4").reshape(n, -1)) for x, y in zip(row["nodes"].as_py(), row["flats"].as_py())]
                q = row["q"].values.to_numpy()
                qv = row["qv"].values.to_numpy().reshape(-1, dim)
                nodes, asks = unit(raw), unit(qv)
                got = np.concatenate([search(nodes, levels, asks[s : s + STRIDE], min(beam, n))[:, : 4 * (k + 1)] for s in range(0, len(asks), STRIDE)])
                a, b = np.nonzero(got >= 0)
                score = cosine(qv[a], raw[got[a, b]])
                order = np.lexsort((reps[got[a, b]], -score, a))
                a, b, score = a[order], b[order], score[order]
                top = np.arange(len(a)) - np.searchsorted(a, a) < k + 1
                a, b, score = a[top], b[top], score[top]
                found_at = got[a, b]
                yield pa.RecordBatch.from_pydict({"asked": q[a], "class": numbers[found_at], "rep": reps[found_at], "score": score, "equal": (qv[a] == raw[found_at]).all(1)})

    hits = both.select("dim", "n", "classes", "reps", "vectors", "nodes", "flats", "q", "qv").mapInArrow(run, "asked bigint, class bigint, rep bigint, score double, equal boolean")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "rep", "class")
    merged = hits.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")
    members = merged.join(found.select("class", "ids"), "class").select("asked", "score", "equal", F.explode("ids").alias("id")).join(asked.select("asked", "query_id"), "asked")
    members = members.filter(~((F.col("id") == F.col("query_id")) & F.col("equal")))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
    return members.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
