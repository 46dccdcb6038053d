"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. After one fixed rotation the coordinates are split
into blocks; a pair within that distance is, in at least one block, within the block's share of it (its dimensions
over all). Each block is range-joined: its first two coordinates make a grid of cells as wide as the block's radius,
and a point meets the points of its own and the neighbouring cells, each two cells once. Candidates of any block are verified on the
original vectors in double precision, and a pair is counted by the first block that brings it, so links are counted
once without a shuffle of pairs. Equal vectors are one class with a weight, and crowded cells are dealt in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.hnsw import usable
from casewright.llm.shared import components, lookup, stage_table

TILE = 4096
PAIRS = 20_000
#: A cell and half of its neighbours: each two neighbouring cells meet once.
STEPS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
CELL = ["dim", "block", "x", "y"]


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[int]:
    blocks = max(1, min(blocks, dim // 2 or 1))
    return [dim * i // blocks for i in range(blocks + 1)]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so no square over- or underflows."""
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def place(found: DataFrame, threshold: float, blocks: int, number: str = "double") -> DataFrame:
    """found with its grid cells: (dim, block, x, y, rep, w, v), one row a block; v as numbers that hold the components."""
    budget = 2 - 2 * threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(lens).tolist():
                part = batch.filter(pa.array(lens == dim))
                raw = part.column("v").flatten().to_numpy().reshape(-1, dim)
                vectors = part.column("v").cast(pa.list_(pa.float32() if number == "float" else pa.float64()))
                turned, edges = _unit(raw) @ rotation(dim), block_edges(dim, blocks)
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    side = np.sqrt(budget * (b - a) / dim) * (1 + 1e-9) + 1e-9
                    x = np.floor(turned[:, a] / side).astype(np.int32)
                    y = np.floor(turned[:, min(a + 1, b - 1)] / side).astype(np.int32)
                    same = lambda k: pa.array(np.full(len(raw), k, np.int32))
                    yield pa.RecordBatch.from_arrays([same(dim), same(i), pa.array(x), pa.array(y), part.column("rep"), part.column("w"), vectors], names=["dim", "block", "x", "y", "rep", "w", "v"])

    return found.mapInArrow(run, f"dim int, block int, x int, y int, rep bigint, w bigint, v array<{number}>")


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label, lowered until both ends of every link (i, j) among n points have the same one; label[x] <= x names a point."""
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def join_tile(home: tuple, other: tuple, block: int, dim: int, threshold: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between home and other points that this block brings first: (number of rows linked to each point of home and
    then other, for each the first point of its linked group, or itself). home: (reps, w, raw); other: (reps, w, raw,
    whether a point is of the home cell too, so that it meets the home points with smaller rep only). Pairs are handled
    PAIRS at a time, so memory doesn't grow with their number."""
    (reps, w, raw), (oreps, ow, oraw, own) = home, other
    edges, budget = block_edges(dim, blocks), 2 - 2 * threshold
    shares = [budget * (b - a) / dim * (1 + 1e-9) + 1e-9 for a, b in zip(edges, edges[1:])]
    p, q = _unit(raw), _unit(oraw)
    turn = rotation(dim)
    a, b = edges[block], edges[block + 1]
    n = len(raw)
    links, label = np.zeros(n + len(oraw), np.int64), np.arange(n + len(oraw))
    p32, q32 = (p @ turn[:, a:b]).astype(np.float32), (q @ turn[:, a:b]).astype(np.float32)
    qq = np.einsum("ij,ij->i", q32, q32)
    pp = np.einsum("ij,ij->i", p32, p32) - np.float32(shares[block] + 1e-5)
    for s in range(0, n, 256):
        dots = p32[s : s + 256] @ q32.T
        dots *= 2
        dots -= qq
        every_i, every_j = np.nonzero(dots >= pp[s : s + 256, None])
        every_i += s
        ok = ~own[every_j] | (reps[every_i] < oreps[every_j])
        every_i, every_j = every_i[ok], every_j[ok]
        for c in range(0, len(every_i), PAIRS):
            i, j = every_i[c : c + PAIRS], every_j[c : c + PAIRS]
            ok = np.einsum("ij,ij->i", p[i], q[j]) >= threshold
            i, j = i[ok], j[ok]
            gap = ((p[i] - q[j]) @ turn) ** 2
            within = [gap[:, x:y].sum(1) <= h for x, y, h in zip(edges, edges[1:], shares)]
            ok = within[block]
            for earlier in within[:block]:
                ok &= ~earlier
            i, j = i[ok], j[ok]
            links += np.bincount(i, weights=ow[j], minlength=len(links)).astype(np.int64)
            links += np.bincount(j + n, weights=w[i], minlength=len(links)).astype(np.int64)
            label = smallest_linked(len(links), i, j + n, label)
    return links, label


def tiled(placed: DataFrame) -> DataFrame:
    """placed with the tile of each point, (tile, across, side): a cell's points are dealt by hash to tiles of about TILE,
    each point once. across: the tile's number where it is the other side of a meeting, the same; side: 0, home."""
    number = placed.groupBy(*CELL).count().select(*CELL, F.ceil(F.col("count") / TILE).alias("tiles"))
    dealt = placed.join(stage_table(number, "cell-sizes"), CELL).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    return dealt.select(*CELL, "tile", F.col("tile").alias("across"), "rep", "w", "v", F.lit(0).alias("side"))


def gathered(points: DataFrame) -> DataFrame:
    """The points of tiled() as one row a tile, written in files of a few tiles: (dim, block, x, y, tile, across, rep, w, v flat)."""
    n = points.groupBy(*CELL).agg((F.max("tile") + 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files = max(1, min(1000, math.ceil(math.sqrt(n))))  # meeting() has a task for each two files
    each = points.repartition(files, *CELL, "tile", "across").groupBy(*CELL, "tile", "across")
    return stage_table(each.agg(F.collect_list("rep").alias("rep"), F.collect_list("w").alias("w"), F.flatten(F.collect_list("v")).alias("v")), "vector-tiles")


def meeting(tiles: DataFrame) -> DataFrame:
    """(dim, block, own, a, b): every two tiles of one cell or of neighbouring ones, each two once, and each with itself (own).

    A Cartesian product of the table's partitions: a task reads the tiles of two files, so tiles are not copied for each
    tile that they meet, and nothing is shuffled, sorted or broadcast.
    """
    side = lambda p: tiles.select(*(F.col(c).alias(f"{p}{c}") for c in (*CELL, "tile", "across")), F.struct("rep", "w", "v").alias(p))
    i, j, same = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
    beside = F.lit(False)
    for x, y in STEPS[1:]:
        beside |= (i == x) & (j == y)
    near = (F.col("adim") == F.col("bdim")) & (F.col("ablock") == F.col("bblock")) & (beside | (same & (F.col("atile") <= F.col("bacross"))))
    both = side("a").join(side("b").hint("shuffle_replicate_nl"), near)
    return both.select(F.col("adim").alias("dim"), F.col("ablock").alias("block"), (same & (F.col("atile") == F.col("bacross"))).alias("own"), "a", "b")


def near_duplicates(table: DataFrame, *, threshold: float = 0.9, blocks: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row of the table.

    n_links: other rows within the threshold; component_id: the smallest key reachable, itself included; kept: it is
    that key. Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a
    null key; vectors of different lengths are never linked. Rows that repeat a key count as rows of their own.
    """
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.coalesce(usable("v"), F.lit(False))
    good = rows.filter(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    members = stage_table(good.withColumn("h", F.xxhash64("v")), "vectors")
    found = members.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("w"))
    found = stage_table(found.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")  # a class has a number of its own: keys may repeat
    placed = stage_table(place(found, threshold, blocks, "float" if dict(table.dtypes)[vector] == "array<float>" else "double"), "vector-cells")
    tiles = gathered(tiled(placed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, block, own = (batch.column(c)[r].as_py() for c in ("dim", "block", "own"))
                held = []
                for row in (batch.column("a")[r], batch.column("b")[r]):
                    reps, w, raw = (row[c].values.to_numpy(zero_copy_only=False) for c in ("rep", "w", "v"))
                    held.append((reps, w, raw.astype(float).reshape(-1, dim)))
                (reps, w, raw), (oreps, ow, oraw) = held
                n, root = join_tile((reps, w, raw), (oreps, ow, oraw, np.full(len(oreps), own)), block, dim, threshold, blocks)
                every = np.concatenate([reps, oreps])
                tell = (n > 0) | (every != every[root])
                yield pa.RecordBatch.from_arrays([pa.array(every[tell]), pa.array(every[root][tell]), pa.array(n[tell])], names=["a", "b", "n"])

    told = stage_table(meeting(tiles).mapInArrow(run, "a bigint, b bigint, n bigint"), "tile-links")
    number = told.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    linked = components(told.filter("a <> b").select("a", "b")).withColumnRenamed("node", "rep")
    per = found.join(number, "rep", "left").join(linked, "rep", "left").select("v", "rep", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    per = stage_table(per, "vector-links")
    smallest = stage_table(per.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "vector-components")
    per = lookup(per, smallest, "component", per.count(), F.col("rep").cast("string")).select(F.col("v").alias("_v"), F.xxhash64("v").alias("_h"), "n_links", "component_id")
    joined = members.join(per, (members["h"] == per["_h"]) & (members["v"] == per["_v"])).select("id", "n_links", "component_id")
    alone = rows.filter(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
