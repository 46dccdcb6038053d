"""Hard negatives: rows of another label that score just below an anchor's positives, by anchor spanning-tree bounds.

Anchors are dealt to blocks, and each block is joined to a minimum spanning tree. Candidates are dealt to tiles; every
block meets every tile, as a stated query set meets all rows. In a tile the root is scored against all candidates; from
there on, a child's score lies within its parent's plus or minus (length of the edge) x (norm of the candidate), and
only candidates whose bounds overlap what the child looks for are scored: its best positives in the first pass, the
windows below their scores in the second. Bounds only ever exclude, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.shared import finite, scaled, stage_table

BLOCK = 512
TILE = 4096


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, parent) of a minimum spanning tree over the rows of m, by Prim's rule; the row nearest the mean is the root."""
    m = m.astype(float)
    n, gap = len(m), m - m.mean(0)
    root = int(np.einsum("ij,ij->i", gap, gap).argmin())
    order, parent = [root], np.full(n, -1)
    near, by, out = np.full(n, np.inf), np.full(n, root), np.ones(n, bool)
    out[root] = False
    for _ in range(n - 1):
        gap = m - m[order[-1]]
        d = np.einsum("ij,ij->i", gap, gap)
        closer = out & (d < near)
        near[closer], by[closer] = d[closer], order[-1]
        k = int(np.where(out, near, np.inf).argmin())
        out[k], parent[k] = False, by[k]
        order.append(k)
    return np.array(order), parent


class Walk:
    """Bounds on the scores of a block's anchors against a tile, from the root of the tree down."""

    def __init__(self, anchors: np.ndarray, tile: np.ndarray):
        real = lambda m: m.astype(float)
        self.length = np.sqrt(np.einsum("ij,ij->i", real(tile), real(tile)))
        most = float(np.sqrt(np.einsum("ij,ij->i", real(anchors), real(anchors)).max())) * float(self.length.max())
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # whichever holds every sum exactly
        self.anchors, self.tile = anchors.astype(kind), tile.astype(kind)
        self.low, self.high = {}, {}
        self.scored = 0

    def score(self, a: int, which: np.ndarray) -> np.ndarray:
        self.scored += len(which)
        part = self.tile if len(which) == len(self.tile) else self.tile[which]
        return (part @ self.anchors[a]).astype(float if part.dtype != np.int64 else np.int64)

    def bounds(self, a: int, parent: int) -> tuple[np.ndarray, np.ndarray]:
        """Arrays of a's bounds, kept to be narrowed by settle()."""
        if parent < 0:
            exact = self.score(a, np.arange(len(self.tile)))
            self.low[a], self.high[a] = exact.astype(float), exact.astype(float)
        else:
            gap = self.anchors[a].astype(float) - self.anchors[parent].astype(float)
            slack = self.length * (np.sqrt(gap @ gap) * (1 + 1e-9)) + 1e-3
            self.low[a], self.high[a] = self.low[parent] - slack, self.high[parent] + slack
        return self.low[a], self.high[a]

    def settle(self, a: int, which: np.ndarray) -> np.ndarray:
        got = self.score(a, which)
        self.low[a][which] = self.high[a][which] = got
        return got


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores, ties by smaller id."""
    where = np.arange(len(score))
    if len(score) > most:
        where = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    return where[np.lexsort((ids[where], -score[where]))][:most]


def _positives(block: dict, tile: dict, most: int) -> list[tuple]:
    walk, out = Walk(block["m"], tile["m"]), []
    for a in block["order"].tolist():
        _, high = walk.bounds(a, block["parent"][a])
        same = np.flatnonzero((tile["label"] == block["label"][a]) & (tile["uid"] != block["uid"][a]))
        if len(same) > 4 * most:  # the most promising ones first: their scores shut out the others
            first = same[np.argpartition(-high[same], 2 * most)[: 2 * most]]
            least = np.sort(walk.settle(a, first))[-most]
            same = same[high[same] >= least]
        if len(same):
            got = walk.settle(a, same)
            for k in best(got, tile["id"][same], most).tolist():
                out.append((int(block["uid"][a]), int(block["id"][a]), int(tile["id"][same[k]]), int(tile["uid"][same[k]]), int(got[k])))
    return out


def _negatives(block: dict, tile: dict, most: int, low: int, high: int) -> list[tuple]:
    walk, out = Walk(block["m"], tile["m"]), []
    for a in block["order"].tolist():
        least, largest = walk.bounds(a, block["parent"][a])
        windows = [(-((-low * p) // 100), (high * p) // 100) for p in block["scores"][a]]
        need = np.zeros(len(least), bool)
        for x, y in windows:
            if x <= y:
                need |= (largest >= x) & (least <= y)
        need &= tile["label"] != block["label"][a]
        which = np.flatnonzero(need)
        if not len(which):
            continue
        got = walk.settle(a, which)
        for rank, (x, y) in enumerate(windows):
            inside = np.flatnonzero((got >= x) & (got <= y))
            for k in best(got[inside], tile["id"][which[inside]], most).tolist():
                j = inside[k]
                out.append((int(block["uid"][a]), rank, int(tile["id"][which[j]]), int(got[j])))
    return out


def _block(row: pa.StructScalar, scale: int) -> dict:
    """A block or tile as arrays, without a Python object a component."""
    plain = lambda c: row[c].values.to_numpy(zero_copy_only=False) if c in row and row[c].is_valid else np.array((), np.int64)
    m = scaled(plain("v").astype(float).reshape(len(row["uid"]), -1), scale)
    return {"m": m, "uid": plain("uid"), "id": plain("id"), "label": plain("label"), "order": plain("order"), "parent": plain("parent"), "scores": row["scores"].as_py() if "scores" in row else None}


def _packed(rows: DataFrame, part: str, size: int, counts: dict[int, int], *more: str) -> DataFrame:
    """One row a part: (dim, part, id, uid, label, v flat, …); a part has about `size` rows, dealt by hash."""
    parts = F.element_at(F.create_map(*(F.lit(x) for d, n in sorted(counts.items() or [(0, 1)]) for x in (d, max(1, -(-n // size))))), F.col("dim"))
    dealt = rows.withColumn(part, F.pmod(F.xxhash64("uid"), parts.cast("long")).cast("int"))
    gathered = [F.collect_list(c).alias(c) for c in ("id", "uid", "label", *more)]
    return dealt.groupBy("dim", part).agg(*gathered, F.flatten(F.collect_list("v")).alias("v"))


def _with_trees(blocks: DataFrame, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [spanning_tree(_block(r, scale)["m"]) for r in batch.select(["uid", "id", "label", "v"]).to_struct_array()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([t[i].tolist() for t in trees], kind) for i in (0, 1))], names=[*batch.schema.names, "order", "parent"])

    return blocks.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in (*blocks.dtypes, ("order", "array<int>"), ("parent", "array<int>"))))


def _meet(blocks: DataFrame, tiles: DataFrame, find, scale: int, schema: str) -> DataFrame:
    """find(block, tile) for every block and every tile of its vector length.

    A Cartesian product of the tables' partitions: blocks are neither copied for each tile nor broadcast, which Spark would do
    by a size that holds before they are copied; a task reads some blocks and some tiles, so nothing is shuffled.
    """
    asked = blocks.select("dim", F.struct(*(c for c in blocks.columns if c != "dim")).alias("b"))
    held = tiles.select("dim", F.struct("id", "uid", "label", "v").alias("t"))
    pairs = held.join(asked.hint("shuffle_replicate_nl"), "dim").select("b", "t")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = find(_block(batch.column(0)[i], scale), _block(batch.column(1)[i], scale))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "pos" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)

    return pairs.mapInArrow(run, schema)


def mine(table: DataFrame, is_anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors (rows with is_anchor).

    Components become floor(scale x); a score is the integer inner product. An anchor's positives are its first rows of
    the same label but itself; of each, the first `negatives` rows of another label with low * positive_score <= 100 *
    negative_score <= high * positive_score are returned. Higher scores come first, then smaller keys.

    Rows with a null key, label or vector, or with a null or non-finite component take no part. Labels and keys are
    whole numbers; only vectors of one length are compared. Rows that repeat a key count as rows of their own. Zero
    vectors score 0. Integer components beyond what a 64-bit sum can hold are cut to it. An empty table gives no rows.
    """
    fine = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite(F.col(vector)), F.lit(False))
    rows = table.filter(fine).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = stage_table(rows.filter(F.size("v") > 0).select("id", "label", "v", F.size("v").alias("dim"), "asks", F.monotonically_increasing_id().alias("uid")), "vectors")
    counts = {r["dim"]: (r["n"], r["a"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("a")).collect()}  # one row a vector length
    tile_counts, block_counts = ({d: c[i] for d, c in counts.items()} for i in (0, 1))
    # files of a few tiles and of a few blocks: the product has a task for each two files
    spread = lambda df, counts, size: df.repartition(max(1, min(1000, math.ceil(sum(-(-n // size) for n in counts.values()) / 2))))
    tiles = stage_table(spread(_packed(rows, "tile", TILE, tile_counts), tile_counts, TILE), "tiles")
    anchors = rows.filter("asks")
    first = stage_table(_with_trees(spread(_packed(anchors, "block", BLOCK, block_counts), block_counts, BLOCK), scale), "anchor-blocks")
    near = _meet(first, tiles, lambda b, t: _positives(b, t, positives), scale, "anchor bigint, anchor_id bigint, positive_id bigint, other bigint, positive_score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "other")
    chosen = stage_table(near.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < positives).drop("other"), "positives")
    scores = chosen.groupBy(F.col("anchor").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    second = stage_table(_with_trees(spread(_packed(anchors.join(scores, "uid"), "block", BLOCK, block_counts, "scores"), block_counts, BLOCK), scale), "anchor-windows")
    found = _meet(second, tiles, lambda b, t: _negatives(b, t, negatives, low, high), scale, "anchor bigint, pos int, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("anchor", "pos").orderBy(F.desc("negative_score"), "negative_id"))
    kept = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return kept.join(chosen, ["anchor", "pos"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
