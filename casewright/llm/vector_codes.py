"""Vector code compression: product codes whose codebooks are fitted through anchors-hierarchy metric trees.

Rows are dealt to shards of bounded size. In a shard each part position has a metric tree, built middle-out: about
sqrt(n) anchors, each new one the point farthest from the anchor with the widest ball, take over the points nearer to
them (points closer to their anchor than half the anchors' distance are never looked at); anchors are merged in pairs
into the balls above them, and each anchor's points are split the same way below. A ball caches the sum and the count
of its points. A round walks each tree with the list of codebook entries, which every ball inherits shrunk by those
that can own none of its points; a ball left with one entry adds its cached sum and count without a look at its points.
Rounds are jobs over the staged shards; the driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.shared import finite, lookup, scaled, stage_table

SHARD = 4096
LEAF = 24


def _anchors(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """rows split among about sqrt(n) anchors, each point with its nearest (an earlier one on a tie)."""
    x = points[rows]
    first = x - x[0]
    order = np.argsort(-np.einsum("ij,ij->i", first, first), kind="stable")  # each list by falling distance
    gap = x[order] - x[0]
    held = [(x[0], order, np.sqrt(np.einsum("ij,ij->i", gap, gap)))]
    for _ in range(int(np.ceil(np.sqrt(len(rows)))) - 1):
        widest = max(range(len(held)), key=lambda i: held[i][2][0])
        if held[widest][2][0] == 0:
            break
        pivot = x[held[widest][1][0]]
        mine, far = [], []
        for i, (anchor, own, d) in enumerate(held):
            apart = np.sqrt(((anchor - pivot) ** 2).sum())
            able = int(np.searchsorted(-d, -apart / 2, "right"))  # nearer ones can't change sides
            if not able:
                continue
            gap = x[own[:able]] - pivot
            new = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            moves = new < d[:able]
            if moves.any():
                mine.append(own[:able][moves])
                far.append(new[moves])
                stays = np.concatenate([~moves, np.ones(len(own) - able, bool)])
                held[i] = (anchor, own[stays], d[stays])
        own, d = np.concatenate(mine), np.concatenate(far)
        by = np.argsort(-d, kind="stable")
        held = [h for h in held if len(h[1])] + [(pivot, own[by], d[by])]
    return [rows[own] for _, own, _ in held]


class Tree:
    """Balls in flat arrays: centre, radius, sum, count, children (-1: leaf) and each ball's range in `order`."""

    def __init__(self, points: np.ndarray):
        self.points, self.balls, self.order = points.astype(float), [], []
        self.root = self._grow(np.arange(len(points))) if len(points) else -1
        self.order = np.array(self.order, np.int32)
        columns = list(zip(*self.balls)) or [()] * 7
        self.centre, self.sums = (np.array(c, float) for c in (columns[0], columns[2]))
        self.radius, self.count, self.left, self.right, self.begin = (np.array(c) for c in (columns[1], columns[3], columns[4], columns[5], columns[6]))

    def _ball(self, total: np.ndarray, count: int, radius: float, left: int, right: int, begin: int) -> int:
        self.balls.append((total / count, radius, total, count, left, right, begin))
        return len(self.balls) - 1

    def _leaf(self, rows: np.ndarray) -> int:
        x = self.points[rows]
        total = x.sum(0)
        gap = x - total / len(rows)
        begin = len(self.order)
        self.order.extend(rows.tolist())
        return self._ball(total, len(rows), float(np.sqrt(np.einsum("ij,ij->i", gap, gap).max())), -1, -1, begin)

    def _grow(self, rows: np.ndarray) -> int:
        parts = _anchors(self.points, rows) if len(rows) > LEAF else [rows]
        if len(parts) == 1:  # few points, or all equal
            return self._leaf(rows)
        return self._merge([self._grow(p) for p in parts])

    def _merge(self, nodes: list[int]) -> int:
        """One ball over the nodes: the two whose common ball is smallest first. Ranges in `order` need not be adjacent."""
        of = lambda i: np.array([self.balls[n][i] for n in nodes])
        centre, radius, weight = of(0), of(1).astype(float), of(3).astype(float)
        live, ids = np.ones(len(nodes), bool), list(nodes)

        def common(i: int) -> np.ndarray:
            """Radius of a ball around the mean of i's points and each other's."""
            apart = np.sqrt(((centre - centre[i]) ** 2).sum(1))
            share = weight / (weight + weight[i])
            return np.maximum(radius[i] + apart * share, radius + apart * (1 - share))

        pair = np.array([common(i) for i in range(len(nodes))])
        np.fill_diagonal(pair, np.inf)
        for _ in range(len(nodes) - 1):
            i, j = divmod(int(pair.argmin()), len(nodes))
            total = self.balls[ids[i]][2] + self.balls[ids[j]][2]
            ids[i] = self._ball(total, int(weight[i] + weight[j]), float(pair[i, j]) * (1 + 1e-9), ids[i], ids[j], -1)
            centre[i], radius[i], weight[i] = self.balls[ids[i]][0], self.balls[ids[i]][1], weight[i] + weight[j]
            live[j] = False
            pair[j], pair[:, j] = np.inf, np.inf
            fresh = np.where(live, common(i), np.inf)
            fresh[i] = np.inf
            pair[i], pair[:, i] = fresh, fresh
        return ids[i] if len(nodes) > 1 else ids[0]

    def owners(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray | int, np.ndarray]]:
        """(ball, entry, None) of balls owned whole and (leaf, entries, rows) of leaves, entry by row; ties to the
        lower entry. entries: distinct rows, integers as floats."""
        stack = [(self.root, np.arange(len(entries)))] if self.root >= 0 else []
        while stack:
            node, cand = stack.pop()
            if len(cand) > 1:
                gap = entries[cand] - self.centre[node]
                d = np.einsum("ij,ij->i", gap, gap)
                k = int(d.argmin())
                apart = entries[cand] - entries[cand[k]]
                # at the ball's point nearest to an entry, on the line from the best one, the best one is still nearer
                keep = d - d[k] <= 2 * self.radius[node] * np.sqrt(np.einsum("ij,ij->i", apart, apart)) * (1 + 1e-9) + 1e-6 * (1 + d[k])
                cand = cand[keep]
            if len(cand) == 1:
                yield node, int(cand[0]), None
            elif self.left[node] >= 0:
                stack += [(int(self.left[node]), cand), (int(self.right[node]), cand)]
            else:
                rows = self.order[self.begin[node] : self.begin[node] + self.count[node]]
                gap = self.points[rows][:, None, :] - entries[cand][None]
                yield node, cand[np.einsum("ijk,ijk->ij", gap, gap).argmin(1)], rows

    def rows_below(self, node: int) -> np.ndarray:
        out, stack = [], [node]
        while stack:
            n = stack.pop()
            if self.left[n] >= 0:
                stack += [int(self.left[n]), int(self.right[n])]
            else:
                out.append(self.order[self.begin[n] : self.begin[n] + self.count[n]])
        return np.concatenate(out)

    def flat(self) -> list[bytes]:
        return [a.astype(t).tobytes() for a, t in ((self.order, "<i4"), (self.radius, "<f8"), (self.sums, "<i8"), (self.count, "<i4"), (self.left, "<i4"), (self.right, "<i4"), (self.begin, "<i4"))]

    @classmethod
    def of(cls, points: np.ndarray, flat: list[bytes]) -> Tree:
        tree = cls.__new__(cls)
        tree.points = points.astype(float)
        tree.order, tree.radius, sums, tree.count, tree.left, tree.right, tree.begin = (np.frombuffer(b, t) for b, t in zip(flat, ("<i4", "<f8", "<i8", "<i4", "<i4", "<i4", "<i4")))
        tree.sums = sums.reshape(len(tree.count), -1).astype(float)
        tree.centre = tree.sums / tree.count[:, None]
        tree.root = len(tree.count) - 1  # the last ball made
        return tree


def distinct(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the smallest index of each), in the order of those indexes."""
    _, first = np.unique(entries, axis=0, return_index=True)
    first = np.sort(first)
    return entries[first].astype(float), first


def part_edges(dim: int, parts: int) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


def fits(whole: np.ndarray) -> bool:
    """Whether double precision holds every squared distance and every sum of a shard exactly."""
    most = int(np.abs(whole).max(initial=0))
    return 4 * most * most * max(1, whole.shape[1]) < 2**50


def sums_and_counts(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the sum and the number of the points that it owns."""
    unique, first = distinct(entries)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    for node, owner, rows in tree.owners(unique):
        if rows is None:
            sums[first[owner]] += tree.sums[node].astype(np.int64)
            counts[first[owner]] += tree.count[node]
        else:
            np.add.at(sums, first[owner], tree.points[rows].astype(np.int64))
            np.add.at(counts, first[owner], 1)
    return sums, counts


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point."""
    unique, first = distinct(entries)
    code = np.zeros(len(tree.points), np.int64)
    for node, owner, rows in tree.owners(unique):
        code[tree.rows_below(node) if rows is None else rows] = first[owner]
    gap = tree.points - entries[code]
    return code, np.einsum("ij,ij->i", gap, gap).astype(np.int64)


def assign_plain(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As assign() in whole numbers of any size, point by entry."""
    code, error = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
    for k, e in enumerate(entries.astype(np.int64)):
        d = ((points - e) ** 2).sum(1)
        code, error = np.where(d < error, k, code), np.minimum(d, error)
    return code, error


def shards(rows: DataFrame, parts: int, scale: int, total: int) -> DataFrame:
    """One row a shard: (shard, uid[], id[], label[], whole, trees): integer vectors and a tree for each part, flat."""
    n = max(1, -(-total // SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"))
    packed = dealt.groupBy("shard").agg(*(F.collect_list(c).alias(c) for c in ("uid", "id", "label")), F.flatten(F.collect_list("v")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                uid = row.column(1)[0].values
                whole = scaled(row.column(4)[0].values.to_numpy().reshape(len(uid), -1), scale)
                edges = part_edges(whole.shape[1], parts)
                trees = [Tree(whole[:, a:b]).flat() if fits(whole) else [] for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([whole.astype("<i8").tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.list_(pa.binary())))], names=["shard", "uid", "id", "label", "whole", "trees"])

    return packed.mapInArrow(run, "shard int, uid array<bigint>, id array<bigint>, label array<string>, whole binary, trees array<array<binary>>")


def _parts_of(whole: bytes, n: int, trees, parts: int) -> Iterator[tuple[np.ndarray, Tree | None]]:
    m = np.frombuffer(whole, "<i8").reshape(n, -1)
    edges = part_edges(m.shape[1], parts)
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        flat = [x.as_py() for x in trees[k]]
        yield m[:, a:b], Tree.of(m[:, a:b], flat) if flat else None


def _round(staged: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """The codebooks after one assignment: floor of each entry's mean; entries without points stay."""
    shared = staged.sparkSession.sparkContext.broadcast(books)  # parts x entries x part length, whatever the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                n = len(batch.column(0)[i].values)
                for k, (points, tree) in enumerate(_parts_of(batch.column(1)[i].as_py(), n, batch.column(2)[i], parts)):
                    if tree is not None:
                        s, c = sums_and_counts(tree, shared.value[k])
                    else:
                        code, _ = assign_plain(points, shared.value[k])
                        s, c = np.zeros(shared.value[k].shape, np.int64), np.bincount(code, minlength=len(shared.value[k]))
                        np.add.at(s, code, points)
                    totals[k][0][:] += s
                    totals[k][1][:] += c
        rows = [(k, e, s[e].tolist(), int(c[e])) for k, (s, c) in enumerate(totals) for e in np.flatnonzero(c).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()))], names=["part", "entry", "s", "n"])

    told = staged.select("uid", "whole", "trees").mapInArrow(run, "part int, entry int, s array<bigint>, n bigint")
    each = told.select("part", "entry", "n", F.posexplode("s").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    new = [b.copy() for b in books]
    for r in each.collect():  # one row a number of the codebooks
        new[r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
    shared.destroy()
    return new


def compress(table: DataFrame, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector.

    Components become floor(scale x) and vectors `parts` consecutive parts, as equal as their length allows. The
    codebooks start as the parts of the `entries` smallest keys (fewer rows: all; equal keys by vector) and go through
    `rounds` of assignment and floored means; code: the entries after a last assignment, two hex digits a part; error:
    the squared distance; label_error: its sum over the rows with that label, nulls together.

    Rows with a null key or vector, or with a null or non-finite component take no part, nor do vectors of another
    length than the first key's. Rows that repeat a key count as rows of their own. Components beyond what 64-bit sums
    can hold are cut to it. An empty table gives no rows.
    """
    fine = F.col(key).isNotNull() & F.coalesce(finite(F.col(vector)), F.lit(False))
    rows = table.filter(fine).select(F.col(key).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null")).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = stage_table(rows.withColumn("uid", F.monotonically_increasing_id()), "code-vectors")
    lead = rows.orderBy("id", "v").select(F.size("v").alias("dim")).first()
    dim = lead["dim"] if lead else 0
    rows = rows.filter(F.size("v") == dim)
    first = rows.orderBy("id", "v").select("v").limit(entries).collect()  # `entries` rows
    whole = scaled(np.array([r["v"] for r in first], float).reshape(len(first), dim), scale)
    edges = part_edges(dim, parts)
    books = [whole[:, a:b].copy() for a, b in zip(edges, edges[1:])]
    staged = stage_table(shards(rows, parts, scale, rows.count()), "code-trees")
    for _ in range(rounds if first else 0):
        books = _round(staged, books, parts)
    said = ",".join(str(x) for b in books for x in b.ravel().tolist())
    shared = table.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uid, ids, labels = (batch.column(c)[i].values for c in (0, 1, 2))
                codes, error = [], np.zeros(len(uid), np.int64)
                for k, (points, tree) in enumerate(_parts_of(batch.column(3)[i].as_py(), len(uid), batch.column(4)[i], parts)):
                    code, d = assign(tree, shared.value[k]) if tree is not None else assign_plain(points, shared.value[k])
                    codes.append(code)
                    error += d
                text = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, 1).tolist()]
                yield pa.RecordBatch.from_arrays([uid, ids, labels, pa.array(text, pa.string()), pa.array(error)], names=["uid", "id", "label", "code", "error"])

    coded = stage_table(staged.select("uid", "id", "label", "whole", "trees").mapInArrow(run, "uid bigint, id bigint, label string, code string, error bigint"), "codes")
    sums = stage_table(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    both = lookup(coded, sums, "label", coded.count(), F.col("uid").cast("string"))
    return both.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))
