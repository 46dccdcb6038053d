"""SimHash near-duplicates with pivot distance tables.

Documents collapse to distinct fingerprints first, so exact copies cost one row. A fingerprint's table holds its Hamming
distances to many reference fingerprints (pivots). By the triangle inequality the tables of two fingerprints within
distance d differ by at most d in every coordinate; a pair with a larger difference is discarded without looking at
the fingerprints, and survivors are verified. Random fingerprints lie at 32 +- 4 from any pivot, so a table alone would
have to be compared with every other one; pairs are therefore formed within exact cells only: of six bit blocks, four
differing bits leave two untouched, so each pair within distance 4 meets in a cell of two equal blocks. Cells with
more fingerprints than `dense` form no pairs: their members are linked through shared variants with up to two
bits flipped (x and y are within 4 exactly when such variants coincide), which grows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.shared import components, cut, stage_step, stage_table

BITS = 64
DISTANCE = 4
#: Each bit of two set fingerprints differs with a chance of at most 3/16 at Jaccard 0.8 (sets of four and five).
WIDE = 26
BLOCKS = DISTANCE + 2
PIVOTS = 16


def _blocks() -> list[int]:
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: n words of 64 bits from a fixed seed."""
    return [_signed(int(x)) for x in np.random.default_rng(2024).integers(0, 1 << 64, n, dtype=np.uint64)]


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of one text, in order and with repeats; see fingerprints()."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(starts))


#: Random odd multipliers: of a word's bytes by their places, of a shingle's words by theirs, and of the mixing step.
_BYTES = np.random.default_rng(31).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_STEP, _WORDS = np.uint64(0x9E3779B97F4A7C15), np.random.default_rng(32).integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return x ^ x >> np.uint64(31)


def _word_hashes(data: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(where, hash) of each word of bytes that end with a space; blocks are cut at spaces, so memory follows the words."""
    spaces = np.flatnonzero(_SPACE[data])
    cuts = np.unique(spaces[np.minimum(np.searchsorted(spaces, np.arange(block, len(data), block)), len(spaces) - 1)]).tolist()
    where, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        part = data[a:b]
        inside = ~_SPACE[part]
        begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(begins):
            place = np.arange(begins[0], len(part)) - np.repeat(begins, np.diff(np.append(begins, len(part))))
            power = np.multiply.accumulate(np.full(int(place.max()) + 1, _STEP))
            where.append(begins + a)
            found.append(np.add.reduceat(_BYTES[part[begins[0] :]] * power[place] * inside[begins[0] :], begins - begins[0]))
    return np.concatenate(where), _mixed(np.concatenate(found))


def shingle_lists(texts: list[str | None], width: int) -> list[np.ndarray]:
    """64-bit hashes of the word shingles of each text, in order and with repeats, made for all texts at once; words are
    those of shingle_hashes(), fewer than `width` make one shingle."""
    lines = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    begins, words = _word_hashes(np.frombuffer(b" ".join([*lines, b""]), np.uint8))
    first = np.searchsorted(begins, np.cumsum([0] + [len(x) + 1 for x in lines]))
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    by = np.resize(_WORDS, width)
    sums = sum(padded[j : j + len(words)] * by[j] for j in range(width))
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(_mixed(sums[a : b - width + 1]))
        else:
            out.append(_mixed((words[a:b] * by[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else words[:0])
    return out


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_words(text: str, width: int = 4) -> int:
    """The signed fingerprint of one text; see fingerprints()."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, *, width: int = 4, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, fp bigint): a bit is set if it is set in over half the XXH64 hashes (seed 42) of the word shingles.

    Words are runs without ASCII white space, A-Z lower-cased; repeats count; fewer words than `width` make one
    shingle; a null text or one without words has fingerprint zero. Columns in `keep` pass through.
    """
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint_words(t.as_py() or "", width) for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([fp, *batch.columns[1:]], names=["fp", *(f"_{i}" for i in range(batch.num_columns - 1))])

    names = [key, *keep]
    schema = ", ".join(["fp bigint", *(f"_{i} {kinds[c]}" for i, c in enumerate(names))])
    got = docs.select(text, *names).mapInArrow(run, schema)
    return got.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), "fp")


def links(distinct: DataFrame, *, dense: int = 4096) -> DataFrame:
    """(a, b) links between the fingerprints of `distinct` (one column fp, no repeats) that keep its components whole:
    all pairs within four bits, or for dense cells links of each member to its variants' smallest owner."""
    masks = _blocks()
    both = [_signed(masks[i] | masks[j]) for i, j in combinations(range(BLOCKS), 2)]
    cells = F.array(*(F.struct(F.lit(i).alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(both)))
    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte").alias(f"d{i}") for i, p in enumerate(pivots())]
    placed = distinct.select("fp", *table, F.explode(cells).alias("cell"))
    counts = placed.groupBy("cell").count()
    crowded = cut(counts.filter(F.col("count") > dense).select("cell"))
    if crowded.isEmpty():
        calm, hot = placed, None
    else:
        calm = placed.join(crowded, "cell", "left_anti")
        hot = placed.join(crowded, "cell", "left_semi").select("fp").distinct()
    x = calm.select("cell", F.col("fp").alias("a"), *(F.col(f"d{i}").alias(f"a{i}") for i in range(PIVOTS)))
    y = calm.select("cell", F.col("fp").alias("b"), *(F.col(f"d{i}").alias(f"b{i}") for i in range(PIVOTS)))
    near = F.col("a") < F.col("b")
    for i in range(PIVOTS):
        near &= F.abs(F.col(f"a{i}") - F.col(f"b{i}")) <= DISTANCE
    near &= F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    # Spark sizes an exploded side too low and would broadcast it
    found = x.join(y.hint("merge"), (x["cell"] == y["cell"]) & near).select("a", "b").distinct()
    if hot is None:
        return found
    return found.union(variant_links(hot))


def variant_links(hot: DataFrame) -> DataFrame:
    """Links through variants: each fingerprint with up to two bits flipped, and the smallest fingerprint that has it."""
    flips = [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i, j in combinations(range(BITS), 2))]
    every = F.explode(F.lit([_signed(f) for f in flips])).alias("flip")
    variants = hot.select("fp", every).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    least = variants.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("_top")).filter("a < _top").select("v", "a")
    return variants.hint("merge").join(least, "v").filter("fp > a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, width: int = 4, key: str = "doc_id", text: str = "text", dense: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., fp, component_id) of every row; component_id: the smallest key reachable over links of four bits.

    Rows with the same fingerprint are linked, those without words (fingerprint zero) too. Repeated rows stay. A null
    key takes part and never is a component's id, unless no row of the component has a key. An empty table gives none.
    """
    marked = cut(fingerprints(docs, width=width, key=key, text=text, keep=keep))
    classes = cut(marked.groupBy("fp").agg(F.min(key).alias("_least")))
    pairs = links(classes.select("fp"), dense=dense)
    linked = components(pairs).withColumnRenamed("node", "fp")
    of = classes.join(linked, "fp", "left").select("fp", "_least", F.coalesce("component", "fp").alias("component"))
    named = of.groupBy("component").agg(F.min("_least").alias("component_id"))
    table = of.join(named, "component").select("fp", "component_id", "component")
    return marked.join(table, "fp").select(key, *keep, "fp", "component_id", "component")


def _first_rows(hashed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The row of each component of `found` (component, key, _cw_text, count) with the smallest key (and, at one key, text
    digest); a row with a null key stays only where no row of its component has a key. Equal rows leave one."""
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_cw_text").alias("t"), F.col("count").alias("c"))
    first = cut(found.groupBy("component").agg(F.min(order).alias("f")).select(F.col("f.k").alias("_cw_k"), F.col("f.t").alias("_cw_t"), F.col("f.c").alias("_cw_c")))
    kept = hashed.join(first, F.col(key).eqNullSafe(F.col("_cw_k")) & (F.col("_cw_text") == F.col("_cw_t")), "left_semi")
    if not first.filter("_cw_c > 1").isEmpty():
        kept = kept.dropDuplicates([key, "_cw_text"])
    return kept


def shingle_sets(docs: DataFrame, *, width: int, key: str, text: str, common: list[int] | None = None) -> DataFrame:
    """(key, _cw_text, c, n, fp, shingles) of each row with a word: its n distinct shingle hashes in ascending order,
    their fingerprint, and c, a 64-bit digest of the set. With `common`, shingles are the first n - ceil(0.8 n) + 1 of
    them in the order (common or not, hash): two sets with Jaccard 0.8 or more always share one of these."""
    kinds = dict(docs.dtypes)
    last = None if common is None else np.sort(np.array(common, np.int64))

    def firsts(x: np.ndarray) -> np.ndarray:
        x = x.view(np.int64)
        x = x[np.argsort(x, kind="stable")]
        often = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x if len(last) else np.zeros(len(x), bool)
        return np.concatenate([x[~often], x[often]])[: len(x) - -(-4 * len(x) // 5) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                sets = [np.unique(x) for x in shingle_lists(batch.column(0).to_pylist(), width)]
                shown = [x.view(np.int64) for x in sets] if last is None else [firsts(x) for x in sets]
                ends = np.cumsum([0, *map(len, shown)]).astype(np.int32)
                got = [
                    pa.array([_signed(xxh3_64_intdigest(x.tobytes())) for x in sets], pa.int64()),
                    pa.array(list(map(len, sets)), pa.int32()),
                    pa.array([fingerprint_of(x) for x in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*shown, np.empty(0, np.int64)]))),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *got], names=["k", "t", "c", "n", "fp", "shingles"])

    schema = f"k {kinds[key]}, t bigint, c bigint, n int, fp bigint, shingles array<bigint>"
    got = docs.select(text, key, "_cw_text").mapInArrow(run, schema).filter("n > 0")
    return got.withColumnRenamed("k", key).withColumnRenamed("t", "_cw_text")


def common_shingles(sample: DataFrame, *, least: int = 8, most: int = 200_000) -> list[int]:
    """Shingles that many sets of a sample hold, at most `most`. They only decide an order; any list gives the same pairs.

    How often each count occurs tells which counts fit, so the driver gets no more rows than it keeps.
    """
    counts = sample.select(F.explode("shingles").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    counts = stage_table(counts, "shingle-counts")
    held, floor = 0, None
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect():  # 10,000 rows at most
        held += r["m"]
        if held > most:
            break
        floor = r["n"]
    return [] if floor is None else [r["t"] for r in counts.filter(F.col("n") >= floor).select("t").orderBy("t").collect()]


def prefix_entries(prefixes: DataFrame) -> DataFrame:
    """(t, c, n, i, fp): the prefix shingles t of each set, and their places i."""
    return prefixes.select(F.posexplode("prefix").alias("i", "t"), "c", "n", "fp").select("t", "c", "n", "i", "fp")


def _maybe_similar(x: str, y: str) -> Column:
    """Length and positional filters, exact for Jaccard 0.8 at the first shared shingle, and the fingerprints' distance."""
    col = lambda side, name: F.col(f"{side}.{name}")
    na, nb = col(x, "n"), col(y, "n")
    rest = F.least(na - col(x, "i"), nb - col(y, "i"))
    apart = F.bit_count(col(x, "fp").bitwiseXOR(col(y, "fp")))
    return (na * 5 >= nb * 4) & (nb * 5 >= na * 4) & (rest * 9 >= (na + nb) * 4) & (apart <= WIDE)


def verified(pairs: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) of `pairs` whose sets have Jaccard 0.8 or more. Sets are made again, of one row of `known` each:
    sets_of() makes those of rows (key, _cw_text)."""
    key = known.columns[0]
    nodes = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    rows = known.join(nodes, "c", "left_semi").groupBy("c").agg(F.min(F.struct("_cw_text", key)).alias("r")).select("r.*").distinct()
    held = stage_table(sets_of(rows).select("c", "shingles").dropDuplicates(["c"]), "held-sets")
    both = pairs.join(held.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
    return both.filter(F.size(F.array_intersect("x", "y")) * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b")


def fingerprint_pairs(known: DataFrame) -> DataFrame:
    """(a, b) pairs of set digests by the pivot distance tables of links(): each set with the smallest of its fingerprint,
    and the smallest sets of fingerprints within four bits."""
    least = stage_table(known.groupBy("fp").agg(F.min("c").alias("m")), "fingerprints")
    same = known.join(least, "fp").filter("m < c").select(F.col("m").alias("a"), F.col("c").alias("b"))
    near = links(least.select("fp")).select(F.col("a").alias("p"), F.col("b").alias("q"))
    apart = near.join(least.select(F.col("fp").alias("p"), F.col("m").alias("x")), "p").join(least.select(F.col("fp").alias("q"), F.col("m").alias("y")), "q")
    return same.union(apart.select(F.least("x", "y"), F.greatest("x", "y"))).distinct()


def similar_links(known: DataFrame, prefixes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) verified links between the digests of sets that keep the components of Jaccard 0.8 whole.

    known: (key, _cw_text, c, n, fp) of all sets, prefixes: these with their prefix; sets_of() makes the sets of some rows.
    Near fingerprints are linked first, by their pivot tables. What four bits do not reach comes from shared prefix
    shingles: sets that share one are compared with the smallest of them where the links so far leave the two apart,
    which joins groups of near copies at linear cost, then pairs are formed between sets whose components still differ.
    """
    near = stage_table(fingerprint_pairs(known), "set-pairs")
    links = stage_step(lambda: verified(near, known, sets_of), "set-links")
    of = stage_table(components(links).withColumnRenamed("node", "c"), "set-components")

    entries = prefix_entries(prefixes).repartition("t").dropDuplicates(["t", "c"])
    same = Window.partitionBy("t")
    row = F.struct("c", "n", "i", "fp")
    shared = entries.select("t", row.alias("b"), F.min(row).over(same).alias("a"), F.max("c").over(same).alias("top"))
    shared = stage_table(shared.filter(F.col("a.c") < F.col("top")).select("t", "a", "b"), "shared-shingles")
    first = shared.filter((F.col("a.c") < F.col("b.c")) & _maybe_similar("a", "b")).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()
    one, two = of.toDF("a", "_ma"), of.toDF("b", "_mb")
    first = first.join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("_ma", "a") != F.coalesce("_mb", "b")).select("a", "b")
    first = stage_table(first, "set-pairs")
    links = links.union(stage_step(lambda: verified(first, known, sets_of), "set-links"))
    of = components(links).withColumnRenamed("node", "c")
    placed = shared.select("t", "b", F.col("b.c").alias("c")).join(of, "c", "left").select("t", "b", F.coalesce("component", "c").alias("m"))
    split = placed.select("t", "b", "m", F.min("m").over(same).alias("low"), F.max("m").over(same).alias("top"))
    split = stage_table(split.filter("low < top").select("t", "b", "m"), "split-shingles")
    x, y = split.select("t", F.col("b").alias("x"), F.col("m").alias("mx")), split.select("t", F.col("b").alias("y"), F.col("m").alias("my"))
    more = x.join(y.hint("merge"), "t").filter((F.col("mx") != F.col("my")) & (F.col("x.c") < F.col("y.c")) & _maybe_similar("x", "y"))
    more = more.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct().join(first.union(near), ["a", "b"], "left_anti")
    return links.union(stage_step(lambda: verified(stage_table(more, "set-pairs"), known, sets_of), "set-links"))


def keep_dissimilar(docs: DataFrame, *, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component of texts whose word shingle sets have Jaccard 0.8 or more.

    All links are verified. Near copies meet by the pivot tables of their fingerprints (four bits), the others in an exact
    prefix filter; the fingerprint filter there (WIDE) passes a pair at Jaccard 0.8 with a chance of at least 0.9999. Sets
    are not kept: they are made again where they are verified. The row that stays has the component's smallest
    key; equal rows leave one; rows without words (null, empty) all stay.
    """
    hashed = docs.withColumn("_cw_text", F.xxhash64(text))

    def found() -> DataFrame:
        def sets_of(some: DataFrame) -> DataFrame:
            wanted = some.select(F.col(key).alias("_cw_k"), F.col("_cw_text").alias("_cw_t"))
            return shingle_sets(hashed.join(wanted, F.col(key).eqNullSafe(F.col("_cw_k")) & (F.col("_cw_text") == F.col("_cw_t")), "left_semi"), width=width, key=key, text=text)

        common = common_shingles(shingle_sets(hashed.filter(F.pmod("_cw_text", F.lit(32)) == 0), width=width, key=key, text=text))
        prefixes = stage_table(shingle_sets(hashed, width=width, key=key, text=text, common=common).withColumnRenamed("shingles", "prefix"), "set-prefixes")
        known = stage_table(prefixes.drop("prefix"), "sets")  # a table of its own: Spark goes by the size of its files
        of = components(similar_links(known, prefixes, sets_of)).withColumnRenamed("node", "c")
        rows = known.select("c", key, "_cw_text").join(of.withColumnRenamed("component", "_cw_of"), "c", "left")
        return rows.groupBy(F.coalesce("_cw_of", "c").alias("component"), key, "_cw_text").count()

    wordless = ~F.coalesce(F.col(text).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    return _first_rows(hashed, stage_step(found, "set-components"), key).union(hashed.filter(wordless)).select(*docs.columns)
