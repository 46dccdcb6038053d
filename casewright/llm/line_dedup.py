"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. Tokens get one global order, rare ones first: how often each of `BUCKETS`
token buckets occurs in the corpus is counted once, and a token's key is its bucket's rarity level followed by its hash.
Equal sets collapse to one class, numbered in the order of the classes' first lines. Two sets with Jaccard similarity
>= t share one of their first n - ceil(t n) + 1 tokens in that order (prefix filter); the position of the shared token
bounds the overlap (positional filter), and so do the sizes (length filter) and 128-bit parity sketches: each token
flips one bit, so two sets differ in at least as many tokens as their sketches differ in bits. Survivors are verified on
their tokens.

A line goes if any earlier line is near, so a class needs one witness and not all its near classes. Each class first
meets only the earliest classes that share one of four heads of its prefix, which settles groups of near copies in
proportion to their members; the join of all prefixes then leaves out every pair whose later class is settled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.shared import stage_step, stage_table

BUCKETS = 1 << 16
#: Bits of a key that hold the rarity level; the others hold the token's hash.
LEVEL_BITS = 7
HASH = (1 << (64 - LEVEL_BITS)) - 1


def words(line: Column) -> Column:
    """Words of a line: runs without ASCII white space, lower-cased; may hold empty strings."""
    for space in "\t\x0b\f\r":
        line = F.replace(line, F.lit(space), F.lit(" "))
    return F.split(F.lower(line), " ", -1)


def rarity(docs: DataFrame, text: str) -> list[int]:
    """The rarity level of each token bucket over all texts: BUCKETS numbers, whatever the size of the corpus.

    A level is half a power of two of the bucket's count, so it stays below 2**LEVEL_BITS for any 64-bit count. The
    numbers stand in every plan that tokenizes, and Spark prints plans for its events: small ones keep these short.
    """
    tokens = docs.select(F.explode(words(F.replace(F.col(text), F.lit("\n"), F.lit(" ")))).alias("w"))
    counted = tokens.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count()
    found = {r["b"]: r["count"] for r in counted.collect()}  # BUCKETS rows at most
    return [int(2 * math.log2(1 + found.get(b, 0))) for b in range(BUCKETS)]


def token_keys(line: Column, levels: list[int]) -> Column:
    """Sorted distinct token keys of a line, the rarest first: LEVEL_BITS bits of level, then the hash's upper 57 bits.

    Words are hashed once and take their levels once they are distinct; no step yields a null, so Spark sorts
    primitive arrays. The lowest level has the sign bit, so that keys sort as they are.
    """
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<tinyint>")

    def leveled(h: Column) -> Column:
        level = F.element_at(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1)
        signed = F.coalesce(level, F.lit(0).cast("tinyint")).cast("bigint") - (1 << (LEVEL_BITS - 1))
        return F.shiftleft(signed, 64 - LEVEL_BITS).bitwiseOR(F.shiftrightunsigned(h, LEVEL_BITS))

    hashes = F.array_remove(F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return F.sort_array(F.transform(hashes, leveled))


def has_word(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\x0b\f\r")) != ""


WIDE = 96


def sketch(keys: Column, half: int | None) -> Column:
    """Parity sketch: bit (hash mod 64) flipped for each token, or for those of one half of the hash space."""
    zero = F.lit(0).cast("bigint")
    flip = lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), k.bitwiseAND(F.lit(63)).cast("int")))
    tokens = keys if half is None else F.filter(keys, lambda k: F.getbit(k, F.lit(6)) == half)
    return F.aggregate(tokens, zero, flip)


def line_classes(docs: DataFrame, levels: list[int], *, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The distinct token sets, written once: (cid, n, s, u, prefix, first); first: position of the earliest line.

    A position is (key, text hash, line number), and cid rises with it. s, u: sketches (of both halves for sets over
    WIDE tokens, else of all and 0). A set is known by its hash, size and sketches, some 190 bits. The aggregate is
    partial before the shuffle, so a line in a third of all documents is one row a task; of a set only its prefix is
    shuffled, as whole keys, so unrelated tokens don't meet however many there are.
    """
    lines = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("r"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("l", "line"))
    # blank lines go before their words are looked for: a condition on the keys would compute these twice
    keyed = lines.filter(has_word(F.col("line"))).select("k", "r", "l", token_keys(F.col("line"), levels).alias("keys"))
    wide = F.size("keys") > WIDE
    prefix = F.slice("keys", F.lit(1), F.size("keys") - F.ceil(threshold * F.size("keys") - 1e-9).cast("int") + 1)
    s = F.when(wide, sketch(F.col("keys"), 0)).otherwise(sketch(F.col("keys"), None))
    u = F.when(wide, sketch(F.col("keys"), 1)).otherwise(F.lit(0).cast("bigint"))
    rows = keyed.select(F.xxhash64("keys").alias("h"), F.size("keys").alias("n"), s.alias("s"), u.alias("u"), prefix.alias("prefix"), F.struct("k", "r", "l").alias("first"))
    classes = rows.groupBy("h", "n", "s", "u").agg(F.first("prefix").alias("prefix"), F.min("first").alias("first"))
    ordered = classes.select("n", "s", "u", "prefix", "first").orderBy("first")
    return stage_table(ordered.select(F.monotonically_increasing_id().alias("cid"), "*"), "line-classes")


def _maybe_near(threshold: float, x: str, y: str) -> Column:
    """Length and sketch filters on classes with columns n, s and u, prefixed by x and y; exact."""
    t = F.lit(threshold)
    na, nb = F.col(f"n{x}"), F.col(f"n{y}")
    s, u = F.col(f"s{x}").bitwiseXOR(F.col(f"s{y}")), F.col(f"u{x}").bitwiseXOR(F.col(f"u{y}"))
    both = F.least(na, nb) > WIDE
    differ = F.when(both, F.bit_count(s) + F.bit_count(u)).otherwise(F.bit_count(s.bitwiseXOR(u)))
    return (F.least(na, nb) >= t * F.greatest(na, nb) - 1e-9) & (differ <= na + nb - 2 * _need(threshold, x, y))


def _need(threshold: float, x: str, y: str) -> Column:
    """The least overlap of two sets at the threshold."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col(f"n{x}") + F.col(f"n{y}")) - 1e-9)


def first_witnesses(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each class b and the earliest class a with the same head, if a comes before b and the filters let the
    pair pass. Heads: the smallest and largest hash, the middle and the last token's of the prefix."""
    middle = F.element_at("p", F.floor(F.size("p") / 2).cast("int") + 1)
    four = F.array(F.array_min("p"), F.array_max("p"), middle, F.element_at("p", -1))
    hashed = classes.select("cid", "n", "s", "u", F.transform("prefix", lambda k: k.bitwiseAND(F.lit(HASH))).alias("p"))
    heads = hashed.select("cid", "n", "s", "u", F.explode(F.array_distinct(four)).alias("head"))
    led = heads.groupBy("head").agg(F.min("cid").alias("a"), F.max("cid").alias("top"), *(F.min_by(c, "cid").alias(f"{c}a") for c in ("n", "s", "u"))).filter("a < top").drop("top")
    each = heads.select("head", F.col("cid").alias("b"), *(F.col(c).alias(f"{c}b") for c in ("n", "s", "u")))
    return each.join(led, "head").filter((F.col("a") < F.col("b")) & _maybe_near(threshold, "a", "b")).select("a", "b").distinct()


def candidate_pairs(classes: DataFrame, settled: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a before b: pairs of classes that the prefix, length, positional and sketch filters leave, without those
    whose later class is in `settled` (b)."""
    done = settled.select(F.col("b").alias("cid"), F.lit(True).alias("done"))
    marked = classes.join(done, "cid", "left")
    # two narrow fields: class and mark, size and place
    index = marked.select(F.shiftleft("cid", 1).bitwiseOR(F.col("done").isNotNull().cast("bigint")).alias("c"), F.col("n").cast("bigint").alias("n"), "s", "u", F.posexplode("prefix").alias("i", "key"))
    index = index.select("key", "c", F.shiftleft("n", 32).bitwiseOR(F.col("i").cast("bigint")).alias("p"), "s", "u")
    side = lambda v: index.select(F.col("key").alias(f"key{v}"), *(F.col(k).alias(f"{k}{v}") for k in ("c", "p", "s", "u")))
    n, i = (lambda v: F.shiftright(f"p{v}", 32)), (lambda v: F.col(f"p{v}").bitwiseAND(F.lit(0xFFFFFFFF)))
    # the smaller set, x, shares at least 2t / (1 + t) of its tokens, so a shorter prefix of it will do
    short = i("x") <= n("x") - F.ceil(F.lit(2 * threshold / (1 + threshold)) * n("x") - 1e-9)
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (n("x") + n("y")) - 1e-9)
    later = F.greatest("cx", "cy")
    s, u = F.col("sx").bitwiseXOR(F.col("sy")), F.col("ux").bitwiseXOR(F.col("uy"))
    differ = F.when(n("x") > WIDE, F.bit_count(s) + F.bit_count(u)).otherwise(F.bit_count(s.bitwiseXOR(u)))
    keep = (n("x") < n("y")) | ((n("x") == n("y")) & (F.col("cx") < F.col("cy")))  # x: the smaller set
    keep &= (n("x") >= threshold * n("y") - 1e-9) & (F.least(n("x") - i("x"), n("y") - i("y")) >= need)
    keep &= (later.bitwiseAND(F.lit(1)) == 0) & (differ <= n("x") + n("y") - 2 * need)
    found = side("x").filter(short).join(side("y"), (F.col("keyx") == F.col("keyy")) & keep)
    return found.select(F.shiftright(F.least("cx", "cy"), 1).alias("a"), F.shiftright(F.greatest("cx", "cy"), 1).alias("b")).distinct()


def near(pairs: DataFrame, texts: DataFrame, classes: DataFrame, levels: list[int], threshold: float) -> DataFrame:
    """(b), distinct: the later classes of the pairs (a, b) whose sets have Jaccard similarity >= threshold.

    texts: (_cw_r, _cw_h, _cw_text). Only the first lines of the pairs' classes are tokenized again.
    """
    asked = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid")
    at = asked.groupBy(F.col("first.r").alias("_cw_r"), F.xxhash64("first.k").alias("_cw_h")).agg(F.collect_list(F.struct("cid", F.col("first.l").alias("l"))).alias("at"))
    found = texts.join(at, ["_cw_r", "_cw_h"])
    each = found.select(F.split("_cw_text", "\n", -1).alias("lines"), F.explode("at").alias("p"))
    line = each.select("p.cid", F.element_at("lines", F.col("p.l") + 1).alias("line"))
    sets = stage_table(line.groupBy("cid").agg(F.first("line").alias("line")).select("cid", token_keys(F.col("line"), levels).alias("keys")), "line-sets")
    side = lambda v: sets.select(F.col("cid").alias(v), F.col("keys").alias(f"k{v}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("o", F.size(F.array_intersect("ka", "kb")))
    return both.filter(F.col("o") >= F.lit(threshold) * (F.size("ka") + F.size("kb") - F.col("o")) - 1e-9).select("b").distinct()


def beaten_classes(texts: DataFrame, classes: DataFrame, levels: list[int], threshold: float) -> DataFrame:
    """(b): the classes that are near an earlier one."""

    def found(pairs: DataFrame) -> DataFrame:
        return near(stage_table(pairs, "line-pairs"), texts, classes, levels, threshold)

    settled = stage_step(lambda: found(first_witnesses(classes, threshold)), "lines-settled")
    rest = stage_step(lambda: found(candidate_pairs(classes, settled, threshold)), "lines-settled")
    return settled.union(rest)


def dedup_lines(docs: DataFrame, *, threshold: float = 0.8, key: str = "doc_id", text: str = "text", n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """docs whose texts have lost every line that is near an earlier one; the columns stay as they are.

    Lines are split at `\\n`; lines without a word are never matched and always stay. Lines come in the order of key
    (null first), text hash and line number. A null text stays null; a text that loses every line becomes empty; rows
    that repeat key and text stay and lose the same lines. n_lines, n_removed: names of optional count columns.
    """
    levels = rarity(docs, text)
    classes = line_classes(docs, levels, threshold=threshold, key=key, text=text)
    # hashes of text and key, which are never null, name a text
    marked = docs.select(F.xxhash64(text).alias("_cw_r"), F.xxhash64(key).alias("_cw_h"), *(F.col(c).alias("_cw_text") if c == text else F.col(c) for c in docs.columns))
    texts = marked.filter(F.col("_cw_text").isNotNull()).select("_cw_r", "_cw_h", "_cw_text")
    beaten = beaten_classes(texts, classes, levels, threshold).select(F.col("b").alias("cid"))
    kept = classes.join(beaten, "cid", "left_anti")
    kept = kept.groupBy(F.col("first.r").alias("_cw_r"), F.xxhash64("first.k").alias("_cw_h")).agg(F.collect_list("first.l").alias("_cw_keep"))
    lines = F.split(F.col("_cw_text"), "\n", -1)
    out = marked.join(kept, ["_cw_r", "_cw_h"], "left").withColumn("_cw_lines", lines)
    bare = F.filter(F.transform("_cw_lines", lambda x, i: F.when(~has_word(x), i)), lambda i: i.isNotNull())
    out = out.withColumn("_cw_at", F.sort_array(F.concat(F.coalesce("_cw_keep", F.array().cast("array<int>")), bare)))
    out = out.withColumn("_cw_stays", F.transform("_cw_at", lambda i: F.element_at("_cw_lines", i + 1)))
    known = F.col("_cw_text").isNotNull()
    columns = [F.array_join("_cw_stays", "\n").alias(text) if c == text else F.col(c) for c in docs.columns]
    counts = ((n_lines, F.size("_cw_lines")), (n_removed, F.size("_cw_lines") - F.size("_cw_stays")))
    return out.select(*columns, *(F.when(known, c).alias(name) for name, c in counts if name))
