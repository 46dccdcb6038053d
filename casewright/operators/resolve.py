"""Entity quality and resolution: filters, duplicates, similarity clusters, canonical names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.names import jaccard, normalize_name, person_validity, vehicle_validity
from casewright.operators.components import components, stage_table


def judged(entities: DataFrame, *, name: str = "name", mentions: str = "mentions") -> DataFrame:
    """entities (kind, name, mentions) with valid and reason, by the rules of the kind; places by length and mentions."""
    place = F.struct(((F.length(name) >= 5) & (F.col(mentions) >= 1)).alias("valid"), F.when((F.length(name) < 5) | (F.col(mentions) < 1), "short_or_unmentioned").alias("reason"))
    verdict = F.when(F.col("kind") == "PERSONA", person_validity(F.col(name), F.col(mentions))).when(F.col("kind") == "VEHICULO", vehicle_validity(F.col(name))).otherwise(place)
    return entities.withColumn("_v", verdict).select(*entities.columns, F.col("_v.valid").alias("valid"), F.col("_v.reason").alias("reason"))


def quality_counts(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("case_id", "kind", "valid", "reason").agg(F.count("*").alias("n"))


def merge_equal(entities: DataFrame) -> DataFrame:
    """(case_id, kind, norm, principal, aliases, mentions): entities with one normalised name; the most mentioned leads."""
    lead = F.max_by("name", F.struct("mentions", F.length("name"), "name"))
    keyed = entities.withColumn("norm", normalize_name(F.col("name")))
    return keyed.groupBy("case_id", "kind", "norm").agg(lead.alias("principal"), F.sort_array(F.collect_set("name")).alias("aliases"), F.sum("mentions").alias("mentions"))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the matching blocks; not symmetric, so pairs come in a stated order."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def edit_ratio(a: Column, b: Column) -> Column:
    """The native alternative: 1 - edit distance / length of the longer."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


SEGMENT = ["case_id", "ns", "nl", "i", "seg"]


def segment_index(names: DataFrame, *, threshold: float, native: bool = False) -> tuple[DataFrame, DataFrame]:
    """(SEGMENT, x, mx) and (SEGMENT, y, my): where names (case_id, norm, mentions) that can have the ratio meet, x the shorter.

    A matching ratio >= t leaves at most d = (1 - t)(|x| + |y|) signs to insert or delete (an edit ratio >= t at most
    (1 - t)|y| edits). The shorter name is cut into d + 1 segments. As edits are counted from the left, some segment i
    has none of its own and exactly i before it; it therefore stands whole in the longer name, moved by i, i - 2 … -i
    signs (by up to i for edits), so far as the other d - i edits can make up the rest of the difference in length.
    Names meet where one has such a segment, its number, place and both lengths in common with the other: exact, and no
    two names are compared without a common segment. Only lengths that some name of the case has are entered.
    """
    t, eps = threshold, 1e-9
    base = names.select("case_id", "norm", "mentions", F.length("norm").alias("n"))
    longest = F.floor(F.col("n") * (1 / t if native else (2 - t) / t) + eps).cast("int")
    shortest = F.greatest(F.ceil(F.col("n") * (t if native else t / (2 - t)) - eps).cast("int"), F.lit(0))
    edits = F.floor((1 - t) * (F.col("nl") if native else F.col("ns") + F.col("nl")) + eps).cast("int")
    cut = lambda i: F.floor(i * F.col("ns") / (F.col("d") + 1)).cast("int")

    def segments(df: DataFrame) -> DataFrame:
        each = df.withColumn("d", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        return each.withColumn("at", cut(F.col("i"))).withColumn("size", cut(F.col("i") + 1) - F.col("at"))

    found = base.select("case_id", "n").distinct()
    has = lambda df, c: df.join(F.broadcast(found.withColumnRenamed("n", c)), ["case_id", c], "left_semi")
    short = segments(has(base.withColumnRenamed("n", "ns").withColumn("n", F.col("ns")).withColumn("nl", F.explode(F.sequence(F.col("n"), longest))), "nl"))
    short = short.select("case_id", "ns", "nl", "i", F.substring(F.col("norm"), F.col("at") + 1, F.col("size")).alias("seg"), F.col("norm").alias("x"), F.col("mentions").alias("mx"))
    whole = segments(has(base.withColumn("nl", F.col("n")).withColumn("ns", F.explode(F.sequence(shortest, F.col("n")))), "ns"))
    moves = F.filter(F.sequence(-F.col("i"), F.col("i"), F.lit(1 if native else 2)), lambda m: (F.abs(F.col("nl") - F.col("ns") - m) <= F.col("d") - F.col("i")) & (F.col("at") + m >= 0) & (F.col("at") + m + F.col("size") <= F.col("nl")))
    moved = whole.withColumn("m", F.explode(moves))
    moved = moved.select("case_id", "ns", "nl", "i", F.substring(F.col("norm"), F.col("at") + F.col("m") + 1, F.col("size")).alias("seg"), F.col("norm").alias("y"), F.col("mentions").alias("my"))
    return short, moved


def candidate_pairs(names: DataFrame, *, threshold: float, native: bool = False) -> DataFrame:
    """(case_id, x, mx, y, my): every two names that meet in segment_index(). A crowded segment is split by Spark's
    handling of skewed joins."""
    short, moved = segment_index(names, threshold=threshold, native=native)
    return short.join(moved, SEGMENT).filter("x <> y").select("case_id", "x", "mx", "y", "my").distinct()


def similar_pairs(names: DataFrame, *, threshold: float = 0.8, native: bool = False) -> DataFrame:
    """(case_id, a, b, ratio): pairs of normalised names (case_id, norm, mentions) at or over the threshold.

    Candidates share a segment; a bound on letter counts (exact too) comes before the ratio. The matching ratio is not
    symmetric: a is the more mentioned, then the smaller name.
    """
    return similar_among(candidate_pairs(names, threshold=threshold, native=native), threshold=threshold, native=native)


def similar_among(found: DataFrame, *, threshold: float = 0.8, native: bool = False) -> DataFrame:
    """Those of candidate_pairs() at or over the threshold; see similar_pairs()."""
    first = (F.col("mx") > F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("x") < F.col("y")))
    pairs = found.select("case_id", F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))
    # short rows, but long work on each: Spark would put them into few tasks by their size
    pairs = pairs.repartition(2 * found.sparkSession.sparkContext.defaultParallelism, "case_id", "a", "b").distinct()
    shared = F.aggregate(F.zip_with(letters("a"), letters("b"), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    kept = pairs.filter(2 * shared >= threshold * (F.length("a") + F.length("b")) - 1e-9)
    ratio = edit_ratio(F.col("a"), F.col("b")) if native else matching_ratio("a", "b")
    return kept.withColumn("ratio", ratio).filter(F.col("ratio") >= threshold)


def jaccard_pairs(names: DataFrame, *, name: str = "norm", tenths: int = 3) -> DataFrame:
    """(a, b), a < b: names whose word sets have Jaccard tenths / 10 or more.

    Such sets share one of their first n - ceil(n tenths / 10) + 1 words, rarest words first, so names meet there only
    (exact); each pair is then verified.
    """
    sets = names.select(F.col(name).alias("a")).distinct().select("a", F.array_distinct(F.split("a", " ")).alias("ws"))
    each = sets.select("a", F.explode("ws").alias("w"))
    ranked = each.join(each.groupBy("w").count(), "w").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("count", "w"))).alias("ws"))
    n = F.size("ws")
    firsts = ranked.select("a", n.alias("na"), F.explode(F.slice("ws", F.lit(1), n - F.ceil(n * tenths / 10).cast("int") + 1)).alias("x"))
    left = firsts.select("a", "na", F.col("x.w").alias("w"))
    right = left.withColumnsRenamed({"a": "b", "na": "nb"})
    long_enough = F.least("na", "nb") * 10 >= F.greatest("na", "nb") * tenths
    pairs = left.join(right, "w").filter((F.col("a") < F.col("b")) & long_enough).select("a", "b").distinct()
    return pairs.filter(jaccard(F.col("a"), F.col("b")) >= tenths / 10)


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letters(c: str) -> Column:
    """Counts of the letters of a normalised name, and of all others together."""
    each = [F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit(""))) for x in LETTERS]
    return F.array(*each, F.length(F.translate(F.col(c), LETTERS, "")))


def connected(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(case_id, node, component) of nodes (case_id, node) over pairs (case_id, a, b): the smallest reachable node."""
    of = lambda c: F.struct("case_id", F.col(c).alias("node"))
    links = pairs.select(of("a").alias("a"), of("b").alias("b")).union(nodes.select(of("node").alias("a"), of("node").alias("b")))
    found = components(links)
    return found.select("node.case_id", "node.node", F.col("component.node").alias("component"))


def same_start(nodes: DataFrame, *, threshold: float) -> DataFrame:
    """(case_id, node, component): names (under 200 signs) of one length that share more than threshold of it as a prefix.

    That block alone takes any two of them over the threshold, by either ratio, so none needs to be compared: they have
    the smallest of them as their component.
    """
    n = F.length("node")
    start = F.when(n < 200, F.substring(F.col("node"), F.lit(1), F.floor(threshold * n + 1e-9).cast("int") + 1)).otherwise(F.col("node"))
    keyed = nodes.select("case_id", "node", n.alias("n"), start.alias("start"))
    return keyed.join(keyed.groupBy("case_id", "n", "start").agg(F.min("node").alias("component")), ["case_id", "n", "start"], "left").select("case_id", "node", F.coalesce("component", "node").alias("component"))


def similar_clusters(names: DataFrame, *, threshold: float = 0.8, native: bool = False, rounds: int = 6) -> DataFrame:
    """(case_id, node, component): connected() over similar_pairs(), without forming pairs that are connected already.

    Names of same_start() are linked first. In each round a segment's components, by one name each, meet only its heads, a
    name of either side chosen by a hash of its component, so numbered names, all of them near each other, become one
    component at a cost far below their number. When that links nothing all names of a segment meet its heads, in
    rounds too. Segments whose names have one component are done. When such a round links nothing, or after `rounds`, all
    pairs of different components that still share a segment are compared: exact, whatever the rounds found.
    """
    rule = {"threshold": threshold, "native": native}
    nodes = names.select("case_id", F.col("norm").alias("node")).distinct()
    short, moved = segment_index(names, **rule)
    entry = lambda df, n, m, longer: df.select(*SEGMENT, F.col(n).alias("node"), F.col(m).alias("mentions"), F.lit(longer).alias("longer"))
    cells = stage_table(entry(short, "x", "mx", False).unionByName(entry(moved, "y", "my", True)).distinct(), "segments")
    found = stage_table(same_start(nodes, threshold=threshold), "name-components")
    links = found.filter("node <> component").select("case_id", F.col("component").alias("a"), F.col("node").alias("b"))
    turn, few = 0, True
    while True:
        who, order = F.struct("node", "mentions", "component"), F.xxhash64(F.lit(turn), "i", "component", "node")
        head = lambda longer: F.min_by(F.when(F.col("longer") == longer, who), F.when(F.col("longer") == longer, order))
        placed = cells.join(found, ["case_id", "node"])
        heads = placed.groupBy(*SEGMENT).agg(head(False).alias("hx"), head(True).alias("hy"), F.min("component").alias("low"), F.max("component").alias("top"))
        open_ = heads.filter("low < top and hx is not null and hy is not null").drop("low", "top")
        placed = stage_table(placed.join(open_, SEGMENT), "segments")
        cells = placed.select(*cells.columns)
        pair = lambda x, y: (F.col(f"{x}node").alias("x"), F.col(f"{x}mentions").alias("mx"), F.col(f"{y}node").alias("y"), F.col(f"{y}mentions").alias("my"))
        if turn < rounds:
            met = placed.filter(F.when(F.col("longer"), F.col("component") != F.col("hx.component")).otherwise(F.col("component") != F.col("hy.component")))
            if few:  # one name of each component; heads are the same in all rows of a segment
                one = F.min_by(F.struct("node", "mentions", "hx", "hy"), order).alias("one")
                met = met.groupBy(*SEGMENT, "longer", "component").agg(one).select("case_id", "longer", "component", "one.*")
            to_y = met.filter("not longer").select("case_id", *pair("", "hy."))
            to_x = met.filter("longer").select("case_id", *pair("hx.", ""))
            pairs = to_y.union(to_x).distinct()
            more = stage_table(similar_among(pairs, **rule).select("case_id", "a", "b"), "name-links")
        none = turn < rounds and more.isEmpty()
        turn += 1
        if few and none:
            few = False
            continue
        if none or turn > rounds:
            side = lambda longer, x, m, c: placed.filter(F.col("longer") == longer).select(*SEGMENT, F.col("node").alias(x), F.col("mentions").alias(m), F.col("component").alias(c))
            rest = side(False, "x", "mx", "cx").join(side(True, "y", "my", "cy"), SEGMENT).filter("cx <> cy").select("case_id", "x", "mx", "y", "my").distinct()
            more = stage_table(similar_among(rest, **rule).select("case_id", "a", "b"), "name-links")
            return found if more.isEmpty() else connected(nodes, links.union(more))
        links = links.union(more)
        found = stage_table(connected(nodes, links), "name-components")


def canonical_entities(merged: DataFrame, clusters: DataFrame, *, preferred: list[str] | None = None) -> DataFrame:
    """(case_id, component, principal, canonical, aliases, mentions) of clusters (case_id, node = norm, component).

    principal: most mentions, then longest; canonical: a variant with a preferred token first, else the longest one
    without a line break.
    """
    j = merged.withColumnRenamed("principal", "variant").join(clusters.withColumnRenamed("node", "norm"), ["case_id", "norm"])
    tokens = F.array(*map(F.lit, preferred)) if preferred else F.array().cast("array<string>")
    liked = F.exists(tokens, lambda t: F.contains(F.col("variant"), t)).cast("int")
    clean = (~F.contains("variant", F.lit("\n"))).cast("int")
    return j.groupBy("case_id", "component").agg(
        F.max_by("variant", F.struct("mentions", F.length("variant"), "variant")).alias("principal"),
        F.max_by("variant", F.struct(clean, liked, F.length("variant"), "variant")).alias("canonical"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.sum("mentions").alias("mentions"),
    )


def canonical_mapping(members: DataFrame, canonical: DataFrame) -> DataFrame:
    """(case_id, name, principal): null where no canonical entity has the name."""
    each = canonical.select("case_id", F.explode("aliases").alias("name"), "principal")
    return members.select("case_id", "name").distinct().join(each, ["case_id", "name"], "left")
