"""The entity graph: mention rows, co-occurrence, scores, nodes, edges and queries over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.components import stage_table
from casewright.operators.ranks import first_rows

PEOPLE_FIELDS = {"partes": "parte", "testigos": "testigo", "víctimas": "victima", "declaraciones": "declarante", "participantes": "participante", "peritos": "perito"}
#: What a chunk with both adds to the score of a pair's ends, and the most that one pair adds.
PAIR, MOST = 3, 20
EDGE_ORDER = ["involucrado", "juridica", "victima", "coocurrencia", "lugar", "lugar_debil", "vehiculo", "vehiculo_debil"]


def people_mentions(results: DataFrame) -> DataFrame:
    """(case_id, chunk, name, source, role, relation) from the people fields, which hold objects, strings or a number."""
    out = None
    for field, source in PEOPLE_FIELDS.items():
        each = results.select("case_id", "chunk", F.explode(F.coalesce(F.try_variant_get("resultado", f"$['{field}']", "array<variant>"), F.array().cast("array<variant>"))).alias("v"))
        get = lambda p: F.try_variant_get("v", p, "string")
        plain = F.when(F.schema_of_variant("v") == "STRING", get("$"))
        name = F.coalesce(get("$.nombre"), get("$.testigo"), plain)
        rows = each.select("case_id", "chunk", name.alias("name"), F.lit(source).alias("source"), get("$.cargo").alias("role"), get("$.relacion").alias("relation")).filter("name is not null and name <> ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def trace_mentions(traces: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions from traces whose alias is known: an inner join drops the others."""
    return traces.join(aliases.select("case_id", "alias", F.col("real_name").alias("name")), ["case_id", "alias"]).select("case_id", F.col("location").alias("chunk"), "name", F.lit("trazabilidad").alias("source"), "role", F.lit(None).cast("string").alias("relation"))


def vehicle_identifier(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (case_id, chunk, tipo, placas) with name: real plates over 3 characters, else the alias in `tipo` resolved."""
    from casewright.functions.names import vehicle_validity

    plates = F.when((F.length("placas") > 3) & ~F.contains(F.upper("placas"), F.lit("VEHICULO_")), F.col("placas"))
    alias = F.upper(F.regexp_extract("tipo", r"(?i)(VEHICULO_\d+)", 1))
    joined = rows.withColumn("alias", alias).join(aliases.select("case_id", "alias", "real_name"), ["case_id", "alias"], "left")
    name = F.coalesce(plates, F.when(vehicle_validity(F.col("real_name"))["valid"], F.col("real_name")))
    return joined.withColumn("name", name).filter("name is not null").drop("alias", "real_name")


def unmentioned_vehicles(aliases: DataFrame, seen: DataFrame, *, least: int = 50) -> DataFrame:
    """Vehicles of the corpus with many mentions that no chunk names; without files."""
    often = aliases.filter((F.col("kind") == "VEHICULO") & (F.col("mentions") >= least)).select("case_id", F.col("real_name").alias("name"), "mentions")
    return often.join(seen.select("case_id", "name").distinct(), ["case_id", "name"], "left_anti").withColumn("files", F.array().cast("array<string>"))


def entity_aggregates(mentions: DataFrame, *, chunks: bool = True) -> DataFrame:
    """(case_id, kind, name, mentions, sources, roles, relations, n_chunks) of mentions (case_id, kind, name, chunk, file,
    source, role, and relation to a victim, if any); without chunks, no n_chunks.

    sources, roles and relations are sorted sets of a vocabulary; what grows with the corpus, files and chunks, is listed
    by with_lists() for the entities that are shown. Mentions are counted by their words, and chunks made distinct, in
    plain aggregates first, so sets are only made of the few words an entity has.
    """
    rows = mentions if "relation" in mentions.columns else mentions.withColumn("relation", F.lit(None).cast("string"))
    some = lambda c: F.sort_array(F.collect_set(c)).alias(c + "s")
    key, out = ["case_id", "kind", "name"], ["source", "role", "relation"]
    counts = rows.groupBy(*key, *out).agg(F.count("*").alias("_m"))
    sums = [F.sum("_m").alias("mentions"), *map(some, out)]
    if chunks:
        places = rows.select(*key, "chunk").filter("chunk is not null").distinct().groupBy(*key).agg(F.count("*").alias("_c"))
        counts = counts.unionByName(places, allowMissingColumns=True)
        sums.append(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_chunks"))
    return counts.groupBy(*key).agg(*sums)


def entity_counts(rows: DataFrame, **sums: str) -> DataFrame:
    """entity_aggregates() of rows (case_id, kind, name, source, role, relation, _m) whose _m add up to the mentions, with
    the sums of more columns by their new names. Rows dealt by case and name are not dealt again."""
    key, out = ["case_id", "kind", "name"], ["source", "role", "relation"]
    names = {"mentions": "_m"} | sums
    counts = rows.groupBy(*key, *out).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in names.items()))
    some = lambda c: F.sort_array(F.collect_set(c)).alias(c + "s")
    return counts.groupBy(*key).agg(*(F.sum(n).alias(n) for n in names), *map(some, out))


def place_mentions(results: DataFrame) -> DataFrame:
    """(case_id, chunk, name, address) from the places of a result, which are objects with a name or plain strings."""
    each = results.select("case_id", "chunk", F.explode(F.coalesce(F.try_variant_get("resultado", "$.ubicaciones", "array<variant>"), F.array().cast("array<variant>"))).alias("v"))
    get = lambda p: F.try_variant_get("v", p, "string")
    name = F.coalesce(get("$.nombre"), F.when(F.schema_of_variant("v") == "STRING", get("$")))
    return each.select("case_id", "chunk", F.trim(name).alias("name"), get("$.direccion").alias("address")).filter("name is not null and name <> ''")


def with_lists(entities: DataFrame, mentions: DataFrame, lists: tuple[str, ...] = ("file", "chunk")) -> DataFrame:
    """entities (few: the top ones) with the sorted distinct files and chunks (as text) that mention them.

    Where entities are a table, Spark sees that they are few and broadcasts them to the mentions."""
    key = ["case_id", "kind", "name"]
    some = lambda c: F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(c + "s")
    held = mentions.join(entities.select(*key), key, "left_semi").groupBy(*key).agg(*map(some, lists))
    return entities.join(held, key, "left")


def chunk_members(*parts: DataFrame) -> DataFrame:
    """(case_id, chunk, kind, name): the distinct union of member rows."""
    out = parts[0].select("case_id", "chunk", "kind", "name")
    for p in parts[1:]:
        out = out.unionByName(p.select("case_id", "chunk", "kind", "name"))
    return out.distinct()


def pairs_within(rows: DataFrame, keys: list[str], name: str, is_a: Column, is_b: Column, *, more: tuple[str, ...] = (), tile: int = 1000) -> DataFrame:
    """(keys, a, b, more of a): every row of keys that is_a with every one that is_b, by an equi join.

    Keys with many rows are cut into tiles of about `tile`, and each two tiles meet in a task of their own, so the pairs
    of one crowded key are spread; the rows of other keys, at most a tile of either side, meet where they are counted,
    without another shuffle.
    """
    every = Window.partitionBy(*keys)
    tiles = lambda rule: F.greatest(F.ceil(F.count_if(rule).over(every) / tile), F.lit(1)).cast("int")
    sized = rows.select("*", tiles(is_a).alias("_ta"), tiles(is_b).alias("_tb"))
    mine = lambda n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    calm = (F.col("_ta") == 1) & (F.col("_tb") == 1)
    listed = lambda rule, *c: F.collect_list(F.when(rule, F.struct(F.col(name).alias(c[0]), *c[1:])))
    groups = sized.filter(calm).groupBy(*keys).agg(listed(is_a, "a", *more).alias("_a"), listed(is_b, "b").alias("_b"))
    near = groups.select(*keys, F.explode("_a").alias("_a"), "_b").select(*keys, "_a.*", F.explode("_b").alias("_b")).select(*keys, "a", *more, "_b.b")
    crowded = sized.filter(~calm)
    a = crowded.filter(is_a).select(*keys, F.col(name).alias("a"), *more, mine("_ta").alias("_x"), all_of("_tb").alias("_y"))
    b = crowded.filter(is_b).select(*keys, F.col(name).alias("b"), all_of("_ta").alias("_x"), mine("_tb").alias("_y"))
    return near.unionByName(a.join(b, [*keys, "_x", "_y"]).drop("_x", "_y"))


def co_occurrence(members: DataFrame, kind_a: str, kind_b: str, *, tile: int = 1000) -> DataFrame:
    """(case_id, a, b, n): chunks that name both; each unordered pair once, counted once a chunk.

    Pairs arise within a chunk only and are summed before the shuffle; those of a crowded chunk arise in tiles.
    """
    kind = F.col("kind")
    rows = members.filter(kind.isin(kind_a, kind_b))
    pairs = pairs_within(rows, ["case_id", "chunk"], "name", kind == kind_a, kind == kind_b, tile=tile)
    if kind_a == kind_b:
        pairs = pairs.filter("a < b")
    return pairs.groupBy("case_id", "a", "b").agg(F.count("*").alias("n"))


def redirect(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts between canonical entities: both ends mapped (case_id, name, principal), self-pairs dropped, summed."""
    one = mapping.select("case_id", F.col("name").alias("a"), F.col("principal").alias("pa"))
    two = mapping.select("case_id", F.col("name").alias("b"), F.col("principal").alias("pb"))
    both = counts.join(one, ["case_id", "a"]).join(two, ["case_id", "b"]).filter("pa <> pb")
    return both.groupBy("case_id", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.sum("n").alias("n"))


def _without_pairs(entities: DataFrame, in_findings: DataFrame) -> DataFrame:
    """entities with _rest: what scores() adds up but for the pairs."""
    found = in_findings.groupBy("case_id", "name").agg(F.count("*").alias("_found"))
    return entities.join(found, ["case_id", "name"], "left").withColumn("_rest", _rest(F.coalesce("_found", F.lit(0)))).drop("_found")


def _rest(found: Column) -> Column:
    return (50 * F.size("roles") + F.when(F.size("relations") > 0, 30).otherwise(0) + 25 * found + F.col("mentions")).cast("long")


def _with_pairs(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """entities (with _rest) with score: _rest and the sum of min(3 n, 20) over pairs."""
    return _with_near(entities, pairs.select("case_id", F.col("a").alias("name"), "n").unionByName(pairs.select("case_id", F.col("b").alias("name"), "n")))


def _with_near(entities: DataFrame, ends: DataFrame) -> DataFrame:
    """entities (with _rest) with score, by the ends of pairs (case_id, name, n)."""
    near = ends.groupBy("case_id", "name").agg(F.sum(F.least(PAIR * F.col("n"), F.lit(MOST))).alias("_near"))
    j = entities.join(near, ["case_id", "name"], "left")
    return j.withColumn("score", (F.col("_rest") + F.coalesce("_near", F.lit(0))).cast("long")).drop("_near", "_rest")


def scores(entities: DataFrame, pairs: DataFrame, in_findings: DataFrame) -> DataFrame:
    """entities with score = 50 roles + 30 (has a victim relation) + sum of min(3 n, 20) over pairs + 25 findings + mentions."""
    return _with_pairs(_without_pairs(entities, in_findings), pairs)


def joined_by(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with few on keys, where null equals null; the keys stay once."""
    other = few.select(*(F.col(k).alias(f"_cw_{k}") if k in keys else k for k in few.columns))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_cw_{k}")) for k in keys))
    return rows.join(other, on, how).drop(*(f"_cw_{k}" for k in keys))


def leading(entities: DataFrame, members: DataFrame, in_findings: DataFrame, *, kind: str, keep: int) -> DataFrame:
    """Those of entities (of one kind) with their score that can be among the `keep` with the largest one of a case: all
    of these, and some more. members: (case_id, chunk, kind, name) of that kind, repeats allowed.

    Pairs can add at most 3 for each other entity of each chunk, and at most 20 for each other entity of the case; the
    former is counted without forming a pair. The 2 `keep` entities with the largest such bound are scored; an entity
    whose bound is below the keep-th of these scores has a smaller score than `keep` others, and the rest, if any, are
    scored too. So pairs arise only in chunks that name one of the few, and the result is exact whatever the counts.
    """
    key = ["case_id", "name"]
    dealt = members.select("case_id", "chunk", "name").repartition("case_id", "chunk").distinct()
    others = dealt.select(*key, (F.count("*").over(Window.partitionBy("case_id", "chunk")) - 1).alias("_o")).groupBy(*key).agg(F.sum("_o").alias("_o"))
    rest = _without_pairs(entities, in_findings).join(others, key, "left")

    def scored(some: DataFrame) -> DataFrame:
        some = stage_table(some, "bounded")
        at = stage_table(members.join(some.select(*key), key, "left_semi").select("case_id", "chunk").distinct(), "chunks")
        return _with_pairs(some, co_occurrence(chunk_members(members.join(at, ["case_id", "chunk"], "left_semi")), kind, kind))

    return _first_by_bounds(stage_table(_bounded(rest), "bounds"), scored, keep)


def leading_listed(counted: DataFrame, lists: DataFrame, members: DataFrame, *, kind: str, keep: int) -> DataFrame:
    """As leading(), where most chunks are rows that list their names. counted: entities of one kind, a table with _o (the
    others of each chunk, summed) and _found (findings); lists: (case_id, names), a row a chunk, names distinct; members:
    (case_id, chunk, kind, name) of all other chunks.

    Pairs of lists arise within their rows, from one of the few on, and are counted without a list of their chunks.
    """
    key = ["case_id", "name"]
    found = F.when(F.col("case_id").isNotNull(), F.coalesce("_found", F.lit(0))).otherwise(0)  # null cases meet nothing, as in joins
    bounded = _bounded(counted.withColumn("_rest", _rest(found)).drop("_found"))

    def scored(some: DataFrame) -> DataFrame:
        some = stage_table(some, "bounded")
        near = lists.select("case_id", F.explode("names").alias("name"), "names").join(some.select(*key), key, "left_semi")
        near = near.select("case_id", "name", F.explode("names").alias("b")).filter("name <> b").groupBy(*key, "b").agg(F.count("*").alias("n"))
        at = stage_table(members.join(some.select(*key), key, "left_semi").select("case_id", "chunk").distinct(), "chunks")
        far = co_occurrence(chunk_members(members.join(at, ["case_id", "chunk"], "left_semi")), kind, kind)
        for x, y in (("a", "b"), ("b", "a")):
            near = near.unionByName(far.select("case_id", F.col(x).alias("name"), F.col(y).alias("b"), "n").join(some.select(*key), key, "left_semi"))
        pairs = near.groupBy(*key, "b").agg(F.sum("n").alias("n"))
        return _with_near(some, pairs)

    return _first_by_bounds(bounded, scored, keep)


def _bounded(rest: DataFrame) -> DataFrame:
    """Entities with _rest and _o: with _bound instead of _o, what their scores cannot exceed."""
    sizes = rest.groupBy("case_id").agg(F.count("*").alias("_all"))
    bound = F.col("_rest") + F.least(PAIR * F.coalesce("_o", F.lit(0)), MOST * (F.col("_all") - 1))
    return rest.join(F.broadcast(sizes), "case_id", "left").withColumn("_bound", bound).drop("_o", "_all")


def _first_by_bounds(bounded: DataFrame, scored: Callable[[DataFrame], DataFrame], keep: int) -> DataFrame:
    """Those of bounded with their score that can be among the first `keep` of a case: see leading()."""
    key, all_of = ["case_id", "name"], Window.partitionBy("case_id")
    first = stage_table(scored(first_rows(bounded, ["case_id"], [F.desc("_bound"), "name"], 2 * keep, "_n").drop("_n")), "leading")
    ranked = first.select("case_id", "score", F.row_number().over(all_of.orderBy(F.desc("score"))).alias("_n"))
    least = ranked.filter(F.col("_n") == keep).select("case_id", F.col("score").alias("_least"))
    more = joined_by(joined_by(bounded, F.broadcast(least), ["case_id"]).filter("_bound >= _least").drop("_least"), first.select(*key), key, "left_anti")
    if more.isEmpty():
        return first.drop("_bound")
    return first.unionByName(scored(more)).drop("_bound")


def top_entities(entities: DataFrame, keep: dict[str, int]) -> DataFrame:
    """The first N of each kind: people by score, others by mentions, then name.

    The largest limit is a constant for all kinds, so each task keeps that many rows of a part of a case and kind before
    the shuffle; the entities are read once.
    """
    measure = F.when(F.col("kind") == "PERSONA", F.col("score")).otherwise(F.col("mentions"))
    kinds = entities.filter(F.col("kind").isin(*keep))
    first = first_rows(kinds.withColumn("_cw_by", measure), ["case_id", "kind"], [F.desc("_cw_by"), "name"], max(keep.values()), "rank")
    limit = reduce(lambda c, k: c.when(F.col("kind") == k, keep[k]), keep, F.when(F.lit(False), 0))
    return first.filter(F.col("rank") <= limit).drop("_cw_by")


def nodes(entities: DataFrame, findings: DataFrame, facts: DataFrame, *, label: int = 38) -> DataFrame:
    """(case_id, id, group, label, mentions, files, chunks, roles, sources): entities (with_lists()), findings and facts;
    ids by one key function everywhere. Findings and facts have the file and chunk of their place, and neither roles nor
    sources."""
    from casewright.functions.names import slug

    short = lambda c: F.when(F.length(c) > label, F.concat(F.substring(c, 1, label - 3), F.lit("..."))).otherwise(F.col(c))
    one = lambda c: F.array(F.col(c).cast("string"))
    e = entities.select("case_id", F.concat_ws("_", "kind", slug(F.col("name"))).alias("id"), F.lower("kind").alias("group"), short("name").alias("label"), "mentions", "files", "chunks", "roles", "sources")
    f = findings.select("case_id", F.col("finding_id").alias("id"), F.lit("hallazgo").alias("group"), short("description").alias("label"), one("location.file").alias("files"), one("location.chunk").alias("chunks"))
    held = facts.groupBy("case_id", "chunk").agg(F.min("file").alias("file"))
    h = held.select("case_id", F.concat(F.lit("HECHO_"), F.col("chunk").cast("string")).alias("id"), F.lit("hecho").alias("group"), F.concat(F.lit("hecho "), F.col("chunk").cast("string")).alias("label"), one("file").alias("files"), one("chunk").alias("chunks"))
    return e.unionByName(f, allowMissingColumns=True).unionByName(h, allowMissingColumns=True)


def involved_edges(findings: DataFrame, top: DataFrame) -> DataFrame:
    each = findings.select("case_id", F.col("finding_id").alias("src"), F.explode("people").alias("name"))
    return each.join(top.select("case_id", "name"), ["case_id", "name"], "left_semi").select("case_id", "src", F.col("name").alias("dst"), F.lit("involucrado").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("label"))


def juridical_edges(role_holders: DataFrame, *, tile: int = 1000) -> DataFrame:
    """Pairs of people with a role in one chunk (case_id, chunk, name, role); label: the first person's first role."""
    one = role_holders.groupBy("case_id", "chunk", "name").agg(F.min("role").alias("role"))
    pairs = pairs_within(one, ["case_id", "chunk"], "name", F.lit(True), F.lit(True), more=("role",), tile=tile).filter("a < b")
    return pairs.groupBy("case_id", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("role").alias("label"), F.count("*").alias("n")).withColumn("kind", F.lit("juridica"))


def victim_edges(mentions: DataFrame) -> DataFrame:
    rows = mentions.filter("relation is not null")
    return rows.select("case_id", F.col("name").alias("src"), F.concat(F.lit("HECHO_"), F.col("chunk").cast("string")).alias("dst"), F.col("relation").alias("label"), F.lit("victima").alias("kind"), F.lit(1).cast("long").alias("n")).distinct()


def co_occurrence_edges(pairs: DataFrame, *, least: int = 2, double_count: bool = False) -> DataFrame:
    """Edges of pairs in at least `least` chunks; width min(n + 1, 4). double_count counts each chunk from both ends."""
    n = F.col("n") * (2 if double_count else 1)
    return pairs.withColumn("n", n).filter(F.col("n") >= least).select("case_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("coocurrencia").alias("kind"), "n", F.least(F.col("n") + 1, F.lit(4)).alias("width"))


def strong_and_weak(strong: DataFrame, people: DataFrame, things: DataFrame, kind: str, *, most: int = 200) -> DataFrame:
    """Edges of people to things: strong ones share a chunk (case_id, a, b, n); weak ones only a file, the first `most`
    new ones of a case by name. people, things: (case_id, name, files)."""
    s = strong.select("case_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(kind).alias("kind"), "n")
    p = people.select("case_id", F.col("name").alias("src"), F.explode("files").alias("file"))
    t = things.select("case_id", F.col("name").alias("dst"), F.explode("files").alias("file"))
    shared = p.join(t, ["case_id", "file"]).groupBy("case_id", "src", "dst").agg(F.count("*").alias("n")).join(s.select("case_id", "src", "dst"), ["case_id", "src", "dst"], "left_anti")
    first = shared.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy("src", "dst"))).filter(F.col("_r") <= most)
    return s.unionByName(first.select("case_id", "src", "dst", F.lit(kind + "_debil").alias("kind"), "n"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge an unordered pair: the earliest kind wins, then the larger count."""
    order = F.array_position(F.array(*map(F.lit, EDGE_ORDER)), F.col("kind"))
    w = Window.partitionBy("case_id", F.least("src", "dst"), F.greatest("src", "dst")).orderBy(order, F.desc("n"), "src", "dst")
    return edges.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def graph_stats(n: DataFrame, e: DataFrame) -> DataFrame:
    a = n.groupBy("case_id").agg(F.count("*").alias("n_nodes"), *(F.count_if(F.col("group") == g).alias(f"n_{g}") for g in ("persona", "vehiculo", "lugar", "hallazgo", "hecho")))
    b = e.groupBy("case_id").agg(F.count("*").alias("n_edges"), *(F.count_if(F.col("kind") == k).alias(f"n_edge_{k}") for k in EDGE_ORDER))
    return a.join(b, "case_id", "left").na.fill(0)


def group_counts(n: DataFrame) -> DataFrame:
    return n.groupBy("case_id", "group").agg(F.count("*").alias("n"))


def degree(e: DataFrame) -> DataFrame:
    ends = e.select("case_id", F.col("src").alias("id")).unionByName(e.select("case_id", F.col("dst").alias("id")))
    return ends.groupBy("case_id", "id").agg(F.count("*").alias("degree"))


def most_connected(e: DataFrame, *, keep: int = 10) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(F.desc("degree"), "id")
    return degree(e).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def label_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("case_id", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "case_id", "kind")


def connected_nodes(n: DataFrame, e: DataFrame, *, isolated: bool = False) -> DataFrame:
    ends = e.select("case_id", F.col("src").alias("id")).unionByName(e.select("case_id", F.col("dst").alias("id"))).distinct()
    return n.join(ends, ["case_id", "id"], "left_anti" if isolated else "left_semi")


def induced(n: DataFrame, e: DataFrame, *, group: str | None = None, search: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a group or with a text in label or id, and the edges between them."""
    kept = n
    if group:
        kept = kept.filter(F.col("group") == group)
    if search:
        kept = kept.filter(F.contains(F.lower("label"), F.lit(search.lower())) | F.contains(F.lower("id"), F.lit(search.lower())))
    ids = kept.select("case_id", "id").distinct()
    inner = e.join(ids.withColumnRenamed("id", "src"), ["case_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["case_id", "dst"], "left_semi")
    return kept, inner
