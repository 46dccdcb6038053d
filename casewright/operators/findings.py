"""Findings: flatten, clean, consolidate, rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import fixed
from casewright.functions.names import finding_key, vehicle_validity, weak_finding
from casewright.operators.components import stage_table
from casewright.operators.graph import joined_by
from casewright.operators.ranks import first_rows, numbered

CATEGORIES = {"inconsistencias": "INC", "incongruencias": "ING", "declaracion_vs_evidencia": "DEV"}
SYNONYMS = {"declaracion_vs_evidencia": "discrepancias"}


def flatten(results: DataFrame) -> DataFrame:
    """(case_id, category, seq, type, severity, description, people, location): one row a finding.

    results: (case_id, seq, chunk struct<archivo, chunk, inicio, fin>, resultado variant); null results give no row.
    """
    def part(name: str, key: str) -> DataFrame:
        each = results.filter("resultado is not null").select("case_id", "seq", "chunk", F.explode(F.coalesce(F.try_variant_get("resultado", f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))).alias("v"))
        text = lambda path: F.try_variant_get("v", path, "string")
        people = F.coalesce(F.try_variant_get("v", "$.personas_involucradas", "array<string>"), F.when(text("$.persona").isNotNull(), F.array(text("$.persona"))), F.array().cast("array<string>"))
        return each.select("case_id", F.lit(name).alias("category"), "seq", text("$.tipo").alias("type"), text("$.severidad").alias("severity"), text("$.descripcion").alias("description"), people.alias("people"), F.col("chunk").alias("location"))

    out = None
    for name in CATEGORIES:
        for key in (name, SYNONYMS.get(name)):
            if key:
                out = part(name, key) if out is None else out.unionByName(part(name, key))
    return out


#: How many actions, people, vehicles and locations of a trace are shown.
SHOWN = {"actions": 5, "people": 10, "vehicles": 5, "locations": 10}


def trace_items(traces: DataFrame) -> DataFrame:
    """(case_id, alias, part, value, seq, pos) of traces (case_id, seq, alias, role, actions, people, vehicles, location):
    every distinct action, person and vehicle of an alias, one row each, and the trace and place where it comes first."""
    out = None
    for part in ("actions", "people", "vehicles"):
        each = traces.select("case_id", "alias", F.lit(part).alias("part"), "seq", F.posexplode(part).alias("pos", "value"))
        out = each if out is None else out.unionByName(each)
    first = out.groupBy("case_id", "alias", "part", "value").agg(F.min(F.struct("seq", "pos")).alias("f"))
    return first.select("case_id", "alias", "part", "value", "f.seq", "f.pos")


def trace_locations(traces: DataFrame) -> DataFrame:
    """(case_id, alias, seq, location): where an alias has traces, one row each."""
    return traces.select("case_id", "alias", "seq", "location")


def merge_traces(traces: DataFrame) -> DataFrame:
    """(case_id, alias, role, n_actions, n_people, n_vehicles, n_locations, actions, people, vehicles, locations).

    role: the first one; counts of distinct values; the lists hold the first SHOWN of them, actions and locations in
    their order, people and vehicles by name, so no row grows with the table. trace_items() and trace_locations() hold
    all of them.
    """
    keys = ["case_id", "alias"]
    items, parts = trace_items(traces), ("actions", "people", "vehicles")
    n = items.groupBy(*keys).agg(*(F.count_if(F.col("part") == p).alias(f"n_{p}") for p in parts))
    out = traces.groupBy(*keys).agg(F.min_by("role", "seq").alias("role"), F.count("*").alias("n_locations")).join(n, keys, "left").na.fill(0, [f"n_{p}" for p in parts])
    for p in (*parts, "locations"):
        rows = trace_locations(traces).withColumnRenamed("location", "value") if p == "locations" else items.filter(F.col("part") == p).drop("part")
        order = ["seq", *(["pos"] if p == "actions" else []), "value"] if p in ("actions", "locations") else ["value"]
        few = first_rows(rows, keys, order, SHOWN[p], "_n").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda s: s["value"]).alias(p))
        out = out.join(few, keys, "left")
    return out.select(*keys, "role", *(f"n_{p}" for p in (*parts, "locations")), *(F.coalesce(p, F.array().cast("array<string>")).alias(p) for p in parts), "locations")


def drop_weak(findings: DataFrame, *, loose: bool = False) -> DataFrame:
    return findings.filter(~weak_finding(F.col("description"), loose=loose))


def clean_people(findings: DataFrame, valid: DataFrame, *, key: str = "seq") -> DataFrame:
    """findings whose people lists keep the names in `valid` (case_id, name), in order."""
    each = findings.select("case_id", key, F.posexplode("people").alias("_at", "name")).join(valid.select("case_id", "name").distinct(), ["case_id", "name"], "left_semi")
    kept = each.groupBy("case_id", key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "name"))), lambda s: s["name"]).alias("_kept"))
    return findings.join(kept, ["case_id", key], "left").withColumn("people", F.coalesce("_kept", F.array().cast("array<string>"))).select(*findings.columns)


KEY = ["case_id", "category", "key"]


def with_key(findings: DataFrame) -> DataFrame:
    """findings with the key by which they repeat: white space collapsed, lower case, first 80 characters."""
    return findings.withColumn("key", finding_key(F.col("description")))


def finding_locations(findings: DataFrame) -> DataFrame:
    """(case_id, category, key, seq, location): where each collapsed finding stands, one row each."""
    return with_key(findings).select(*KEY, "seq", "location")


def collapse(findings: DataFrame, *, most: int | None = 10) -> DataFrame:
    """One row a (case, category, key): the first row by seq, its first `most` locations in order (None: all of them), and
    the number of repeats.

    Aggregates are partial before the shuffle, and of a key's locations only the first `most` leave a task, so a finding
    that repeats a million times is a row like the others; finding_locations() holds all, one row each. With None such a
    finding's row holds a million places, but its texts still leave a task once.
    """
    first = F.min_by(F.struct("type", "severity", "description", "people"), "seq").alias("f")
    out = with_key(findings).groupBy(*KEY).agg(first, F.min("seq").alias("seq"), F.count("*").alias("repeats"))
    places = finding_locations(findings)
    few = places.withColumnRenamed("seq", "_n") if most is None else first_rows(places, KEY, ["seq", "location"], most, "_n")
    few = few.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "location"))), lambda s: s["location"]).alias("locations"))
    named = few.select(*(F.col(k).alias(f"_{k}") for k in KEY), "locations")
    both = out.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    return both.select(*KEY, "seq", "f.*", "locations", "repeats")


def with_ids(collapsed: DataFrame) -> DataFrame:
    """Ids per category in the order of first appearance: INC-001, ING-001, DEV-001; numbered by ranges."""
    prefix = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    ranked = numbered(collapsed, ["case_id", "category"], ["seq", "key"], "_number")
    return ranked.withColumn("finding_id", F.format_string("%s-%03d", F.element_at(prefix, F.col("category")), "_number")).drop("_number")


def severity_summary(collapsed: DataFrame) -> DataFrame:
    """(case_id, category, n, alta, media, baja), with a total row a case (category null); missing severity is baja."""
    level = F.coalesce("severity", F.lit("baja"))
    counts = [F.count_if(level == s).alias(s) for s in fixed.SEVERITIES]
    out = collapsed.rollup("case_id", "category").agg(F.count("*").alias("n"), *counts)
    return out.filter("case_id is not null")


def files_touched(findings: DataFrame) -> DataFrame:
    return findings.groupBy("case_id").agg(F.count_distinct("location.file").alias("n_files"))


def top_people(findings: DataFrame, traces: DataFrame, valid: DataFrame, *, keep: int = 10) -> DataFrame:
    """(case_id, name, n, rank): valid names by their appearances in findings and traces."""
    seen = findings.select("case_id", F.explode("people").alias("name")).unionByName(traces.select("case_id", F.col("alias").alias("name")))
    n = seen.groupBy("case_id", "name").agg(F.count("*").alias("n")).join(valid.select("case_id", "name").distinct(), ["case_id", "name"], "left_semi")
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "name"))).filter(F.col("rank") <= keep)


def top_vehicles(findings: DataFrame, traces: DataFrame, aliases: DataFrame, *, keep: int = 5) -> DataFrame:
    """(case_id, name, n, rank): valid vehicles by appearances in findings (vehicles array) and the number of chunks of
    their own traces (alias, n_locations); aliases are resolved, ties go by name."""
    seen = findings.select("case_id", F.explode("vehicles").alias("alias"), F.lit(1).alias("n"))
    traced = traces.filter(F.startswith("alias", F.lit("VEHICULO_"))).select("case_id", "alias", F.col("n_locations").alias("n"))
    names = aliases.select("case_id", "alias", "real_name")
    each = seen.unionByName(traced).join(names, ["case_id", "alias"], "left").withColumn("name", F.coalesce("real_name", "alias"))
    n = each.groupBy("case_id", "name").agg(F.sum("n").alias("n")).filter(vehicle_validity(F.col("name"))["valid"])
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n"), "name"))).filter(F.col("rank") <= keep)


def listed(numbered: DataFrame, *, others_as_low: bool = False, most: int = 10) -> DataFrame:
    """Findings alta, media, baja (others left out, or last as baja): up to `most` of their locations and how many more."""
    level = F.array_position(F.array(*map(F.lit, fixed.SEVERITIES)), F.coalesce("severity", F.lit("")))
    kept = numbered if others_as_low else numbered.filter(F.col("severity").isin(*fixed.SEVERITIES))
    rank = F.when(level == 0, 3).otherwise(level).cast("int")
    return kept.select("case_id", "category", "finding_id", "severity", rank.alias("severity_rank"), "description", F.slice("locations", 1, most).alias("shown"), F.greatest(F.col("repeats") - F.size(F.slice("locations", 1, most)), F.lit(0)).cast("int").alias("more"))


def traces_by_role(traces: DataFrame, valid: DataFrame) -> DataFrame:
    kept = traces.join(valid.select("case_id", F.col("name").alias("alias")).distinct(), ["case_id", "alias"], "left_semi")
    return kept.select("case_id", F.coalesce("role", F.lit("desconocido")).alias("role"), "alias", F.array_join(F.slice("actions", 1, 5), "; ").alias("actions"), F.array_join(F.slice("people", 1, 10), ", ").alias("people"), F.array_join(F.slice("vehicles", 1, 5), ", ").alias("vehicles"))


def alias_appendix(aliases: DataFrame) -> DataFrame:
    return aliases.orderBy("case_id", "alias")


def graph_findings(findings: DataFrame, *, keep: int = 25, below: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first `keep` findings of a case that the loose rule lets pass, distinct by key across categories.

    The smallest seq of each of some hundred parts of a case gives a bound below which there are at least 4 `keep` of its
    findings, and not many more. Only those are read and compared by key; cases with fewer than `keep` keys there take
    all their findings. below: makes the findings up to bounds (case_id, _end; all of a case where _end is null), where
    that is cheaper than to make all and choose.
    """
    parts = findings.groupBy("case_id", F.pmod(F.xxhash64("seq"), F.lit(16 * keep)).alias("_part")).agg(F.min("seq").alias("_least"), F.count_if(F.col("seq").isNull()).alias("_none"))
    ends = parts.groupBy("case_id").agg(F.sort_array(F.collect_list("_least")).alias("_s"), F.sum("_none").alias("_none"))
    # No bound where a case has few parts, or findings without a seq.
    ends = stage_table(ends.select("case_id", F.when(F.col("_none") == 0, F.try_element_at("_s", F.lit(4 * keep))).alias("_end")), "ends")
    near = below(ends) if below else joined_by(findings, F.broadcast(ends), ["case_id"]).filter("_end is null or seq <= _end").drop("_end")
    key = F.substring(F.lower("description"), 1, 80)
    some = stage_table(drop_weak(near, loose=True), "first")
    full = some.groupBy("case_id").agg(F.count_distinct(key).alias("_k")).filter(F.col("_k") >= keep)
    short = joined_by(ends.filter("_end is not null"), full, ["case_id"], "left_anti").select("case_id")
    if not short.isEmpty():
        some = joined_by(some, short, ["case_id"], "left_anti").unionByName(joined_by(drop_weak(findings, loose=True), short, ["case_id"], "left_semi"))
    first = some.withColumn("key", key).groupBy("case_id", "key").agg(F.min_by(F.struct("category", "type", "severity", "description", "people", "location"), "seq").alias("f"), F.min("seq").alias("seq"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))
    return first.withColumn("n", n).filter(F.col("n") <= keep).select("case_id", F.format_string("HALLAZGO_%03d", F.col("n")).alias("finding_id"), "seq", "f.*")
