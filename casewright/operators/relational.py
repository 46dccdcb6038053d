"""The graph as twelve relational tables, their checks, and browsing of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.names import slug
from casewright.operators.ranks import numbered

# Columns of the twelve tables.
TABLES = {
    "persona": "persona_id string, nombre_canonico string, menciones_total bigint, tipo_rol string, fuentes array<string>, aliases_origen array<string>, cargos array<string>, archivos array<string>, chunks array<string>",
    "vehiculo": "vehiculo_id string, placa string, tipo string, marca string, modelo string, color string, menciones_total bigint, expedientes array<string>, chunks array<string>",
    "lugar": "lugar_id string, nombre string, direccion string, menciones_total bigint, expedientes array<string>, chunks array<string>",
    "hallazgo": "hallazgo_id string, tipo string, descripcion string, severidad string, archivo string, chunk string",
    "hecho": "hecho_id string, archivo string, chunk string, descripcion_implicita string",
    "expediente": "expediente_id string, nombre_archivo string, anio string, tipo_caso string, delito string",
    "rel_juridica": "id bigint, persona_id string, persona_rel_id string, cargo string, archivo string, chunk string",
    "rel_victima": "id bigint, persona_id string, hecho_id string, tipo_relacion string, archivo string, chunk string",
    "rel_coocurrencia": "id bigint, persona1_id string, persona2_id string, count bigint",
    "rel_involucrado": "id bigint, persona_id string, hallazgo_id string",
    "rel_presente_lugar": "id bigint, persona_id string, lugar_id string, count bigint",
    "rel_menciona_vehiculo": "id bigint, persona_id string, vehiculo_id string, count bigint",
}
# Foreign keys (table, column, target table, target column).
FOREIGN_KEYS = [
    ("rel_juridica", "persona_id", "persona", "persona_id"), ("rel_juridica", "persona_rel_id", "persona", "persona_id"),
    ("rel_victima", "persona_id", "persona", "persona_id"), ("rel_victima", "hecho_id", "hecho", "hecho_id"),
    ("rel_coocurrencia", "persona1_id", "persona", "persona_id"), ("rel_coocurrencia", "persona2_id", "persona", "persona_id"),
    ("rel_involucrado", "persona_id", "persona", "persona_id"), ("rel_involucrado", "hallazgo_id", "hallazgo", "hallazgo_id"),
    ("rel_presente_lugar", "persona_id", "persona", "persona_id"), ("rel_presente_lugar", "lugar_id", "lugar", "lugar_id"),
    ("rel_menciona_vehiculo", "persona_id", "persona", "persona_id"), ("rel_menciona_vehiculo", "vehiculo_id", "vehiculo", "vehiculo_id"),
]
ROUTES = {"coocurrencia": ("rel_coocurrencia", "persona", "persona"), "juridica": ("rel_juridica", "persona", "persona"), "lugar": ("rel_presente_lugar", "persona", "lugar"), "lugar_debil": ("rel_presente_lugar", "persona", "lugar"), "vehiculo": ("rel_menciona_vehiculo", "persona", "vehiculo"), "vehiculo_debil": ("rel_menciona_vehiculo", "persona", "vehiculo"), "involucrado": ("rel_involucrado", "persona", "hallazgo"), "victima": ("rel_victima", "persona", "hecho")}
SOURCES = ("victima", "testigo", "perito", "declarante", "parte", "participante", "trazabilidad")


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def key(kind: str, name: Column) -> Column:
    """The one key of an entity, used by its table and by every relation."""
    return F.concat_ws("_", F.lit(kind), slug(name))


def infer_role(roles: Column, relations: Column, sources: Column) -> Column:
    """First role, else victim relation, else the first source in order of weight, else desconocido."""
    by_source = [F.when(F.array_contains(sources, s), s) for s in SOURCES]
    return F.coalesce(F.try_element_at(roles, F.lit(1)), F.when(F.size(relations) > 0, F.lit("victima")), *by_source, F.lit("desconocido"))


def entity_table(entities: DataFrame, kind: str, id_column: str) -> DataFrame:
    """(id, name, mentions, files) of the entities of a kind: the first row of each key by mentions, then name."""
    rows = entities.filter(F.col("kind") == kind).withColumn(id_column, key(kind, F.col("name")))
    w = Window.partitionBy("case_id", id_column).orderBy(F.desc("mentions"), "name")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def dossiers(*with_files: DataFrame) -> DataFrame:
    """(case_id, expediente_id, nombre_archivo, anio, tipo_caso) of the distinct files of nodes and findings, which have
    a list of `files` or one `file` a row."""
    out = None
    for df in with_files:
        each = df.select("case_id", (F.explode("files") if "files" in df.columns else F.col("file")).alias("nombre_archivo"))
        out = each if out is None else out.union(each)
    low = F.lower("nombre_archivo")
    kind = F.when(F.contains(low, F.lit("amparo")), "amparo").when(F.contains(low, F.lit("apela")), "apelacion").otherwise("causa")
    return out.distinct().select("case_id", key("EXP", F.col("nombre_archivo")).alias("expediente_id"), "nombre_archivo", F.nullif(F.regexp_extract("nombre_archivo", r"((?:19|20)\d{2})", 1), F.lit("")).alias("anio"), kind.alias("tipo_caso"))


def route(edges: DataFrame, node_kinds: DataFrame) -> DataFrame:
    """(case_id, table_name, from_id, to_id, label, n): each edge to its relation table by the kinds of its ends
    (case_id, id, kind); finding-to-person edges are turned round."""
    a = node_kinds.select("case_id", F.col("id").alias("src"), F.col("kind").alias("ka"))
    b = node_kinds.select("case_id", F.col("id").alias("dst"), F.col("kind").alias("kb"))
    j = edges.join(a, ["case_id", "src"]).join(b, ["case_id", "dst"])
    pair = lambda x, y: ((F.col("ka") == x) & (F.col("kb") == y)) | ((F.col("ka") == y) & (F.col("kb") == x))
    table = None
    for kind, (name, x, y) in ROUTES.items():
        rule = (F.col("kind") == kind) & pair(x, y)
        table = F.when(rule, name) if table is None else table.when(rule, name)
    turned = (F.col("kb") == "persona") & (F.col("ka") != "persona")
    return j.select("case_id", table.alias("table_name"), F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("from_id"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("to_id"), "n", *(["label"] if "label" in edges.columns else [])).filter("table_name is not null")


def surrogate_keys(relations: DataFrame) -> DataFrame:
    """relations with id: 1, 2, … in each relation table of a case, in the order of both ends; numbered by ranges."""
    return numbered(relations, ["case_id", "table_name"], ["from_id", "to_id", "n"], "id")


#: The two keys of each relation table, and the kind whose key the second is (none: an id as it stands).
ENDS = {
    "rel_juridica": ("persona_id", "persona_rel_id", "PERSONA"), "rel_victima": ("persona_id", "hecho_id", None), "rel_coocurrencia": ("persona1_id", "persona2_id", "PERSONA"),
    "rel_involucrado": ("persona_id", "hallazgo_id", None), "rel_presente_lugar": ("persona_id", "lugar_id", "LUGAR"), "rel_menciona_vehiculo": ("persona_id", "vehiculo_id", "VEHICULO"),
}


def _filled(table: str, rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(case_id, the table's columns): those not given are null."""
    return rows.select("case_id", *(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))


def entity_tables(entities: DataFrame) -> dict[str, DataFrame]:
    """persona, vehiculo and lugar of top entities (case_id, kind, name, mentions, sources, roles,
    relations, files, chunks)."""
    c = F.col
    shared = {"menciones_total": c("mentions"), "expedientes": c("files"), "archivos": c("files"), "chunks": c("chunks")}
    person = shared | {"persona_id": c("id"), "nombre_canonico": c("name"), "tipo_rol": infer_role(c("roles"), c("relations"), c("sources")), "fuentes": c("sources"), "aliases_origen": F.array("name"), "cargos": c("roles")}
    of = lambda kind: entity_table(entities, kind, "id")
    return {
        "persona": _filled("persona", of("PERSONA"), person),
        "vehiculo": _filled("vehiculo", of("VEHICULO"), shared | {"vehiculo_id": c("id"), "placa": c("name")}),
        "lugar": _filled("lugar", of("LUGAR"), shared | {"lugar_id": c("id"), "nombre": c("name")}),
    }


def finding_table(findings: DataFrame, *, most: int = 500) -> DataFrame:
    """hallazgo of findings (case_id, finding_id, type, severity, description, location): descriptions of `most` characters."""
    place = F.col("location")
    return _filled("hallazgo", findings, {"hallazgo_id": F.col("finding_id"), "tipo": F.col("type"), "descripcion": F.substring("description", 1, most), "severidad": F.col("severity"), "archivo": place["file"], "chunk": place["chunk"]})


def fact_table(facts: DataFrame) -> DataFrame:
    """hecho of facts (case_id, file, chunk), each chunk once: the first file by name."""
    one = facts.groupBy("case_id", "chunk").agg(F.min("file").alias("file"))
    return _filled("hecho", one, {"hecho_id": F.concat(F.lit("HECHO_"), F.col("chunk").cast("string")), "archivo": F.col("file"), "chunk": F.col("chunk")})


def relation_table(routed: DataFrame, table: str) -> DataFrame:
    """One relation table of surrogate_keys(route()): its ids, the keys of both ends, and the count or the label of the edge."""
    a, b, kind = ENDS[table]
    rows = routed.filter(F.col("table_name") == table)
    return _filled(table, rows, {"id": F.col("id"), a: key("PERSONA", F.col("from_id")), b: key(kind, F.col("to_id")) if kind else F.col("to_id"), "count": F.col("n"), "cargo": F.col("label"), "tipo_relacion": F.col("label")})


def model(entities: DataFrame, findings: DataFrame, facts: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The twelve tables of a graph: its top entities (with chunks), numbered findings, facts and edges (src, dst, kind, n, label)."""
    out = entity_tables(entities) | {"hallazgo": finding_table(findings), "hecho": fact_table(facts)}
    files = dossiers(entities, findings.select("case_id", F.array("location.file").alias("files")))
    out["expediente"] = _filled("expediente", files, {c: F.col(c) for c in ("expediente_id", "nombre_archivo", "anio", "tipo_caso")})
    fact_ids = facts.select("case_id", F.concat(F.lit("HECHO_"), F.col("chunk").cast("string")).alias("id")).distinct()
    kinds = entities.select("case_id", F.col("name").alias("id"), F.lower("kind").alias("kind")).unionByName(findings.select("case_id", F.col("finding_id").alias("id"), F.lit("hallazgo").alias("kind"))).unionByName(fact_ids.withColumn("kind", F.lit("hecho")))
    routed = surrogate_keys(route(edges, kinds))
    return out | {t: relation_table(routed, t) for t in ENDS}


def tolerate_duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key, (n_skipped) of the others)."""
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("_r = 1").drop("_r"), numbered.agg(F.count_if(F.col("_r") > 1).alias("n_skipped"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(n_orphans): child rows whose key has no parent row; null keys are none."""
    ids = parent.select(F.col(parent_key).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(ids, column, "left_anti").agg(F.count("*").alias("n_orphans"))


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, target, n_orphans) of every foreign key whose tables are given."""
    out = None
    for t, c, target, k in FOREIGN_KEYS:
        if t in tables and target in tables:
            row = orphans(tables[t], c, tables[target], k).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.lit(target).alias("target"), "n_orphans")
            out = row if out is None else out.unionByName(row)
    return out


def display_names(rows: DataFrame, column: str, target: DataFrame, key_column: str, name: str, out: str) -> DataFrame:
    """rows with the readable name of a key; `(sin nombre)` if missing."""
    names = target.select(F.col(key_column).alias(column), F.col(name).alias(out))
    return rows.join(names, column, "left").withColumn(out, F.coalesce(out, F.lit("(sin nombre)")))


def domain_violations(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.agg(F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).alias("n_violations"))


def search_any(rows: DataFrame, query: str) -> DataFrame:
    """Rows with the text in any column, whatever its case."""
    every = F.lower(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)))
    return rows.filter(F.contains(every, F.lit(query.lower())))


def page(rows: DataFrame, order: list[str], number: int, *, size: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, *, size: int = 50) -> DataFrame:
    return rows.agg(F.ceil(F.count("*") / size).cast("long").alias("n_pages"))


def project(rows: DataFrame, *, show: list[str] | None = None, hide: list[str] | None = None) -> DataFrame:
    return rows.select(*(c for c in (show or rows.columns) if c not in (hide or ())))


def link_files(names: DataFrame, links: DataFrame) -> DataFrame:
    """names (name, …) with link: of the first of links (path, link, place) that the name equals, or whose path without
    `.pdf` the name ends in; null if none.

    A name meets paths by its endings, so the test runs on an equi join: a name has as many as it has characters.
    """
    ends = names.select("name").distinct().select("name", F.explode(F.sequence(F.lit(0), F.length("name"))).alias("_n"))
    ends = ends.select("name", F.col("_n"), F.expr("right(name, _n)").alias("_end"))
    bare = F.expr("overlay(path placing '' from locate('.pdf', path) for 4)")
    keys = F.array(F.struct(F.lit(True).alias("whole"), F.col("path").alias("k")), F.struct(F.lit(False).alias("whole"), F.when(F.contains("path", F.lit(".pdf")), bare).otherwise(F.col("path")).alias("k")))
    table = links.select("link", "place", F.explode(keys).alias("x")).select("link", "place", "x.whole", F.col("x.k").alias("_end"))
    hit = ends.join(table, "_end").filter(~F.col("whole") | (F.col("_n") == F.length("name")))
    first = hit.groupBy("name").agg(F.min_by("link", "place").alias("link"))
    return names.join(first, "name", "left")


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A value of any nesting as text: lists by comma (lists inside by ` - `), objects as `k: v · …`, null as nothing."""
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: F.replace(_as_text(x, kind.elementType), F.lit(", "), F.lit(" - ")) if isinstance(kind.elementType, T.ArrayType) else _as_text(x, kind.elementType))
        return F.coalesce(F.array_join(inner, ", "), F.lit(""))
    if isinstance(kind, T.StructType):
        return F.coalesce(F.concat_ws(" · ", *(F.concat(F.lit(f"{f.name}: "), _as_text(c[f.name], f.dataType)) for f in kind.fields)), F.lit(""))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), _as_text(e["value"], kind.valueType))), " · "), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def flatten_text(rows: DataFrame, c: str, *, places: bool = False, most: int = 100) -> Column:
    """A nested column of rows as text, cut with three dots after `most` characters.

    places: an array of file names or of structs (file, chunk), shown as `file` or `file - chunk` without `.txt`.
    """
    kind = rows.schema[c].dataType
    if not places:
        text = _as_text(F.col(c), kind)
    else:
        bare = lambda x: F.regexp_replace(x, r"(?i)[.]txt$", "")
        pair = isinstance(kind.elementType, T.StructType)
        one = lambda x: F.concat_ws(" - ", bare(x[kind.elementType.names[0]]), x[kind.elementType.names[1]].cast("string")) if pair else bare(x)
        text = F.coalesce(F.array_join(F.transform(c, one), ", "), F.lit(""))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def catalogue(spark) -> DataFrame:
    """(table_name, column_name, type, is_pk, is_fk) of the twelve tables."""
    foreign = {(t, c) for t, c, _, _ in FOREIGN_KEYS}
    rows = [(t, f.name, f.dataType.simpleString(), i == 0, (t, f.name) in foreign) for t in TABLES for i, f in enumerate(schema(t).fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, is_pk boolean, is_fk boolean")
