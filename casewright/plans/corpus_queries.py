"""Queries over sources, text and extraction, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import fixed
from casewright.operators import extract, text
from casewright.operators.components import checkpoint_dir
from casewright.plans import views
from casewright.sources import corpus
from casewright.streaming import operators as streams

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DOC = "WITH " + views.DOCUMENTS


@query(DOC + " SELECT doc_id, file || '.' || ext AS file, file_type FROM (SELECT doc_id, file, ['pdf', 'TXT', 'md', 'docx', 'JPG'][(doc_id % 5 + 1)::INTEGER] AS ext, ['pdf', 'txt', NULL, 'docx', 'img'][(doc_id % 5 + 1)::INTEGER] AS file_type FROM v_documents) WHERE file_type IS NOT NULL")
def s2_supported(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "TXT", "md", "docx", "JPG"))), (F.col("doc_id") % 5 + 1).cast("int"))
    d = views.documents(spark, sf).select("doc_id", F.concat_ws(".", "file", ext).alias("file"))
    return corpus.supported(d)


@query(r"SELECT doc_id, turn, text FROM (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 3 = 0 THEN chr(10) || ' ' ELSE text END AS text FROM conversations) WHERE regexp_matches(text, '\S')")
def s3_drop_blank(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("turn") % 3 == 0, "\n ").otherwise(F.col("text")).alias("text"))
    return corpus.drop_blank(c)


@query(r"SELECT conv_id AS doc_id, string_agg('--- Página ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE regexp_matches(text, '\S') GROUP BY 1")
def s4_assemble_pages(spark, sf):
    p = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return corpus.assemble_pages(p)


@query("SELECT conv_id AS doc_id, turn, length(trim(text)) < 30 AS needs_ocr FROM conversations")
def s5_needs_ocr(spark, sf):
    return corpus.needs_ocr(views.table(spark, sf, "conversations")).select(F.col("conv_id").alias("doc_id"), "turn", "needs_ocr")


@query(r"SELECT conv_id AS doc_id, turn::INTEGER AS page_no, text FROM conversations WHERE regexp_matches(text, '\S')")
def s6_explode_pages(spark, sf):
    return corpus.explode_pages(s4_assemble_pages(spark, sf))


@query(DOC + " SELECT doc_id, file FROM v_documents WHERE contains(file, 'src1') OR contains(file, '7')")
def s7_filter_volumes(spark, sf):
    return corpus.filter_volumes(views.documents(spark, sf), ["src1", "7"]).select("doc_id", "file")


@query("SELECT count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents")
def s8_corpus_stats(spark, sf):
    return corpus.corpus_stats(views.documents(spark, sf))


@query("SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def s13_manifest(spark, sf):
    return corpus.manifest({n: views.table(spark, sf, n) for n in ("customer", "orders", "lineitem", "events")})


@query("""SELECT 'customer' AS table_name, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS row FROM customer UNION ALL SELECT 'orders', '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' FROM orders""")
def s14_composite(spark, sf):
    t = lambda n, *c: views.table(spark, sf, n).select(*c)
    return corpus.composite({"customer": t("customer", "c_custkey", "c_mktsegment"), "orders": t("orders", "o_orderkey", "o_orderstatus")})


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, for a query that writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents")
def s1_scan_corpus(spark, sf):
    """Documents as lines of text files of a thousand, scanned whole."""
    path = _folder(spark, "corpus")
    lines = F.concat_ws("\t", F.col("doc_id").cast("string"), F.replace("text", F.lit("\n"), F.lit(" ")))
    views.documents(spark, sf).select(lines.alias("value")).write.option("maxRecordsPerFile", 1000).text(path)
    line = F.explode(F.split("text", "\n")).alias("line")
    got = corpus.scan_corpus(spark, path).select(line).filter("line <> ''")
    return got.select(F.substring_index("line", "\t", 1).cast("bigint").alias("doc_id"), F.expr("substring(line, position('\t', line) + 1)").alias("text"))


@query("SELECT c_custkey, 'PERSONA_' || CASE WHEN c_custkey < 1000 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS alias, c_name AS real_name FROM customer")
def s9_alias_table(spark, sf):
    path = _folder(spark, "aliases")
    build = lambda: views.table(spark, sf, "customer").select("c_custkey", F.format_string("PERSONA_%03d", "c_custkey").alias("alias"), F.col("c_name").alias("real_name"))
    kinds = "c_custkey bigint, alias string, real_name string"
    corpus.read_or_build(spark, path, kinds, build)
    return corpus.read_or_build(spark, path, kinds, lambda: build().limit(0))


@query("SELECT c_custkey::VARCHAR AS case_id, 'general' AS tipo_caso, upper(n_name[1]) || lower(n_name[2:]) AS lugar FROM customer JOIN nation ON c_nationkey = n_nationkey")
def s10_profiles(spark, sf):
    got = corpus.read_or_build(spark, _folder(spark, "profiles"), _profiles(spark, sf).schema.simpleString()[7:-1].replace(":", " "), lambda: _profiles(spark, sf).withColumn("tipo_caso", F.lit("general")))
    return got.select("case_id", "tipo_caso", F.element_at("lugares_mencionados", 1).alias("lugar"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN length(text)::BIGINT END AS n, CASE WHEN doc_id % 10 = 0 THEN 'no' END AS error FROM documents")
def s11_read_results(spark, sf):
    """Results as files of one JSON array of up to five hundred each."""
    path = _folder(spark, "results")
    fine = F.col("doc_id") % 10 != 0
    row = F.to_json(F.struct(F.struct(F.col("file").alias("archivo"), F.col("doc_id").cast("int").alias("chunk")).alias("chunk"), F.when(fine, F.struct(F.length("text").alias("n"), "text")).alias("resultado"), F.when(~fine, "no").alias("error")))
    rows = views.documents(spark, sf).select(F.floor(F.col("doc_id") / 500).alias("g"), row.alias("r"))
    rows.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return corpus.read_results(spark, path).select(F.col("chunk.chunk").cast("bigint").alias("doc_id"), F.try_variant_get("resultado", "$.n", "bigint").alias("n"), "error")


@query("""SELECT conv_id, turn, replace(t, chr(10), ' ') AS text, '["' || role || '","x"]' AS tags FROM (SELECT *, text || '"a\\b' || chr(10) || 'c ' AS t FROM conversations WHERE text IS NOT NULL)""")
def s12_export_tables(spark, sf):
    """Texts with quotes, backslashes, line breaks and blanks at their end, out as CSV and JSON and back."""
    path = _folder(spark, "export")
    hard = F.concat("text", F.lit('"a\\b\nc '))
    c = views.table(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", hard.alias("text"), F.array("role", F.lit("x")).alias("tags"))
    corpus.export_tables({"conversations": c}, path)
    back = spark.read.option("header", True).option("escape", '"').schema("conv_id bigint, turn bigint, text string, tags string").csv(f"{path}/csv/conversations")
    json = spark.read.schema("conv_id bigint, turn bigint, text string").json(f"{path}/json/conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return json.join(back, ["conv_id", "turn", "text"])


@query("SELECT event_id, event_type, value FROM events")
def s15_backup_restore(spark, sf):
    path = _folder(spark, "backup")
    e = views.table(spark, sf, "events").select("event_id", "event_type", "value")
    corpus.backup({"events": e}, path, "20240101")
    corpus.backup({"events": e.limit(0)}, path, "20240102")
    return corpus.restore(spark, path, "events", "20240101")


@query("SELECT lpad(doc_id::VARCHAR, 9, '0') || ' ' || source AS line FROM documents")
def s16_write_report(spark, sf):
    path = _folder(spark, "report")
    f = views.findings(spark, sf)
    corpus.write_report(f, f.select(F.col("category").alias("section"), "seq", F.concat_ws(" ", F.lpad(F.col("seq").cast("string"), 9, "0"), "location.file").alias("line")), path)
    return spark.read.text(f"{path}/report").select(F.col("value").alias("line"))


@query("SELECT o_custkey::VARCHAR AS src, o_orderkey::VARCHAR AS dst FROM orders")
def s17_write_graph(spark, sf):
    path = _folder(spark, "graph")
    text_of = lambda c, n: F.col(c).cast("string").alias(n)
    o, c = views.table(spark, sf, "orders"), views.table(spark, sf, "customer")
    corpus.write_graph(c.select(text_of("c_custkey", "id")), o.select(text_of("o_custkey", "src"), text_of("o_orderkey", "dst")), o.agg(F.count("*").alias("n_edges")), path)
    return spark.read.parquet(f"{path}/edges")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def s18_parse_json_like(spark, sf):
    e = corpus.parse_json_like(views.table(spark, sf, "events"), "props", "v")
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


DOUBLED = "d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t, length(replace(text, chr(10), chr(10) || chr(10))) AS n FROM documents WHERE text IS NOT NULL)"


@query("WITH RECURSIVE " + DOUBLED + """, c AS (
SELECT doc_id, n, 0 AS chunk_no, 0 AS start, (SELECT e FROM snap) AS "end" FROM (SELECT doc_id, n, 0 AS start, t FROM d WHERE n > 0), LATERAL (SELECT least(2000, n) AS e0), LATERAL (SELECT substr(t, greatest(0, e0 - 300) + 1, e0 - greatest(0, e0 - 300)) AS seg), LATERAL (SELECT CASE WHEN e0 < n AND contains(seg, chr(10) || chr(10)) THEN e0 - strpos(reverse(seg), chr(10) || chr(10)) + 1 ELSE e0 END AS e) AS snap
UNION ALL
SELECT doc_id, n, chunk_no + 1, s, e FROM (SELECT c.doc_id, c.n, c.chunk_no, greatest(c."end" - 200, c.start + 1) AS s, t FROM c JOIN d ON c.doc_id = d.doc_id WHERE c."end" < c.n), LATERAL (SELECT least(s + 2000, n) AS e0), LATERAL (SELECT substr(t, greatest(s, e0 - 300) + 1, e0 - greatest(s, e0 - 300)) AS seg), LATERAL (SELECT CASE WHEN e0 < n AND contains(seg, chr(10) || chr(10)) THEN e0 - strpos(reverse(seg), chr(10) || chr(10)) + 1 ELSE e0 END AS e))
SELECT doc_id, chunk_no::INTEGER AS chunk_no, start::INTEGER AS start, "end"::INTEGER AS "end", ("end" - start)::INTEGER AS size FROM c""".replace('(SELECT e FROM snap) AS "end"', 'snap.e AS "end"'))
def t1_chunk_text(spark, sf):
    d = views.documents(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return text.chunk_text(d, size=2000, overlap=200, window=300).select("doc_id", "chunk_no", "start", "end", "size")


@query(DOC + """ SELECT doc_id, i::INTEGER AS chunk_no, (i * 900)::INTEGER AS start, least(i * 900 + 1000, n)::INTEGER AS "end", (least(i * 900 + 1000, n) - i * 900)::INTEGER AS size, substr(text, (i * 900 + 1)::INTEGER, 1000) AS chunk_text
FROM (SELECT doc_id, text, length(text) AS n, unnest(range(greatest(ceil((length(text) - 100) / 900.0), 1)::BIGINT)) AS i FROM v_documents WHERE length(text) > 0)""")
def t1b_chunk_fixed(spark, sf):
    return text.chunk_fixed(views.documents(spark, sf).drop("case_id", "file"), size=1000, overlap=100)


@query("WITH RECURSIVE " + DOUBLED + r""", s AS (SELECT doc_id, regexp_split_to_array(t, '\n\s*\n') AS parts FROM d),
f AS (SELECT doc_id, 0 AS i, 0 AS chunk_no, '' AS buf, NULL::VARCHAR AS flushed FROM s
UNION ALL
SELECT f.doc_id, i + 1, CASE WHEN out THEN chunk_no + 1 ELSE chunk_no END, CASE WHEN out OR buf = '' THEN p ELSE buf || chr(10) || chr(10) || p END, CASE WHEN out THEN buf END
FROM f JOIN s ON f.doc_id = s.doc_id, LATERAL (SELECT CASE WHEN i < len(parts) THEN parts[i + 1] END AS p), LATERAL (SELECT coalesce(length(buf) + length(p) > 1000, TRUE) AND buf <> '' AS out) WHERE i <= len(parts) AND (i < len(parts) OR buf <> ''))
SELECT doc_id, (chunk_no - 1)::INTEGER AS chunk_no, trim(flushed) AS chunk_text, length(flushed)::INTEGER AS size FROM f WHERE flushed IS NOT NULL""")
def t2_chunk_sections(spark, sf):
    d = views.documents(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return text.chunk_sections(d, most=1000).select("doc_id", "chunk_no", "chunk_text", "size")


@query(DOC + """, c AS (SELECT case_id, file, doc_id, unnest(range(greatest(ceil((length(text) - 200) / 1800.0), 1)::BIGINT))::INTEGER AS chunk_no FROM v_documents WHERE length(text) > 0)
SELECT case_id, doc_id, chunk_no, row_number() OVER (PARTITION BY case_id ORDER BY file, doc_id, chunk_no)::INTEGER AS seq FROM c""")
def t3_chunk_list(spark, sf):
    c = text.chunk_fixed(views.documents(spark, sf), size=2000, overlap=200)
    return text.chunk_list(c).select("case_id", "doc_id", "chunk_no", "seq")


@query(DOC + r""", p AS (SELECT case_id, file, doc_id, count(*) OVER (PARTITION BY case_id) AS n, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || chr(10) || '...' || chr(10) || substr(text, floor(length(text) / 2)::INTEGER + 1, 3000) ELSE text END AS part FROM v_documents WHERE length(text) > 0),
u AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY case_id ORDER BY file, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM p)
SELECT case_id, string_agg('=== ' || file || ' ===' || chr(10) || substr(part, 1, (30000 - used)::INTEGER), chr(10) || chr(10) ORDER BY file, doc_id) AS sample FROM u WHERE used < 30000 GROUP BY case_id""")
def t4_sample_corpus(spark, sf):
    return text.sample_corpus(views.documents(spark, sf))


def _profiles(spark, sf):
    """A profile for each customer: the nation is its place, its court an institution."""
    n = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    p = views.table(spark, sf, "customer").join(n, "c_nationkey")
    lists = {"lugares_mencionados": F.array(F.initcap("n_name")), "instituciones_mencionadas": F.array(F.initcap(F.concat(F.lit("court of "), F.col("n_name")))), "terminos_legales_relevantes": F.array(F.lit("Recurso de Amparo"), F.lit("auto"))}
    other = F.array(F.lit("fuga rapida"), F.lit("otro"))
    return p.select(F.col("c_custkey").cast("string").alias("case_id"), *(lists.get(c, other).alias(c) for c in text.PROFILE_LISTS), *(F.lit("x").alias(c) for c in text.PROFILE_TEXTS))


@query(r"""WITH n AS (SELECT c_custkey::VARCHAR AS case_id, upper(n_name[1]) || lower(n_name[2:]) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT case_id, place AS word FROM n WHERE length(place) >= 3 AND place NOT LIKE '% %' UNION SELECT case_id, array_to_string(list_transform(string_split(lower(place), ' '), lambda x: upper(x[1]) || x[2:]), ' ') FROM n
UNION SELECT case_id, unnest(list_transform(string_split(lower(place), ' '), lambda x: upper(x[1]) || x[2:])) FROM n UNION SELECT case_id, unnest(['Court', 'Recurso', 'Amparo']) FROM n)
SELECT DISTINCT case_id, word FROM w WHERE length(word) >= 3 AND word <> 'Of'""")
def t5_profile_blocklist(spark, sf):
    return text.profile_blocklist(_profiles(spark, sf))


@query("SELECT c_custkey::VARCHAR AS case_id, 'x' AS tipo_caso, 2 AS n_alerts FROM customer UNION ALL SELECT 'order ' || o_orderkey, 'general', 0 FROM orders")
def t6_with_profile(spark, sf):
    orders = views.table(spark, sf, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("case_id"))
    cases = _profiles(spark, sf).select("case_id").union(orders)
    return text.with_profile(cases, _profiles(spark, sf)).select("case_id", "tipo_caso", F.size("alertas_calibracion").alias("n_alerts"))


@query(DOC + r""" SELECT doc_id, i::INTEGER AS chunk_no, '[' || file || ' chunk ' || i || ', ' || i * 1800 || '-' || least(i * 1800 + 2000, n) || ']' || chr(10) || substr(text, (i * 1800 + 1)::INTEGER, 2000) AS request
FROM (SELECT doc_id, file, text, length(text) AS n, unnest(range(greatest(ceil((length(text) - 200) / 1800.0), 1)::BIGINT)) AS i FROM v_documents WHERE length(text) > 0)""")
def t7_build_requests(spark, sf):
    c = text.chunk_fixed(views.documents(spark, sf), size=2000, overlap=200)
    return text.build_requests(c, _profiles(spark, sf)).select("doc_id", "chunk_no", "request")


def _aspects_sql() -> str:
    """Each aspect's instruction for each language, with the lists that it shows."""
    lists = {
        "terms": "'Terms: ley ' || case_id || ', pena'", "alerts": "'Alerts: ojo'", "topics": "'Topics: fuga'",
        "roles": "'Roles: ' || CASE WHEN case_id = 'en' THEN 'victima, imputado, testigo, autoridad, perito' ELSE 'rol ' || case_id END",
        "entities": "'Entities: CASA_' || upper(case_id) || ', ARMA'",
    }
    one = lambda a: " || chr(10) || ".join(["'Case: causa ' || case_id || ' (x, x)'", f"'Find {a}: {text.ASPECTS[a][0]}'", *(lists[k] for k in text.ASPECTS[a][1]), "'Answer in ' || case_id"])
    return DOC + " " + " UNION ".join(f"SELECT DISTINCT case_id, '{a}' AS aspect, {one(a)} AS instruction FROM v_documents WHERE length(text) > 0" for a in text.ASPECTS)


@query(_aspects_sql())
def t7_single_aspect(spark, sf):
    """The instruction of each of the four aspects for each language, from profiles with all lists."""
    d = views.documents(spark, sf)
    none = F.array().cast("array<string>")
    lists = {"tipos_entidad_adicionales": F.array(F.concat(F.lit("casa "), F.col("case_id")), F.lit("arma")), "roles_juridicos": F.when(F.col("case_id") != "en", F.array(F.concat(F.lit("rol "), F.col("case_id")))).otherwise(none)}
    lists |= {"terminos_legales_relevantes": F.array(F.concat(F.lit("ley "), F.col("case_id")), F.lit("pena")), "alertas_calibracion": F.array(F.lit("ojo")), "temas_recurrentes": F.array(F.lit("fuga"))}
    texts = {"tipo_caso": F.concat(F.lit("causa "), F.col("case_id")), "idioma_principal": F.col("case_id")}
    profiles = d.select("case_id").distinct().select("case_id", *(lists.get(c, none).alias(c) for c in text.PROFILE_LISTS), *(texts.get(c, F.lit("x")).alias(c) for c in text.PROFILE_TEXTS))
    chunks = text.chunk_fixed(d, size=2000, overlap=200)
    each = [text.build_requests(chunks, profiles, aspect=a).select("case_id", F.lit(a).alias("aspect"), "instruction").distinct() for a in text.ASPECTS]
    return each[0].union(each[1]).union(each[2]).union(each[3])


@query(DOC + " SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN length(text)::VARCHAR END AS result, CASE WHEN doc_id % 10 = 0 THEN 'ValueError: no' END AS error FROM v_documents")
def t8_enrich(spark, sf):
    def call(r: str) -> str:
        if int(r.split("|", 1)[0]) % 10 == 0:
            raise ValueError("no")
        return str(len(r.split("|", 1)[1]))

    d = views.documents(spark, sf).select("doc_id", F.concat_ws("|", "doc_id", "text").alias("request"))
    return text.enrich(d, call, partitions=4).select("doc_id", "result", "error")


def _responses(spark, sf):
    full = F.to_json(F.struct(F.col("doc_id").alias("id"), F.array(F.struct(F.col("text").alias("d"))).alias("items")))
    broken = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Result: "), full, F.lit(" done"))).when(F.col("doc_id") % 4 == 3, F.substring(full, F.lit(1), F.length(full) - 4)).otherwise(full)
    return views.documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 50 == 9, "none").otherwise(broken).alias("response"))


@query("SELECT doc_id, CASE WHEN doc_id % 50 <> 9 THEN doc_id END AS id FROM documents")
def t9_parse_responses(spark, sf):
    return text.parse_responses(_responses(spark, sf)).select("doc_id", F.try_variant_get("parsed", "$.id", "bigint").alias("id"))


@query("SELECT count_if(doc_id % 50 <> 9)::BIGINT AS n_valid, count(*) AS n_total FROM documents")
def t10_parse_quality(spark, sf):
    return text.parse_quality(text.parse_responses(_responses(spark, sf)))


@query("WITH " + views.FINDINGS + r""", f AS (SELECT case_id, description, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n FROM v_findings)
SELECT case_id, substr('summary of ' || case_id, 1, 2000) || chr(10) || string_agg(substr(description, 1, 200), chr(10) ORDER BY n) AS context FROM f WHERE n <= 5 GROUP BY case_id""")
def t11_case_context(spark, sf):
    f = views.findings(spark, sf)
    s = f.select("case_id").distinct().withColumn("summary", F.concat(F.lit("<p>summary of "), F.col("case_id"), F.lit("</p>")))
    return text.case_context(s, f)


MENTION_SQL = DOC + r""", hits AS (SELECT case_id, file, doc_id, 'EMAIL' AS kind, unnest(regexp_extract_all(text, '[a-z]+\.[0-9]+@[a-z0-9.]+[a-z]')) AS name FROM v_documents
UNION ALL SELECT case_id, file, doc_id, 'PAIR', unnest(regexp_extract_all(text, '[A-Z][a-z]{2,15}[.] [A-Z][a-z]{2,15}')) FROM v_documents),
freq AS (SELECT case_id, file, doc_id, kind, name, count(*) AS freq FROM hits GROUP BY ALL),
names AS (SELECT case_id, kind, name, sum(freq)::BIGINT AS mentions, list_sort(list(DISTINCT file)) AS files FROM freq GROUP BY ALL)"""


def _kinds() -> dict:
    return {"EMAIL": F.regexp_extract_all("text", F.lit(r"[a-z]+\.[0-9]+@[a-z0-9.]+[a-z]"), F.lit(0)), "PAIR": F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,15}[.] [A-Z][a-z]{2,15}"), F.lit(0))}


def found(spark, sf):
    return extract.mentions(views.documents(spark, sf), kinds=_kinds())


def names(spark, sf):
    return extract.global_frequency(extract.document_frequency(found(spark, sf)))


# non-word characters are followed by a mark, which stands for the look around a name that this dialect lacks
MARKED = r"regexp_replace(text, '([^\p{L}\p{N}_])', '\1' || chr(1), 'g')"
_SQL_WORD = r"(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,15}|[A-ZÁÉÍÓÚÑ]{3,15})"
_GAP = "(?:\\s\x01)+"
_END = r"(?:[^\p{L}\p{N}_]|$)"


def _titles() -> str:
    return fixed.TITLES.replace(r"\.", "\\.\x01")


@query(DOC + rf""", m AS (SELECT doc_id, regexp_extract_all('El' || ' ' || chr(1) || 'Cabo' || ' ' || chr(1) || 'Juan' || ' ' || chr(1) || 'Pérez' || ' ' || chr(1) || 'y' || ' ' || chr(1) || 'la' || ' ' || chr(1) || 'Agente' || ' ' || chr(1) || 'María' || ' ' || chr(1) || 'López' || ' ' || chr(1) || {MARKED}, '(?:^|\x01){_titles()}{_GAP}((?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+{_GAP}){{1,4}}[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){_END}', 1) AS hits FROM v_documents)
SELECT doc_id, replace(unnest(hits), chr(1), '') AS name FROM m""")
def e1_titled_names(spark, sf):
    d = views.documents(spark, sf).withColumn("text", F.concat(F.lit("El Cabo Juan Pérez y la Agente María López "), F.col("text")))
    return d.select("doc_id", F.explode(extract.titled_names(F.col("text"))).alias("name"))


def _capitalised_sql(connected: str) -> str:
    """Names of the capitalised pattern; the marks turn the look around a name into plain characters."""
    block = ", ".join(f"'{w}'" for w in fixed.BLOCKLIST)
    return DOC + rf""", m AS (SELECT doc_id, replace(unnest(regexp_extract_all({MARKED}, '(?:^|\x01)({_SQL_WORD}{connected}){_END}', 1)), chr(1), '') AS name FROM v_documents),
w AS (SELECT doc_id, name, regexp_split_to_array(name, '\s+') AS words FROM m)
SELECT doc_id, name FROM w WHERE len(words) BETWEEN 2 AND 5 AND len(list_filter(words, lambda x: length(x) < 3 AND x NOT IN ('de', 'del', 'la', 'los', 'las', 'y'))) = 0 AND NOT list_has_any(words, [{block}])"""


@query(_capitalised_sql(rf"(?:{_GAP}(?:(?:de{_GAP}la|de{_GAP}los|de|del|y|la|las){_GAP})?{_SQL_WORD}){{1,4}}"))
def e2_capitalised_names(spark, sf):
    return views.documents(spark, sf).select("doc_id", F.explode(extract.capitalised_names(F.col("text"), corrected=True)).alias("name"))


@query(_capitalised_sql(rf"(?:{_GAP}(?:de|del|de{_GAP}la|de{_GAP}los|y|la|las){_GAP})?(?:{_GAP}{_SQL_WORD}){{1,4}}"))
def e2_capitalised_names_plain(spark, sf):
    return views.documents(spark, sf).select("doc_id", F.explode(extract.capitalised_names(F.col("text"))).alias("name"))


@query(MENTION_SQL + " SELECT case_id, kind, name, count(*) AS n FROM hits WHERE NOT regexp_matches(name, '^The[.]|[ ]The$|^Und[.]|[ ]Und$') GROUP BY ALL")
def e3_without_blocked(spark, sf):
    block = views.documents(spark, sf).select("case_id", F.explode(F.array(*map(F.lit, ("The", "The.", "Und", "Und.")))).alias("word")).distinct()
    return extract.without_blocked(found(spark, sf), block).groupBy("case_id", "kind", "name").agg(F.count("*").alias("n"))


PLATED = "concat_ws('', 'vehículo marca Fordex azul. con placas ABC-' || (1000 + doc_id % 9000) || '. ', text)"


@query(rf"""WITH t AS (SELECT doc_id, {PLATED} AS text FROM documents),
h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:veh[íi]culo|autom[óo]vil|camioneta|motocicleta|cami[óo]n)\s+(?:marca|tipo|modelo|color)\s+(\p{{L}}[\p{{L}}0-9\-\s]{{2,40}})', 1)) AS name FROM t
UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{{3}}-?[0-9]{{3,4}})\b', 1)) FROM t UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)placas?\s+([A-Z]{{3}}-?[0-9]{{3,4}})', 1)) FROM t)
SELECT doc_id, trim(name) AS name, count(*)::INTEGER AS n FROM h WHERE length(trim(name)) >= 3 GROUP BY ALL""")
def e4_vehicle_mentions(spark, sf):
    plate = F.concat(F.lit("vehículo marca Fordex azul. con placas ABC-"), (1000 + F.col("doc_id") % 9000).cast("string"), F.lit(". "))
    d = views.documents(spark, sf).select("doc_id", F.concat_ws("", plate, "text").alias("text"))
    return d.select("doc_id", F.explode(extract.vehicle_mentions(F.col("text"))).alias("name")).groupBy("doc_id", "name").agg(F.count("*").cast("int").alias("n"))


@query(MENTION_SQL + " SELECT * FROM freq")
def e5_document_frequency(spark, sf):
    return extract.document_frequency(found(spark, sf))


@query(MENTION_SQL + " SELECT case_id, kind, name, mentions, array_to_string(files, ',') AS files FROM names WHERE mentions >= 2")
def e6_global_frequency(spark, sf):
    n = extract.global_frequency(extract.document_frequency(found(spark, sf)), least=2)
    return n.withColumn("files", F.array_join("files", ","))


PARTS = "WITH p AS (SELECT 'c' AS case_id, 'PERSONA' AS kind, p_name AS name, count(*) AS mentions FROM part GROUP BY p_name UNION ALL SELECT 'c', 'PERSONA', string_split(p_name, ' ')[1], count(*) FROM part GROUP BY string_split(p_name, ' ')[1])"


def _part_names(spark, sf):
    p = views.table(spark, sf, "part")
    whole = p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("mentions"))
    first = p.groupBy(F.split("p_name", " ")[0].alias("name")).agg(F.count("*").alias("mentions"))
    return whole.union(first).select(F.lit("c").alias("case_id"), F.lit("PERSONA").alias("kind"), "name", "mentions")


@query(PARTS + " SELECT case_id, kind, name, mentions FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.name <> a.name AND contains(' ' || b.name || ' ', ' ' || a.name || ' ') AND b.mentions >= a.mentions)")
def e7_drop_subsumed(spark, sf):
    return extract.drop_subsumed(_part_names(spark, sf))


@query(PARTS + " SELECT case_id, kind, name, mentions FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.name <> a.name AND contains(b.name, a.name) AND b.mentions >= a.mentions)")
def e7_drop_subsumed_anywhere(spark, sf):
    return extract.drop_subsumed_anywhere(_part_names(spark, sf))


@query(MENTION_SQL + " SELECT case_id, kind, kind || '_' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END AS alias, name AS real_name, mentions, array_to_string(files, ',') AS files FROM (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY mentions DESC, name) AS r FROM names)")
def e8_alias_assignment(spark, sf):
    per_doc = extract.document_frequency(found(spark, sf))
    aliases = extract.assign_aliases(extract.global_counts(per_doc)).withColumnRenamed("real_name", "name")
    return extract.with_files(aliases, extract.name_files(per_doc)).select("case_id", "kind", "alias", F.col("name").alias("real_name"), "mentions", F.array_join("files", ",").alias("files"))


@query(MENTION_SQL + " SELECT case_id, kind, name, mentions, len(files) AS n_files FROM names")
def x3_ingest(spark, sf):
    """The documents as files that a stream takes in, two a micro-batch, with a snapshot at each third."""
    path = _folder(spark, "ingest")
    d = views.documents(spark, sf)
    d.repartition(8).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    streams.ingest(stream, f"{path}/out", f"{path}/checkpoint", kinds=_kinds(), size=2000, overlap=200, window=300, every=3).awaitTermination()
    return streams.merged_counts(spark, f"{path}/out")


@query(MENTION_SQL + " SELECT case_id, count_if(kind = 'PAIR')::BIGINT AS n_people, 0::BIGINT AS n_vehicles, (SELECT count(DISTINCT file) FROM freq f WHERE f.case_id = n.case_id) AS n_files FROM names n GROUP BY case_id")
def e9_alias_stats(spark, sf):
    per_doc = extract.document_frequency(found(spark, sf)).withColumn("kind", F.when(F.col("kind") == "PAIR", "PERSONA").otherwise("OTRO"))
    return extract.alias_stats(extract.assign_aliases(extract.global_counts(per_doc)), extract.name_files(per_doc))


def _aliases(spark, sf):
    n = views.table(spark, sf, "nation").select(F.col("n_name").alias("real_name"), F.format_string("PERSONA_%03d", F.col("n_nationkey") + 1).alias("alias"))
    langs = views.documents(spark, sf).select("case_id").distinct()
    return langs.crossJoin(n).select("case_id", F.lit("PERSONA").alias("kind"), "alias", "real_name")  # languages by nations: two small tables


#: A nation's name in lower and upper case, before a text: after every sign that may stand before a name, and inside words.
PLANTED = ("sobre {l},{u};nombre:{l}/{u}-99 '{l}'.{u}\n({l})¿{u}? {l}n ñ{u} _{l} {u}_ [{u}x] ")
FOUND = "sobre {a},{a};nombre:{a}/{a}-99 '{a}'.{a}\n({a})¿{a}? {l}n ñ{u} _{l} {u}_ [{u}x] "


def _nations(spark, sf):
    n = views.table(spark, sf, "nation")
    d = views.documents(spark, sf).join(n.select(F.col("n_nationkey").alias("k"), "n_name"), F.col("doc_id") % 25 == F.col("k"))
    planted = F.replace(F.replace(F.lit(PLANTED), F.lit("{l}"), F.lower("n_name")), F.lit("{u}"), F.upper("n_name"))
    return d.select("case_id", "file", "doc_id", F.concat(planted, F.col("text")).alias("text"))


def _planted_sql(shown: str, name: str) -> str:
    text = "'" + shown.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"SELECT doc_id, replace(replace(replace({text}, '{{l}}', lower(n_name)), '{{u}}', upper(n_name)), '{{a}}', {name}) || text AS text FROM documents JOIN nation ON doc_id % 25 = n_nationkey"


@query(_planted_sql(FOUND, "'PERSONA_' || lpad((doc_id % 25 + 1)::VARCHAR, 3, '0')"))
def e10_pseudonymize(spark, sf):
    return extract.pseudonymize(_nations(spark, sf), _aliases(spark, sf)).select("doc_id", "text")


@query(_planted_sql(FOUND, "n_name"))
def e11_restore(spark, sf):
    hidden = extract.pseudonymize(_nations(spark, sf), _aliases(spark, sf))
    return extract.restore(hidden, _aliases(spark, sf)).select("doc_id", "text")


@query("SELECT doc_id, coalesce(n_name, 'PERSONA_' || CASE WHEN doc_id % 40 + 1 < 1000 THEN lpad((doc_id % 40 + 1)::VARCHAR, 3, '0') END) AS who FROM documents LEFT JOIN nation ON doc_id % 40 = n_nationkey")
def e12_resolve_column(spark, sf):
    d = views.documents(spark, sf).select("case_id", "doc_id", F.format_string("PERSONA_%03d", (F.col("doc_id") % 40 + 1).cast("int")).alias("who"))
    return extract.resolve_column(d, _aliases(spark, sf), "who").select("doc_id", "who")


@query("SELECT doc_id, [CASE WHEN doc_id % 40 < 25 THEN n_name ELSE 'PERSONA_' || lpad((doc_id % 40 + 1)::VARCHAR, 3, '0') END, 'nadie', (SELECT n_name FROM nation WHERE n_nationkey = 0)] AS who FROM documents LEFT JOIN nation ON doc_id % 40 = n_nationkey")
def e12_resolve_array(spark, sf):
    who = F.array(F.format_string("PERSONA_%03d", (F.col("doc_id") % 40 + 1).cast("int")), F.lit("nadie"), F.lit("PERSONA_001"))
    return extract.resolve_array(views.documents(spark, sf).select("case_id", "doc_id", who.alias("who")), _aliases(spark, sf), "who", "doc_id").select("doc_id", "who")


@query("SELECT doc_id, 'agencia del ' || n_name || ': ' || text AS name FROM documents JOIN nation ON doc_id % 25 = n_nationkey")
def e13_embedded_alias(spark, sf):
    name = F.concat(F.format_string("agencia del PERSONA_%03d: ", (F.col("doc_id") % 25 + 1).cast("int")), F.col("text"))
    return extract.restore(views.documents(spark, sf).select("case_id", "doc_id", name.alias("name")), _aliases(spark, sf), text="name").select("doc_id", "name")


# Letters and figures beyond ASCII become `a`, which this dialect's \\b knows as a part of a word
_ASCII_WORDS = r"regexp_replace(regexp_replace({}, '[^\x00-\x7F\P{{L}}]', 'a', 'g'), '[^\x00-\x7F\P{{N}}]', 'a', 'g')"
SIGNED = "J.P.P. firmó. A.B. Casa É.J.P.ñ A.B.C "


@query(rf"SELECT doc_id, unnest(regexp_extract_all({_ASCII_WORDS.format(f"'{SIGNED}' || text")}, '\b([A-Z]\.\s*[A-Z]\.?\s*[A-Z]?\.?)\b', 1)) AS name FROM documents")
def e14_initials(spark, sf):
    d = views.documents(spark, sf).withColumn("text", F.concat(F.lit(SIGNED), F.col("text")))
    return extract.initials_mentions(d).select("doc_id", "name")
