"""Scans, sources and sinks of case files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import fixed


def scan_corpus(spark: SparkSession, path: str, *, glob: str = "*.[tT][xX][tT]") -> DataFrame:
    """(file, text) of the files in one folder, bad UTF-8 replaced. The name filter prunes files before they are read."""
    found = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return found.select(F.col("_metadata.file_name").alias("file"), F.expr("make_valid_utf8(value)").alias("text"))


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^.]+)$", 1))


def supported(files: DataFrame, *, file: str = "file", size: str | None = None, most_mb: int = 50) -> DataFrame:
    """Files with a supported extension (and size), with file_type."""
    kinds = F.create_map(*(F.lit(x) for kv in fixed.EXTENSIONS.items() for x in kv))
    out = files.withColumn("file_type", F.try_element_at(kinds, extension(F.col(file)))).filter(F.col("file_type").isNotNull())
    return out.filter(F.col(size) <= most_mb * 1024 * 1024) if size else out


def drop_blank(docs: DataFrame, *, text: str = "text") -> DataFrame:
    return docs.filter(F.col(text).rlike(r"(?U)\S"))


def assemble_pages(pages: DataFrame, *, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(doc, text): non-blank pages in order, each under its page mark, joined by a blank line."""
    mark = F.concat(F.lit("--- Página "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(text))
    kept = pages.filter(F.col(text).rlike(r"(?U)\S")).select(doc, F.struct(F.col(page).alias("p"), mark.alias("t")).alias("s"))
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias(text))


def needs_ocr(pages: DataFrame, *, text: str = "text", least: int = 30) -> DataFrame:
    return pages.withColumn("needs_ocr", F.length(F.trim(text)) < least)


def explode_pages(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The pages of assembled documents: the inverse of assemble_pages()."""
    parts = F.explode(F.split(F.col(text), r"(?:^|\n\n)(?=--- Página \d+ ---\n)")).alias("_part")
    page = F.regexp_extract("_part", r"^--- Página (\d+) ---\n", 1)
    body = F.regexp_replace("_part", r"^--- Página \d+ ---\n", "")
    return docs.select(doc, parts).filter("_part <> ''").select(doc, page.try_cast("int").alias("page_no"), body.alias(text))


def filter_volumes(docs: DataFrame, tokens: list[str], *, file: str = "file") -> DataFrame:
    """Documents whose file name has any of the tokens; no token keeps all."""
    if not tokens:
        return docs
    return docs.filter(F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.col(file), t)))


def corpus_stats(docs: DataFrame, *, text: str = "text") -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))


def read_or_build(spark: SparkSession, path: str, schema: str, build) -> DataFrame:
    """The JSON table at a path; where there is none yet, build() is written there first (alias tables, profiles)."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        build().write.json(path)
        return spark.read.schema(schema).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Chunk results: one JSON object a line or an array, with the free part as VARIANT."""
    return spark.read.schema("chunk struct<archivo string, chunk int, inicio int, fin int>, resultado variant, duracion_s double, error string").json(path, multiLine=True)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.regexp_replace(F.col(c).cast("string"), "\n", " ").alias(c) for c, t in df.dtypes))


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON and as quoted CSV (quotes doubled, blanks at the edges kept) with nested values as JSON text."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/json/{name}")
        _flat(df).write.mode("overwrite").options(quoteAll=True, escape='"', header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/csv/{name}")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows): one aggregate a table, joined by union."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in sorted(tables.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def composite(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row): all rows of all tables as JSON in one document stream."""
    rows = [df.select(F.lit(n).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("row")) for n, df in sorted(tables.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def backup(tables: dict[str, DataFrame], path: str, snapshot: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/snapshot_ts={snapshot}")


def restore(spark: SparkSession, path: str, name: str, snapshot: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").filter(F.col("snapshot_ts") == snapshot).drop("snapshot_ts")


def write_report(findings: DataFrame, lines: DataFrame, path: str) -> None:
    """Findings as JSON, and the report's lines (section, seq, line) sorted over all partitions."""
    findings.write.mode("overwrite").json(f"{path}/findings")
    lines.orderBy("section", "seq").select("line").write.mode("overwrite").text(f"{path}/report")


def write_graph(nodes: DataFrame, edges: DataFrame, stats: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("stats", stats)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def parse_json_like(df: DataFrame, column: str, out: str) -> DataFrame:
    """Strings that look like a JSON array or object as VARIANT, null for any other."""
    looks = F.trim(column).rlike(r"^[\[{]")
    return df.withColumn(out, F.when(looks, F.try_parse_json(column)))
