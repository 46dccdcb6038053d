"""Chunking, sampling, requests to a model and its responses."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.operators.ranks import numbered

CHUNK = T.StructType([T.StructField("chunk_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("size", T.IntegerType())])


def chunk_bounds(text: str, size: int, overlap: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each chunk; a cut moves back to just after the last blank line of its final `window` characters."""
    n, start = len(text), 0
    while start < n:
        end = min(start + size, n)
        if end < n:
            at = text.rfind("\n\n", max(start, end - window), end)
            if at >= 0:
                end = at + 2
        yield start, end
        if end >= n:
            return
        start = max(end - overlap, start + 1)


def chunk_text(docs: DataFrame, *, size: int = 100_000, overlap: int = 5_000, window: int = 5_000, text: str = "text") -> DataFrame:
    """docs, one row a chunk with a `chunk` struct: sequential inside a text, parallel over texts."""
    if size <= overlap + window:
        raise ValueError("size must be larger than overlap + window")
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            bounds = [list(chunk_bounds(t, size, overlap, window)) for t in texts]
            owner = [i for i, cut in enumerate(bounds) for _ in cut]
            start, end = (pa.array([x[k] for cut in bounds for x in cut], pa.int32()) for k in (0, 1))
            chunk = [
                pa.array([i for cut in bounds for i in range(len(cut))], pa.int32()), start, end,
                pa.array([t[a:b] for t, cut in zip(texts, bounds) for a, b in cut], pa.string()), pc.subtract(end, start),
            ]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(at) for f in kept), *chunk], names=[*(f.name for f in kept), *CHUNK.names])

    return docs.mapInArrow(run, T.StructType([*kept, *CHUNK.fields]))


def chunk_fixed(docs: DataFrame, *, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Chunks without boundary snapping, in closed form: start = i * (size - overlap)."""
    n, step = F.length(text), size - overlap
    count = F.greatest(F.ceil((n - overlap) / F.lit(step)), F.lit(1)).cast("int")
    each = docs.filter(n > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("chunk_no") * step
    out = each.withColumn("start", start).withColumn("end", F.least(start + size, n))
    return out.withColumn("size", F.col("end") - F.col("start")).withColumn("chunk_text", F.substring(F.col(text), F.col("start") + 1, F.col("size"))).drop(text)


def chunk_sections(docs: DataFrame, *, most: int = 100_000, text: str = "text") -> DataFrame:
    """Sections between blank lines packed greedily: a chunk is flushed when the next section would not fit."""
    sections = F.split(F.col(text), r"\n\s*\n")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def add(acc, s):
        full = (F.length(acc["buf"]) + F.length(s) > most) & (acc["buf"] != "")
        done = F.when(full, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
        buf = F.when(full | (acc["buf"] == ""), s).otherwise(F.concat(acc["buf"], F.lit("\n\n"), s))
        return F.struct(done.alias("done"), buf.alias("buf"))

    last = lambda acc: F.when(acc["buf"] != "", F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
    packed = docs.withColumn("_packed", F.aggregate(sections, empty, add, last))
    out = packed.select(*(c for c in docs.columns if c != text), F.posexplode("_packed").alias("chunk_no", "_raw"))
    return out.withColumn("chunk_text", F.trim("_raw")).withColumn("size", F.length("_raw")).drop("_raw")


def chunk_list(chunks: DataFrame, *, file: str = "file") -> DataFrame:
    """Chunks of all documents with their place as one struct, numbered over the case in (file, document, chunk) order.

    Documents are counted first, and only (document, number of chunks) rows are summed up, by ranges, never the texts.
    """
    doc = ["case_id", file, "doc_id"]
    n = chunks.groupBy(*doc).agg(F.count("*").alias("_n"))
    first = numbered(n, ["case_id"], [file, "doc_id"], "_before", weight="_n").select(*(F.col(c).alias(f"_{c}") for c in doc), "_before")
    same = [chunks[c].eqNullSafe(first[f"_{c}"]) for c in doc]
    placed = chunks.join(first, same).withColumn("seq", (F.col("_before") + F.col("chunk_no") + 1).cast("int"))
    return placed.withColumn("chunk", F.struct(file, "chunk_no", "start", "end")).drop("_before", *(f"_{c}" for c in doc))


def sample_corpus(docs: DataFrame, *, budget: int = 30_000, head: int = 5_000, middle: int = 3_000, text: str = "text", file: str = "file") -> DataFrame:
    """(case_id, sample): up to two documents give prefixes within the budget; more give their head and, if longer, a
    part from their middle, until the budget is used, each part under its file's name. Documents without text add nothing.

    Lengths alone are summed up in (file, document) order, by ranges; texts are then joined for the documents chosen, of
    which a case has no more than the budget has characters.
    """
    key = ["case_id", file, "doc_id"]
    sizes = docs.select(*key, F.length(text).alias("_size")).filter("_size > 0")
    counts = sizes.groupBy("case_id").agg(F.count("*").alias("_n")).withColumnRenamed("case_id", "_case")
    counted = sizes.join(counts, F.col("case_id").eqNullSafe(F.col("_case"))).drop("_case")
    rest = F.col("_size") - (F.col("_size") / 2).cast("int")
    shown = F.when((F.col("_n") > 2) & (F.col("_size") > head), head + 5 + F.least(rest, F.lit(middle))).when(F.col("_n") > 2, F.col("_size")).otherwise(F.least("_size", F.lit(budget)))
    chosen = numbered(counted.withColumn("_shown", shown), ["case_id"], [file, "doc_id"], "_used", weight="_shown").filter(F.col("_used") < budget)
    chosen = chosen.select(*(F.col(c).alias(f"_{c}") for c in key), "_n", "_used")
    used = docs.join(chosen, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    whole = F.col(text)
    cut = F.concat(F.substring(whole, 1, head), F.lit("\n...\n"), F.substring(whole, (F.length(text) / 2).cast("int") + 1, F.lit(middle)))
    part = F.when((F.col("_n") > 2) & (F.length(text) > head), cut).otherwise(whole)
    part = F.substring(part, F.lit(1), (budget - F.col("_used")).cast("int"))
    line = F.struct(F.col(file).alias("f"), F.col("doc_id").alias("d"), F.concat(F.lit("=== "), F.col(file), F.lit(" ===\n"), part).alias("t"))
    return used.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["t"]), "\n\n").alias("sample"))


def profile_blocklist(profiles: DataFrame) -> DataFrame:
    """(case_id, word): places of three letters or more and their capitalised words; of institutions and legal terms the words."""
    words = lambda c: F.filter(F.flatten(F.transform(c, lambda x: F.split(x, r"\s+"))), lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{Lu}"))
    places = F.filter("lugares_mencionados", lambda x: F.length(x) >= 3)
    every = F.concat(places, words(F.col("lugares_mencionados")), words(F.col("instituciones_mencionadas")), words(F.col("terminos_legales_relevantes")))
    return profiles.select("case_id", F.explode(F.array_distinct(every)).alias("word"))


PROFILE_LISTS = ("lugares_mencionados", "instituciones_mencionadas", "terminos_legales_relevantes", "tipos_entidad_adicionales", "roles_juridicos", "temas_recurrentes", "alertas_calibracion")
PROFILE_TEXTS = {"jurisdiccion": "desconocida", "tipo_caso": "general", "subtipo_caso": "", "sistema_legal": "desconocido", "idioma_principal": "es"}


def with_profile(cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every case with its profile, or the default one."""
    joined = cases.join(profiles, "case_id", "left")
    for c in PROFILE_LISTS:
        joined = joined.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    for c, default in PROFILE_TEXTS.items():
        joined = joined.withColumn(c, F.coalesce(c, F.lit(default)))
    return joined


#: What each aspect asks for, and the profile's lists that it shows.
ASPECTS = {
    "inconsistencias": ("contradictions between statements of the chunk", ("terms", "alerts")),
    "incongruencias": ("facts that do not fit each other or the dates", ("terms", "topics")),
    "trazabilidad": ("what each person did, with whom and with which vehicles", ("roles", "entities")),
    "declaracion_vs_evidencia": ("statements that the evidence contradicts", ("terms", "alerts", "roles")),
}
DEFAULT_ROLES = ("victima", "imputado", "testigo", "autoridad", "perito")


def build_requests(chunks: DataFrame, profiles: DataFrame, *, aspect: str = "all") -> DataFrame:
    """(…, instruction, request): the instruction from the case's profile, and the chunk under its place.

    `all` asks for every aspect and shows all of the profile's lists; one of ASPECTS asks for that one alone with the
    lists it needs. Ten terms, five alerts and five topics are shown; without roles the usual ones; entity kinds as tags.
    """
    if aspect != "all" and aspect not in ASPECTS:
        raise ValueError(f"no aspect {aspect}")
    shown = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    tags = F.array_join(F.transform("tipos_entidad_adicionales", lambda x: F.regexp_replace(F.upper(x), r"\s+", "_")), ", ")
    roles = F.array_join(F.when(F.size("roles_juridicos") > 0, F.col("roles_juridicos")).otherwise(F.array(*map(F.lit, DEFAULT_ROLES))), ", ")
    lists = {"terms": ("Terms", shown("terminos_legales_relevantes", 10)), "alerts": ("Alerts", shown("alertas_calibracion", 5)), "topics": ("Topics", shown("temas_recurrentes", 5)), "roles": ("Roles", roles), "entities": ("Entities", tags)}
    asked = list(ASPECTS) if aspect == "all" else [aspect]
    needed = list(lists) if aspect == "all" else ASPECTS[aspect][1]
    head = F.format_string("Case: %s (%s, %s)", "tipo_caso", "jurisdiccion", "sistema_legal")
    instruction = F.concat_ws("\n", head, *(F.lit(f"Find {a}: {ASPECTS[a][0]}") for a in asked), *(F.concat(F.lit(f"{lists[k][0]}: "), lists[k][1]) for k in needed), F.concat(F.lit("Answer in "), F.col("idioma_principal")))
    request = F.format_string("[%s chunk %d, %d-%d]\n%s", "file", "chunk_no", "start", "end", "chunk_text")
    joined = chunks.join(with_profile(chunks.select("case_id").distinct(), profiles), "case_id")
    return joined.select(*chunks.columns, instruction.alias("instruction"), request.alias("request"))


def enrich(chunks: DataFrame, call: Callable[[str], str], *, partitions: int | None = None, request: str = "request") -> DataFrame:
    """chunks with (result, duration, error) of a user function; a failing chunk has its error and never fails the job.

    partitions bounds how many calls run at once.
    """
    fields = [*chunks.schema.fields, T.StructField("result", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("error", T.StringType())]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame[request]:
                began = time.monotonic()
                try:
                    out.append((call(r), time.monotonic() - began, None))
                except Exception as e:
                    out.append((None, time.monotonic() - began, f"{type(e).__name__}: {e}"))
            yield frame.assign(result=[o[0] for o in out], duration=[o[1] for o in out], error=[o[2] for o in out])

    source = chunks.repartition(partitions) if partitions else chunks
    return source.mapInPandas(run, T.StructType(fields))


def _repair(text: str | None) -> str | None:
    """Close an odd quote and open brackets; else the first balanced object; else none."""
    import json

    if text is None or "{" not in text:
        return None
    body = text[text.index("{") :]
    stack, quoted, skip, closed = [], False, False, None
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif c == "\\":
            skip = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]" and stack:
            stack.pop()
            if not stack:
                closed = body[: i + 1]
                break
    tries = [closed] if closed else [body + '"' * quoted + "".join(reversed(stack)), body.rstrip().rstrip(",") + '"' * quoted + "".join(reversed(stack))]
    for t in tries:
        try:
            json.loads(t)
            return t
        except ValueError:
            continue
    return None


def parse_responses(responses: DataFrame, *, text: str = "response") -> DataFrame:
    """responses with `parsed` (VARIANT): fences stripped and parsed natively; only what fails goes through the repair."""

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(_repair)

    bare = F.trim(F.regexp_replace(F.col(text), r"(?m)^\s*```\w*\s*$", ""))
    first = responses.withColumn("_cw_bare", bare).withColumn("_cw_first", F.try_parse_json("_cw_bare"))
    mended = repair(F.when(F.col("_cw_first").isNull(), F.col("_cw_bare")))  # null where the text is fine as it is
    return first.withColumn("parsed", F.coalesce("_cw_first", F.try_parse_json(mended))).drop("_cw_bare", "_cw_first")


def parse_quality(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(F.col("parsed").isNotNull()).alias("n_valid"), F.count("*").alias("n_total"))


def case_context(summaries: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, context): the summary without tags (2,000 characters) and the first five findings (200 each)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("summary", "<[^>]+>", " "), r"\s+", " "))
    first = findings.withColumn("_n", F.row_number().over(Window.partitionBy("case_id").orderBy("seq"))).filter("_n <= 5")
    listed = first.groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.substring("description", 1, 200).alias("d")))), lambda s: s["d"]), "\n").alias("_f"))
    return summaries.join(listed, "case_id", "left").select("case_id", F.concat_ws("\n", F.substring(plain, 1, 2000), "_f").alias("context"))
