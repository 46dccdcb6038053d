"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import embedding_dedup, hard_negatives, hnsw, language_id, licenses, line_dedup, packing, pii, piece_bpe, simhash, toxicity, vector_codes, warc
from casewright.llm.shared import crc_bucket

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> bytes:
    """A vocabulary file of the installed public tokenizers; executors get its bytes, not its path."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    pieces = packing.pack_documents(docs, tokenizer_file(TOKENIZER), end=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "license", "digest")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hnsw.nearest(table, table.filter(F.col("vec_id") % 50 == 0), k=5)


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file(PIECES)
    coded = piece_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), model).drop("text")
    back = piece_bpe.decode(coded, model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), n_lines="n_lines", n_removed="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(crc_bucket(F.col("doc_id"), 5) != 0)
    lexicon = toxicity.learn(toxicity.labelled_sample(docs, labels))
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    rated = toxicity.rate(docs, lexicon)
    return rated.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.learn(docs.filter(crc_bucket(F.col("doc_id"), 4) != 2))
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return language_id.identify(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table.withColumn("label", label), F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, low=50, high=95)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=1024, parts=4, entries=256, rounds=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_license_scan, op3_simhash, op4_hnsw, op5_piece_bpe, op6_line_dedup, op7_pii, op8_embedding_dedup, op9_toxicity, op10_language_id, op11_warc, op12_hard_negatives, op13_vector_codes]
    return {f.__name__: f for f in found}


def _license_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"lower(regexp_replace(text, {q(licenses.COPYRIGHT_LINE)}, ' ', 'g'))"
    flat = f"'  ' || replace(trim(regexp_replace({low}, {q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' ', 'g')), ' ', '  ') || '  '"
    for shown, same in licenses.SPELLINGS:
        flat = f"replace({flat}, {q(' ' + shown.replace(' ', '  ') + ' ')}, {q(' ' + same.replace(' ', '  ') + ' ')})"
    digest = f"sha256(replace(trim({flat}), '  ', ' '))"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in licenses.variants(licenses.KNOWN))
    full = ", ".join(f"({q(d)}, {q(k)})" for k, d in licenses.FULL_DIGESTS.items())
    return f"""
WITH known(license, text) AS (VALUES {known}), whole(digest, license) AS (VALUES {full}),
k AS (SELECT digest, min(license) AS license FROM (SELECT {digest} AS digest, license FROM known UNION ALL SELECT * FROM whole) GROUP BY 1),
d AS (SELECT doc_id, {digest} AS digest FROM documents)
SELECT d.doc_id, k.license, d.digest FROM d LEFT JOIN k ON d.digest = k.digest"""


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, line_no, line, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(line), '[\t\x0b\f\r]', ' ', 'g'), ' '), lambda w: w <> ''))) AS words FROM lines),
classes AS (SELECT row_number() OVER (ORDER BY min((doc_id, line_no))) AS c, words, len(words) AS n, min((doc_id, line_no)) AS first FROM sets WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT c, n, unnest(words) AS w FROM classes),
shared AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS o FROM tokens a JOIN tokens b ON a.w = b.w AND a.c < b.c AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 GROUP BY ALL),
beaten AS (SELECT DISTINCT b FROM shared WHERE o * 5 >= (na + nb - o) * 4),
kept AS (SELECT first FROM classes WHERE c NOT IN (SELECT b FROM beaten)),
marked AS (SELECT s.*, len(words) = 0 OR (s.doc_id, s.line_no) IN (SELECT first FROM kept) AS keep FROM sets s)
SELECT doc_id, count(*)::INTEGER AS n_lines, (count(*) - count_if(keep))::INTEGER AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (keep), '')) AS text_sha256
FROM marked GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _license_sql(), "op6_line_dedup": LINE_SQL}
