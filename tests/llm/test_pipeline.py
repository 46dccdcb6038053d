"""The pipeline's stages on a small fixture, and against their rules in plain Python."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_duplicates import brute_lines, closure
from test_models import reference
from tokenizers import Tokenizer

from casewright.llm import pii

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, "write to zoe@mail.example.com about the thing and the other thing", "en", "s", 60)], docs.schema)
    docs = docs.unionByName(extra).withColumn("component", F.lit("clash"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert 0 < kept.count() <= docs.count()
    ids = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 9001 not in ids and 9002 not in ids and "<email>" in ids[9003]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == set(ids)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def shingles(text, width=5):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain_mask(text, spans):
    """Each run of overlapping spans becomes the mark of its first (at one start, its longest) span."""
    out, at = "", 0
    while at < len(text):
        here = [(b, k) for k, a, b in spans if a == at]
        if not here:
            out, at = out + text[at], at + 1
            continue
        end, kind = max(here, key=lambda x: x[0])
        while any(a < end < b for _, a, b in spans):
            end = max(b for _, a, b in spans if a < end)
        out, at = out + f"<{kind}>", end
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_stages_equal_plain_versions(spark, tmp_path):
    """Every stage behind language ID against its rule in plain Python, each on its own input."""
    rng = random.Random(4)
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in given.orderBy("doc_id").limit(90).collect()]
    at = {name: i for i, name in enumerate(given.columns)}

    def like(row, doc_id, text):
        new = list(row)
        new[at["doc_id"]], new[at["text"]] = doc_id, text
        return tuple(new)

    for n, row in enumerate(rows[:24]):
        words = (row[at["text"]] or "one two three four five six").split(" ")
        for _ in range(1 + len(words) // 40 * (n % 2)):
            words[rng.randrange(len(words))] = f"word{rng.randrange(10**6)}"
        own = " ".join(f"own{n}w{i}" for i in range(30)) + f" write to ann{n}@mail.example.com or +1 (269) 555-32{n:02d} about it"
        rows += [like(row, 9_000 + n, row[at["text"]]), like(row, 9_100 + n, " ".join(words)), like(row, 9_200 + n, own)]
    docs = spark.createDataFrame(rows, given.schema)
    stages, texts = dict(corpus_pipeline.STAGES), lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    def kept(name, df):
        stages[name](spark, df, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    lines = kept("line_dedup", docs)
    assert texts(lines) == brute_lines([(r[at["doc_id"]], r[at["text"]]) for r in rows])

    # near duplicates on the documents as they are: the lines' stage leaves few
    apart, whole = kept("simhash", docs), texts(docs)
    sets = {k: shingles(t or "") for k, t in whole.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4]
    assert len(links) > 40 and texts(apart) == {k: whole[k] for k in closure(sets, links).values()}
    left = texts(lines)
    assert set(texts(stages["simhash"](spark, lines, SF))) <= set(left)

    field = pii._field(pii.learn(apart).tobytes())
    masked, before = kept("pii", apart), texts(apart)
    spans = {k: pii.all_spans(t or "", field)[1] for k, t in before.items()}
    assert all(set(reference(t or "")) <= set(spans[k]) for k, t in before.items()) and sum(map(len, spans.values())) > 40
    assert texts(masked) == {k: t and plain_mask(t, spans[k]) for k, t in before.items()}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts(masked).items()}
    pieces = stages["packing"](spark, masked, SF).collect()
    found, windows = {}, {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        own = found.setdefault(r["doc_id"], [])
        assert r["start"] == len(own) and r["length"] > 0
        own += np.frombuffer(r["ids"], "<u4").tolist()
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == ids
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(windows) <= -(-sum(map(len, ids.values())) // 2048) + 1
