"""Piece BPE and packing: against the libraries, and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from casewright.llm import packing, piece_bpe  # noqa: E402
from casewright.llm.queries import PIECES, TOKENIZER, tokenizer_file  # noqa: E402

ALPHABET = "ab e ▁ \n\t0é中😀  tion's1. "
RNG = random.Random(3)
TEXTS = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 40))) for _ in range(800)] + ["", " ", " " * 700, "ab" * 900, "<s> <0x0A> <|endoftext|>"]


def test_piece_bpe_equals_the_library(monkeypatch):
    import sentencepiece

    model = tokenizer_file(PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    m = piece_bpe.PieceModel(model)
    expected = sp.encode(TEXTS)
    got = m.encode(TEXTS)
    assert [g.tolist() for g in m.encode(whole_texts())] == sp.encode(whole_texts())
    assert [g.tolist() for g in got] == expected
    assert m.decode(np.concatenate(got), np.array([len(g) for g in got])) == [sp.decode(x) for x in expected]
    monkeypatch.setattr(piece_bpe, "LONG_UNIT", 4)
    m.cache.clear()
    assert [g.tolist() for g in m.encode(TEXTS)] == expected


def test_piece_bpe_in_spark(spark):
    model = tokenizer_file(PIECES)
    rows = [(1, "hola mundo", "x"), (1, "hola mundo", "x"), (2, None, "y"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, decoded string")
    coded = piece_bpe.encode(df, model)
    got = piece_bpe.decode(coded, model).select("doc_id", F.size("ids").alias("n"), "decoded").collect()
    assert sorted((str(r["doc_id"]), r["n"] > 0, r["decoded"]) for r in got) == [("1", True, "hola mundo"), ("1", True, "hola mundo"), ("2", False, ""), ("None", False, "")]
    assert piece_bpe.encode(df.limit(0), model).count() == 0


def whole_texts():
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text", "lang"]).to_pylist()
    assert len({r["lang"] for r in rows}) > 3
    return [r["text"] or "" for r in rows]


@pytest.mark.parametrize("special", [True, False])
def test_text_tokenizer_equals_the_library(special):
    """special: the library as it comes; else with the switch that makes such strings plain text."""
    from tokenizers import Tokenizer

    raw = tokenizer_file(TOKENIZER)
    t = Tokenizer.from_str(raw.decode())
    if not special:
        t.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> <|endof", *(x[:9] + "<|endoftext|>" + x[9:] for x in TEXTS[:200])] + TEXTS + whole_texts() + ["a" + " " * 1_200_000 + "b", "\n" * 1_100_000, "a  b\u00a0\u2003 c\x1c\x85d " * 3_000, "xy" * 200_000]
    expected = [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]
    w = packing.TextTokenizer(raw, special)
    assert (50256 in w.bpe.encode(texts[0], add_special_tokens=False).ids) == special
    assert w.ranked
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts, 1)] == expected
    assert [np.frombuffer(x, "<u2").tolist() for x in w.encode(texts, 1, "<u2")] == expected
    w.ranked = None
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts, 1)] == expected


def test_plan_serves_the_histogram():
    h = np.random.default_rng(1).integers(0, 50, 65)
    h[0] = h[64] = 0
    found = packing.plan(h, 64)
    used = np.bincount(found[:, :3].ravel(), weights=np.repeat(found[:, 3], 3), minlength=65)[1:]
    assert (used <= h[1:]).all() and (found[:, :3].sum(1) == 64).all()
    assert len(packing.plan(np.zeros(65, int), 64)) == 0


@pytest.mark.parametrize("hot", [False, True])
def test_packing_is_whole(spark, hot):
    rng = random.Random(5)
    rows = [(i // 2, " ".join("w" + str(rng.randint(0, 999)) for _ in range(150 if hot else rng.randint(0, 900)))) for i in range(120)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("uid", F.lit(1)).withColumn("start", F.lit("clash"))
    raw = tokenizer_file(TOKENIZER)
    got = packing.pack_documents(df, raw, end=1, window=256).withColumn("crc", F.crc32("ids")).collect()
    w = packing.TextTokenizer(raw)
    ids = [np.frombuffer(x, "<u4") for x in w.encode([t or "" for _, t in rows], 1)]
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    assert all(zlib.crc32(bytes(r["ids"])) == r["crc"] and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 256 for r in got)
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fills = []
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        fills.append(at)
    assert max(fills) <= 256 and sum(f < 256 for f in fills) <= 1
    docs = {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for key, parts in docs.items():
        own = sorted(bytes(x.astype("<u4").tobytes()) for (k, _), x in zip(rows, ids) if k == key)
        assert sorted(b for _, b in parts) and sum(len(b) for _, b in parts) == sum(map(len, own))
        if len(own) == 1:
            assert b"".join(b for _, b in sorted(parts)) == own[0]
    assert packing.pack_documents(df.limit(0), raw).count() == 0
