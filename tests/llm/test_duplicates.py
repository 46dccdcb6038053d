"""SimHash, line dedup and embedding near-duplicates against brute force on small fixtures."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from casewright.llm import embedding_dedup, hnsw, licenses, line_dedup, simhash
from casewright.llm.shared import components

RNG = random.Random(11)
WORDS = ["w%d" % i for i in range(60)]


def closure(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components(spark):
    names = list(range(20_000, 22_000))
    RNG.shuffle(names)
    edges = [(i, i + 1) for i in range(2_000)] + [(7_000 - i, 6_999 - i) for i in range(2_000)] + list(zip(names, names[1:]))  # rising, falling, shuffled
    edges += [(30_500, 30_501 + i) for i in range(10_000)] + [(50_000, 50_000), (50_009, 50_001), (50_001, 50_005)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    low = {i: 0 for i in range(2_001)} | {i: 5_000 for i in range(5_000, 7_001)} | {i: 20_000 for i in names} | {i: 30_500 for i in range(30_500, 40_501)}
    assert got == low | {50_000: 50_000, 50_009: 50_001, 50_001: 50_001, 50_005: 50_001}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_random_links(spark):
    edges = [(RNG.randrange(300), RNG.randrange(300)) for _ in range(200)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == closure({x for e in edges for x in e}, edges)


def test_fingerprint_is_the_stated_one():
    import xxhash

    text = "Uno  DOS\ttres cuatro É cinco"
    w = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint_words(text) & (1 << 64) - 1 == expected
    assert simhash.fingerprint_words(" \n") == 0
    assert simhash.fingerprint_words("a b") & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b", 42)


def test_fingerprint_hash_is_sparks(spark):
    import xxhash

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b c d", 42)


def test_simhash_links(spark):
    base = [RNG.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ (1 << RNG.randrange(64)) ^ (1 << RNG.randrange(64)) for b in base for _ in range(4)] + [base[0] ^ 31, base[0] ^ 15]
    fps = sorted({simhash._signed(f) for f in fps})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    near = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert {tuple(r) for r in simhash.links(distinct).collect()} == near
    expected = closure(fps, near)
    for dense in (4096, 1):  # with 1 every cell is crowded: all links come from variants
        got = dict(components(simhash.links(distinct, dense=dense).union(distinct.select("fp", F.col("fp")))).collect())
        assert got == expected


def test_exploded_sides_are_not_broadcast(spark, tmp_path):
    """Few fingerprints are small as a file, but not where each stands in fifteen cells or has 2,081 variants."""
    spark.createDataFrame([(RNG.getrandbits(63),) for _ in range(500)], "fp bigint").write.parquet(str(tmp_path / "fp"))
    distinct = spark.read.parquet(str(tmp_path / "fp"))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    for df in (simhash.links(distinct), simhash.variant_links(distinct)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_common_shingles_fit_the_driver(spark, monkeypatch):
    sample = spark.createDataFrame([([*range(i)],) for i in range(1, 41)], "shingles array<bigint>")  # shingle t is in 39 - t + 1 sets
    assert simhash.common_shingles(sample) == list(range(33))
    assert simhash.common_shingles(sample, most=5) == [0, 1, 2, 3, 4] and simhash.common_shingles(sample, most=0) == []
    assert simhash.common_shingles(sample.limit(0)) == []


def test_shingles_of_many_texts(spark):
    """Hashes are one to one with the word shingles, whatever the texts and blocks they are made with."""
    texts = ["", None, " ", "a", "a b", " a  b c d e ", "A b\tc D\x0be f", "é x y z", "q" * 3000 + " r"] + ["".join(RNG.choice("ab \n") for _ in range(RNG.randrange(60))) for _ in range(800)]
    known = {}
    for text, hashes in zip(texts, simhash.shingle_lists(texts, 5)):
        w = (text or "").encode().lower().split()
        shingles = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert len(shingles) == len(hashes) and all(known.setdefault(s, h) == h for s, h in zip(shingles, hashes.tolist()))
    assert len(set(known.values())) == len(known) > 1000
    data = np.frombuffer(" ".join([t or "" for t in texts] + [""]).lower().encode(), np.uint8)
    for one, other in zip(simhash._word_hashes(data), simhash._word_hashes(data, 50)):
        assert (one == other).all()
    assert simhash.shingle_lists([], 5) == []


def test_prefixes_in_the_order_of_common_shingles(spark):
    """A long list of common shingles costs a search each, not a sort of the list for each text."""
    import time

    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 997}" for j in range(1, 300)), i) for i in range(1, 400)], "doc_id int, text string, _cw_text bigint").repartition(2)
    kind = {"width": 5, "key": "doc_id", "text": "text"}
    whole = {r["doc_id"]: sorted(r["shingles"]) for r in simhash.shingle_sets(docs, **kind).collect()}
    common = sorted({t for s in whole.values() for t in s})[::3] + list(range(300_000))
    began = time.time()
    got = {r["doc_id"]: r["shingles"] for r in simhash.shingle_sets(docs, **kind, common=common).collect()}
    assert time.time() - began < 15  # sorting the list for each text took 0.1 s a text
    often = set(common)
    assert got == {k: sorted(s, key=lambda t: (t in often, t))[: len(s) - -(-4 * len(s) // 5) + 1] for k, s in whole.items()}


def test_simhash_documents(spark):
    long = " ".join(RNG.choice(WORDS) for _ in range(400))
    rows = [(5, long, 1), (3, long + " extra", 2), (9, long.upper(), 3), (1, "otro texto del todo distinto aquí", 4), (2, None, 5), (4, " ", 6), (None, long, 7), (1, "otro texto del todo distinto aquí", 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, fp int").withColumn("component", F.lit("clash"))
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (1, 1), (2, 2), (4, 2), (None, 3)}
    kept = simhash.keep_dissimilar(df.withColumn("_k", F.lit(1)).withColumn("c", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4] and kept.columns == [*df.columns, "_k", "c"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_dissimilar_is_the_component_rule(spark):
    rng = random.Random(5)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    def near(a, b):
        return len(a & b) * 5 >= len(a | b) * 4

    passage = ["p%d" % i for i in range(25)]
    texts = []
    for g in range(25):
        w = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([5, 8, 60, 150, 400]))] + passage * (g % 2)
        texts.append(" ".join(w))
        for changes in (1, 2, 3, 5, 8):  # similarities on both sides of 0.8
            c = list(w)
            for at in rng.sample(range(len(c)), min(changes, len(c))):
                c[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(c))
        texts.append(" ".join(w + ["one", "more", "end"]))
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    jaccards = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in links]
    assert sum(0.8 <= x < 0.95 for x in jaccards) > 20
    label = closure(range(len(texts)), links)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, " "), (902, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(r["doc_id"] for r in simhash.keep_dissimilar(df).collect())
    assert got == sorted({*label.values(), 900, 901, 902})
    assert simhash.keep_dissimilar(df.limit(0)).count() == 0


def test_near_copies_meet_by_pivot_tables(spark, monkeypatch):
    """Near fingerprints are linked by the method's own step, without prefix shingles; what is too far for it needs these."""
    long = [f"v{i}" for i in range(600)]
    texts = [" ".join(long), " ".join([*long, "end"]), " ".join(long[:560]), " ".join(f"u{i}" for i in range(300)), " ".join(long[300:] + ["x"] * 300)]
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    bits = [bin((simhash.fingerprint_of(sets[0]) ^ simhash.fingerprint_of(s)) & (1 << 64) - 1).count("1") for s in sets]
    assert bits[1] <= simhash.DISTANCE < bits[2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kept = lambda: sorted(r["doc_id"] for r in simhash.keep_dissimilar(df).collect())
    assert kept() == [0, 3, 4]
    entries = simhash.prefix_entries
    monkeypatch.setattr(simhash, "prefix_entries", lambda *a: entries(*a).filter("false"))
    assert kept() == [0, 2, 3, 4]


def brute_lines(rows, t=0.8):
    lines = [(k, i, line) for k, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: r[0]) for i, line in enumerate(text.split("\n"))]
    out, seen = {}, []
    for k, i, line in lines:
        s = frozenset(w for w in re.split(r"[ \t\x0b\f\r]", line.lower()) if w)
        near = s and any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen)
        if s:
            seen.append(s)
        if not near:
            out.setdefault(k, []).append(line)
    return {k: "\n".join(out.get(k, [])) for k, text in rows if text is not None}


def test_line_dedup_is_exact(spark):
    def line():
        return " ".join(RNG.choice(WORDS) for _ in range(RNG.choice([1, 3, 5, 12, 30, 140])))

    pool = [line() for _ in range(40)]
    rows = []
    for k in range(40):
        picked = [RNG.choice(pool) for _ in range(4)] + [line(), "", " \t"]
        picked += [" ".join(w for w in p.split() if RNG.random() > 0.08) for p in picked[:3]]
        rows.append((k, "\n".join(picked)))
    rows += [(99, None), (98, ""), (97, "HOLA mundo\nhola   mundo\tHola")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("n", F.lit(1)).withColumn("first", F.lit("clash"))
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts.pop(99) is None and texts == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_many_near_copies(spark):
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[: i % 40] + [f"x{i}"] + base[i % 40 + 1 :])) for i in range(3_000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string")).filter("text <> ''").collect()
    assert [r["doc_id"] for r in got] == [0]  # two words of 40 differ at most: all are near the first
    levels = line_dedup.rarity(spark.createDataFrame(rows, "doc_id int, text string"), "text")
    classes = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id int, text string"), levels)
    settled = line_dedup.first_witnesses(classes, 0.8)
    assert settled.count() <= 4 * 3_000 and line_dedup.candidate_pairs(classes, settled, 0.8).count() <= 3_000


def test_line_dedup_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a b\nc d"), (1, "a b\nc d"), (None, "a b\nq r"), (2, "c d")], "doc_id int, text string")
    got = line_dedup.dedup_lines(df, n_lines="l", n_removed="x").collect()
    assert sorted((str(r["doc_id"]), r["text"], r["l"], r["x"]) for r in got) == [("1", "c d", 2, 1), ("1", "c d", 2, 1), ("2", "", 1, 1), ("None", "a b\nq r", 2, 0)]


def vectors(n=60, dim=16):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(n, dim))
    near = base[:20] + 0.12 * rng.normal(size=(20, dim))
    chain = [base[0] + s * 0.25 * base[1] for s in range(5)]
    return np.concatenate([base, near, np.array(chain), base[:3], 2.5 * base[3:5]]).astype(np.float32)


def rows_of(v):
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    return rows + [(900, None), (901, [0.0] * v.shape[1]), (902, [float("nan")] * v.shape[1]), (903, [1.0, 2.0])]


def test_embedding_links_are_exact(spark):
    v = vectors()
    df = spark.createDataFrame(rows_of(v), "vec_id bigint, embedding array<float>").withColumn("rep", F.lit("clash"))
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9 - 1e-12
    links = s.sum(1) - 1
    label = closure(range(len(v)), [(i, j) for i in range(len(v)) for j in range(i) if s[i, j]])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(v) + 4
    for i in range(len(v)):
        assert got[i] == (links[i], label[i], label[i] == i)
    assert all(got[i] == (0, i, True) for i in (900, 901, 902, 903))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_tiles_bound_both_sides(spark, monkeypatch):
    v = np.random.default_rng(6).normal(size=(300, 6)) * 0.01 + 1
    df = spark.createDataFrame(rows_of(v)[:300], "vec_id bigint, embedding array<float>")
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == whole and whole[5] == (5, 299, 0, False)
    placed = embedding_dedup.place(df.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("w"), F.col("embedding").cast("array<double>").alias("v")), 0.9, 4)
    sizes = embedding_dedup.tiled(placed).groupBy(*embedding_dedup.CELL, "tile", "across", F.col("side") == 0).count()
    assert sizes.agg(F.max("count")).first()[0] <= 60  # of up to 300; dealt by hash


def test_tiles_are_not_copied_for_those_they_meet(spark, monkeypatch):
    """Every point stands in one tile a block however many tiles its cell has, and tiles meet without a shuffle."""
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    v = np.random.default_rng(6).normal(size=(300, 6)) * 0.01 + 1
    points = spark.createDataFrame([(i, 1, x) for i, x in enumerate(v.tolist())], "rep bigint, w bigint, v array<double>")
    placed = embedding_dedup.place(points, 0.9, 4)
    tiles = embedding_dedup.gathered(embedding_dedup.tiled(placed))
    assert tiles.agg(F.sum(F.size("rep")), F.sum(F.size("v"))).first()[:] == (placed.count(), 6 * placed.count()) and tiles.count() > 30
    met = embedding_dedup.meeting(tiles)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    pairs = met.select("block", "own", F.explode("a.rep").alias("i"), "b").select("block", "own", "i", F.explode("b.rep").alias("j")).filter("not own or i < j")
    at = {(r["block"], r["rep"]): (r["x"], r["y"]) for r in placed.collect()}
    beside = lambda b, i, j: max(abs(p - q) for p, q in zip(at[b, i], at[b, j])) <= 1
    got = sorted((r["block"], min(r["i"], r["j"]), max(r["i"], r["j"])) for r in pairs.collect())
    assert got == sorted((b, i, j) for b in {b for b, _ in at} for i in range(300) for j in range(i + 1, 300) if beside(b, i, j))


def test_embeddings_of_any_size_of_numbers(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (2, [1.0, 2.0]), (3, [2.0, -1.0]), (4, [1.0, None]), (None, [1.0, 2.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).filter("vec_id is not null").collect())
    assert got == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
    near = hnsw.nearest(df, df.filter("vec_id = 1"), k=2).collect()
    assert [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in sorted(near)] == [(1, 2, 1.0), (2, 2, 1.0)]


def test_nearest_has_recall(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    v[700:720] = v[0]
    df = spark.createDataFrame(rows_of(v), "vec_id bigint, embedding array<float>")
    got = hnsw.nearest(df, df.filter("vec_id % 50 = 0"), shard=400, block=16).collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, len(v), 50):
        s = u @ u[q]
        s[q] = -2
        top = np.lexsort((np.arange(len(v)), -np.round(s, 12)))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - u[m[1]] @ u[q]) < 1e-9 for m in mine)
        hit, total = hit + len(set(top.tolist()) & {m[1] for m in mine}), total + 5
        if q == 0:
            assert [m[1] for m in mine] == [700, 701, 702, 703, 704]
    assert hit / total >= 0.9
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


def test_shards_meet_queries_without_copies(spark, monkeypatch):
    """Neither shards nor blocks are shuffled or broadcast for each other, and a walk finds each node once."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame(rows_of(v), "vec_id bigint, embedding array<float>")
    plan = hnsw.nearest(df, df.filter("vec_id % 10 = 0"), shard=200, block=16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    u = hnsw.unit(v.astype(float))
    got = hnsw.search(u, hnsw.build(u), u[:300], 40)
    assert all(len(set(x[x >= 0].tolist())) == (x >= 0).sum() > 5 for x in got)
    exact = np.argsort(-(u[:300] @ u.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact.tolist(), got[:, :5].tolist())]) > 0.95


def test_license_scan(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Ana\n\n" + mit.replace("notice", "NOTICE").replace(",", " ,")), (2, mit + " more"), (3, None), (4, ""), (5, "licensed under the apache licence; version 2.0"), (5, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("license", F.lit("clash"))
    got = licenses.scan(df).collect()
    assert sorted((r["doc_id"], r["license"] or "") for r in got) == [(1, "MIT"), (2, ""), (3, ""), (4, ""), (5, ""), (5, "Apache-2.0 (line)")]
    assert [r["digest"] for r in got if r["doc_id"] == 3] == [None] and licenses.scan(df.limit(0)).count() == 0


def license_files():
    """(id, licence, text) as the files are distributed: a title, a copyright line, wrapped lines."""
    import textwrap

    owners = ["Copyright (c) 2021 Jane Doe", "Copyright <year> <owner>", "Copyright Jane van Doe", "Copyright Jane Doe and Contributors", "(C) 1999 X", ""]
    out = []
    for k, text in licenses.KNOWN.items():
        for i, title in enumerate(("", *licenses.TITLES.get(k, ()))):
            body = "\n\n".join(textwrap.fill(p, 60 + i) for p in text.split("\n\n"))
            out.append((len(out), k, "\n\n".join(x for x in (title, owners[(len(out) + i) % len(owners)], body) if x)))
    return out


def test_license_files_are_found_as_in_sql(spark):
    import duckdb

    from casewright.llm.queries import _license_sql

    files = license_files()
    rows = [(i, t) for i, _, t in files] + [(900, "licence licence LICENCED https http sub license"), (901, None), (902, "sin licencia\nCopyright Holder shall")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r["doc_id"]: (r["license"], r["digest"]) for r in licenses.scan(df).collect()}
    assert [got[i][0] for i, _, _ in files] == [k for _, k, _ in files]
    con = duckdb.connect()
    con.execute("create table documents(doc_id int, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert {a: (b, c) for a, b, c in con.execute(_license_sql()).fetchall()} == got


def test_whole_license_texts(spark):
    from pathlib import Path

    import pytest

    folder = Path("/usr/share/common-licenses")
    if not (folder / "GPL-3").exists():
        pytest.skip("needs the licence texts of the system")
    rows = [(n, (folder / n).read_text().replace("\n", "\r\n")) for n in ("GPL-3", "Apache-2.0", "MPL-2.0", "LGPL-2.1")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0 (full)", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1"}


def test_one_key_with_other_vectors(spark):
    e, f = [1.0, 0.0, 0.0, 0.0], [0.999, 0.0447, 0.0, 0.0]
    far, near = [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]
    of = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(of([(1, e), (1, f)])).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True)]
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(of([(5, far), (5, e), (6, e), (7, e), (9, f), (8, near)])).collect())
    assert got == [(5, 0, 5, True), (5, 3, 5, True), (6, 3, 5, False), (7, 3, 5, False), (8, 0, 8, True), (9, 3, 5, False)]
    table = of([(50, e), (50, far), (7, f), (7, near), (3, e)])
    near_of = lambda q: sorted((r["rank"], r["vec_id"], round(r["score"], 3)) for r in hnsw.nearest(table, of([q]), k=5).collect())
    assert near_of((50, e)) == [(1, 3, 1.0), (2, 7, 0.999), (3, 7, 0.0), (4, 50, 0.0)]
    assert [r[1] for r in near_of((50, far))] == [3, 7, 7, 50]
    both = hnsw.nearest(table, table.filter("vec_id = 50"), k=5).collect()
    assert len(both) == 8 and {r["query_id"] for r in both} == {50}
