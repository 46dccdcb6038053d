"""Numbers without a task a group, and names that meet by segments."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from casewright.operators import findings, graph, resolve
from casewright.operators.ranks import first_rows, numbered


def test_numbers_of_one_case_are_dealt(spark):
    rng = random.Random(1)
    rows = [("c" if i % 10 else None, rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "case_id string, x int, y int, w int")
    got = numbered(df, ["case_id"], [F.desc("x"), "y"], "n").collect()
    for case in ("c", None):
        mine = sorted((r for r in rows if r[0] == case), key=lambda r: (-r[1], r[2]))
        assert [(r["y"]) for r in sorted((r for r in got if r["case_id"] == case), key=lambda r: r["n"])] == [r[2] for r in mine]
        assert sorted(r["n"] for r in got if r["case_id"] == case) == list(range(1, len(mine) + 1))
        summed, total = {r["y"]: r["s"] for r in numbered(df, ["case_id"], [F.desc("x"), "y"], "s", weight="w").filter(F.col("case_id").eqNullSafe(F.lit(case))).collect()}, 0
        for r in mine:
            assert summed[r[2]] == total
            total += r[3]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on data that doesn't fit one range
    try:
        sizes = df.repartitionByRange("case_id", F.desc("x"), "y").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        dealt = {r["y"]: r["n"] for r in numbered(df, ["case_id"], [F.desc("x"), "y"], "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes < 1500 and dealt == {r["y"]: r["n"] for r in got} and numbered(df.limit(0), ["case_id"], ["x"], "n").count() == 0


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    got = first_rows(df, ["k"], [F.desc("v")], 3, "r")
    assert sorted(map(tuple, got.collect())) == [(0, 4994, 3), (0, 4996, 2), (0, 4998, 1), (1, 4995, 3), (1, 4997, 2), (1, 4999, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_crowded_chunks_meet_in_tiles(spark):
    rows = [("c", i // 60, "PERSONA" if i % 3 else "LUGAR", f"n{i % 60}") for i in range(240)] + [("c", 9, "PERSONA", "n1")]
    m = spark.createDataFrame(rows, "case_id string, chunk int, kind string, name string")
    for a, b in (("PERSONA", "PERSONA"), ("PERSONA", "LUGAR")):
        assert sorted(map(tuple, graph.co_occurrence(m, a, b, tile=7).collect())) == sorted(map(tuple, graph.co_occurrence(m, a, b).collect()))
    holders = m.withColumn("role", F.col("kind"))
    assert sorted(map(tuple, graph.juridical_edges(holders, tile=7).collect())) == sorted(map(tuple, graph.juridical_edges(holders).collect()))


def test_many_repeats_are_one_small_row(spark):
    f = spark.range(500).select(F.lit("c").alias("case_id"), F.lit("inconsistencias").alias("category"), F.col("id").alias("seq"), F.lit("t").alias("type"), F.lit("alta").alias("severity"), F.lit("El testigo dice  una cosa distinta").alias("description"), F.array(F.lit("P")).alias("people"), F.struct(F.lit("f").alias("file"), F.col("id").alias("chunk")).alias("location"))
    one = findings.collapse(f).first()
    assert [x["chunk"] for x in one["locations"]] == list(range(10)) and one["repeats"] == 500 and findings.finding_locations(f).count() == 500
    assert tuple(findings.listed(findings.with_ids(findings.collapse(f))).select(F.size("shown"), "more").first()) == (10, 490)
    t = f.select("case_id", "seq", F.lit("PERSONA_1").alias("alias"), F.lit("x").alias("role"), F.array(F.col("seq").cast("string"), F.lit("z")).alias("actions"), F.array(F.format_string("p%03d", "seq")).alias("people"), F.array().cast("array<string>").alias("vehicles"), "location")
    one = findings.merge_traces(t).first()
    assert one["actions"] == ["0", "z", "1", "2", "3"] and one["people"][9] == "p009" and (one["n_actions"], one["n_people"], one["n_vehicles"], one["n_locations"]) == (501, 500, 0, 500)


@pytest.mark.parametrize("native", [False, True])
def test_similar_names_equal_all_pairs(spark, native):
    rng = random.Random(7)
    parts = ["juan", "pérez", "ana", "maria", "lopez", "de la cruz", "mendoza", "ruiz", "x"]
    base = [" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(170)]

    def bent(n: str) -> str:
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(n))
            n = rng.choice((n[:i] + rng.choice("abñ ") + n[i:], n[:i] + n[i + 1 :], n[:i] + "z" + n[i + 1 :]))
        return n

    names = sorted({bent(rng.choice(base)) for _ in range(1500)})[:1000]
    rows = [(c, n, rng.randint(1, 3)) for c, part in (("c", names), ("d", names[:40])) for n in part]
    assert len(names) == 1000
    t = 0.8

    def ratio(a: str, b: str) -> float:
        if not native:
            m = SequenceMatcher(None, a, b)
            return m.ratio() if m.real_quick_ratio() >= t and m.quick_ratio() >= t else 0.0
        row = list(range(len(b) + 1))
        if min(len(a), len(b)) < t * max(len(a), len(b)) - 1:
            return 0.0
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b), 1)

    some = [r for r in rows if r[0] == "d" or r[1] in set(rng.sample(names, 220 if native else 600))]
    expected = set()
    for i, x in enumerate(some):
        for y in some[i + 1 :]:
            if x[0] == y[0]:
                a, b = (x, y) if (-x[2], x[1]) < (-y[2], y[1]) else (y, x)
                if ratio(a[1], b[1]) >= t:
                    expected.add((a[0], a[1], b[1]))
    df = spark.createDataFrame(some, "case_id string, norm string, mentions int")
    got = {(r["case_id"], r["a"], r["b"]) for r in resolve.similar_pairs(df, threshold=t, native=native).collect()}
    assert got == expected and len(got) > 50
    n, cand = len(some), resolve.candidate_pairs(df, threshold=t, native=native).count()
    assert cand < n * n / 4
