import pytest
from pyspark.sql import functions as F

from casewright.operators import findings, graph
from casewright.plans import entity_queries, views

KEY = ["case_id", "chunk", "name"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Few suppliers; an order with many lines, an order key that repeats, null flags, lines that repeat."""
    d = str(tmp_path_factory.mktemp("odd"))
    put = lambda df, n: df.write.parquet(f"{d}/{n}.parquet")
    k = F.col("id")
    put(spark.range(40).select(k.alias("s_suppkey"), F.when(k < 39, F.concat(F.lit("S"), (k % 37).cast("string"))).alias("s_name")), "supplier")
    put(spark.range(3).select(k.alias("n_nationkey"), F.concat(F.lit("N"), k.cast("string")).alias("n_name")), "nation")
    put(spark.range(20).select(k.alias("c_custkey"), (k % 3).alias("c_nationkey")), "customer")
    orders = spark.range(400).select(k.alias("o_orderkey"), (k % 20).alias("o_custkey"), F.expr("timestamp_seconds(id * 1000000)").alias("o_orderdate"), F.when(k % 50 != 49, F.concat(F.lit("c"), (k % 2).cast("string"))).alias("o_orderpriority"))
    again = orders.filter("o_orderkey < 5").withColumn("o_orderdate", F.expr("o_orderdate + interval 90 days"))
    put(orders.unionByName(again), "orders")
    lines = spark.range(2400).select(F.when(k < 800, 7).otherwise(F.pmod(F.xxhash64(k), F.lit(400))).alias("l_orderkey"), F.pmod(F.xxhash64(k, F.lit(1)), F.lit(40)).alias("l_suppkey"), (k % 50).alias("l_partkey"), F.when(k % 11 != 0, F.element_at(F.array(*map(F.lit, "RAN")), (k % 3 + 1).cast("int"))).alias("l_returnflag"), F.when(k % 7 != 0, F.when(k % 2 == 0, "O").otherwise("F")).alias("l_linestatus"))
    put(lines, "lineitem")
    return d


def rows(df, *c):
    return sorted(map(str, df.select(*c).collect()))


@pytest.mark.parametrize("most", [3, 1000])
def test_sheets_hold_the_mentions(spark, odd, most):
    m, s = views.mentions(spark, odd), views.sheets(spark, odd, most=most).cache()
    assert rows(views.sheet_mentions(s), *m.columns) == rows(m, *m.columns)
    calm = s.filter("calm")
    assert calm.count() == calm.select("chunk").distinct().count() > 0 and calm.filter(F.size("lines") > most).isEmpty()
    assert calm.join(s.filter("not calm").select("chunk"), "chunk").isEmpty() and s.filter("not calm and chunk = 1").count() > 1
    one, all_of = views.sheet_findings(s), views.order_findings(m)
    assert rows(one, *all_of.columns) == rows(all_of, *all_of.columns)
    of_r = views.sheet_findings(views.sheets(spark, odd, source="R", most=most))
    assert rows(of_r, *all_of.columns) == rows(all_of, *all_of.columns)


@pytest.mark.parametrize(("most", "keep"), [(3, 2), (1000, 5), (6, 80)])
def test_people_of_sheets_have_the_scores_of_all(spark, odd, monkeypatch, most, keep):
    whole = views.sheets
    monkeypatch.setattr(views, "sheets", lambda *a, **more: whole(*a, **more, most=most))
    monkeypatch.setattr(entity_queries, "LIMITS", {"PERSONA": keep, "VEHICULO": 3, "LUGAR": 2})
    c = ["case_id", "kind", "name", "mentions", "sources", "roles", "relations", "score", "rank"]
    got = entity_queries._Graph(spark, odd).ranked.filter("kind = 'PERSONA'")
    expected = graph.top_entities(entity_queries._scored(spark, odd), entity_queries.LIMITS).filter("kind = 'PERSONA'")
    assert rows(got, *c) == rows(expected, *c)


def test_first_findings_need_few_rows(spark, monkeypatch):
    """The first findings of a case are those of all, where keys repeat so often that the first rows are too few, too."""
    some = spark.range(3000).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("case_id"), F.lit("t").alias("category"), F.lit("t").alias("type"), F.lit("alta").alias("severity"), F.col("id").alias("seq"), F.array(F.lit("p")).alias("people"), F.struct(F.lit("f").alias("file"), F.col("id").alias("chunk")).alias("location"))
    said = F.when((F.col("case_id") == "b") & (F.col("seq") < 2900), F.lit("el testigo dice siempre una misma cosa")).otherwise(F.concat(F.lit("el testigo dice una cosa distinta "), F.floor(F.col("seq") / 6).cast("string")))
    some = some.withColumn("description", said)
    written, stage = [], findings.stage_table
    monkeypatch.setattr(findings, "stage_table", lambda df, name: (written.append((name, df.count())), stage(df, name))[1])
    got = {(r["case_id"], r["finding_id"]): r["seq"] for r in findings.graph_findings(some, keep=4).collect()}
    firsts = {c: {} for c in ("a", "b", None)}
    for r in some.orderBy("seq").collect():
        firsts[r["case_id"]].setdefault(r["description"], r["seq"])
    assert got == {(c, f"HALLAZGO_{i + 1:03d}"): s for c, f in firsts.items() for i, s in enumerate(sorted(f.values())[:4])}
    assert dict(written)["first"] < 300


def test_places_need_no_people(spark, odd, monkeypatch):
    top = entity_queries._Graph(spark, odd).top
    expected = entity_queries.R.entity_tables(top)["lugar"].select("case_id", "lugar_id", "menciones_total", F.array_join("chunks", ",").alias("chunks"))
    monkeypatch.setattr(graph, "leading_listed", None)
    assert rows(entity_queries.r5_lugar(spark, odd), *expected.columns) == rows(expected, *expected.columns)
    assert entity_queries.r5_vehiculo(spark, odd).count() > 0


@pytest.mark.parametrize("most", [3, 1000])
def test_edges_arise_within_sheets(spark, odd, monkeypatch, most):
    """Edges are those of all members, and no member of a calm sheet is paired outside of its row."""
    whole, plain, met = views.sheets, graph.co_occurrence, []
    monkeypatch.setattr(views, "sheets", lambda *a, **more: whole(*a, **more, most=most))
    monkeypatch.setattr(entity_queries, "LIMITS", {"PERSONA": 20, "VEHICULO": 10, "LUGAR": 2})
    monkeypatch.setattr(graph, "co_occurrence", lambda members, *kinds: (met.append(members.select("chunk")), plain(members, *kinds))[1])
    g = entity_queries._Graph(spark, odd)
    edges, calm = g.edges, g.calm.select("chunk")
    assert met and all(m.join(calm, "chunk").isEmpty() for m in met)
    m = views.mentions(spark, odd)
    members = graph.chunk_members(views.long_form(m).join(g.ranked, ["case_id", "kind", "name"], "left_semi"))
    holders = g._among(m.filter("source = 'A'").withColumnRenamed("person", "name"), "name")
    juridical = graph.juridical_edges(holders)
    c = ["case_id", "src", "dst", "n", "label"]
    assert rows(edges.filter("kind = 'juridica'"), *c) == rows(juridical, *c)
    pairs = graph.co_occurrence_edges(plain(members, "PERSONA", "PERSONA")).join(juridical, ["case_id", "src", "dst"], "left_anti")
    assert rows(edges.filter("kind = 'coocurrencia'"), *c[:4]) == rows(pairs, *c[:4])
    for kind, name in (("LUGAR", "lugar"), ("VEHICULO", "vehiculo")):
        expected = plain(members, "PERSONA", kind).select("case_id", F.col("a").alias("src"), F.col("b").alias("dst"), "n")
        assert expected.count() > 0 and rows(edges.filter(F.col("kind") == name), *c[:4]) == rows(expected, *c[:4])
