from pyspark.sql import functions as F

from casewright.operators import findings, graph, relational, resolve


def test_clusters_are_a_partition(spark):
    n = spark.createDataFrame([("c", f"juan perez {x}", 10 - i) for i, x in enumerate(["a", "b", "lopez", "lopes", "lopess"])], "case_id string, norm string, mentions int")
    pairs = resolve.similar_pairs(n)
    got = resolve.connected(n.select("case_id", F.col("norm").alias("node")), pairs).collect()
    brute = {(a, b) for a in [r["norm"] for r in n.collect()] for b in [r["norm"] for r in n.collect()] if a != b}
    from difflib import SequenceMatcher

    order = {r["norm"]: r["mentions"] for r in n.collect()}
    expected = {(a, b) for a, b in brute if order[a] > order[b] and SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == expected
    assert len(got) == 5 and len({r["node"] for r in got}) == 5


def test_similar_clusters_without_all_pairs(spark, monkeypatch):
    names = [f"supplier#{i:09d}" for i in range(0, 6000, 60)] + ["ana ruiz", "ana ruis", "eva paz", "luis sol", "luis soler", "luis solera"]
    n = spark.createDataFrame([("c", x, 1) for x in names], "case_id string, norm string, mentions int")
    compared, among = [], resolve.similar_among
    monkeypatch.setattr(resolve, "similar_among", lambda found, **rule: (compared.append(found.count()), among(found, **rule))[1])
    got = {r["node"]: r["component"] for r in resolve.similar_clusters(n).collect()}
    suppliers = {x: names[0] for x in names if x.startswith("supplier")}
    assert got == suppliers | {"ana ruis": "ana ruis", "ana ruiz": "ana ruis", "eva paz": "eva paz", "luis sol": "luis sol", "luis soler": "luis sol", "luis solera": "luis sol"}
    assert sum(compared) < 20 * len(names)  # all pairs: 50 times


def test_clusters_compare_components_not_names(spark, monkeypatch):
    """Numbered names cost less than a comparison each; the clusters are those of all pairs, by either ratio."""
    names = [f"supplier#{i:09d}" for i in (*range(0, 3000), *range(40_000, 41_000), *range(777_000, 777_400))]
    few = [f"supplier#{i:09d}" for i in (5, 17, 40_001, 40_999, 777_123, 123_456_789, 987_654_321)]
    odd = ["ana ruiz", "ana ruis", "eva paz", "luis sol", "luis soler", "luis solera", "a" * 250 + "b" * 9, "a" * 250 + "c" * 9, "ab", "ac", "a", ""]
    compared, among = [], resolve.similar_among
    monkeypatch.setattr(resolve, "similar_among", lambda found, **rule: (compared.append(found.count()), among(found, **rule))[1])
    table = lambda of: spark.createDataFrame([("c", x, 1 + i % 3) for i, x in enumerate(of)], "case_id string, norm string, mentions int")
    got = {r["node"]: r["component"] for r in resolve.similar_clusters(table(names)).collect()}
    assert got == dict.fromkeys(names, names[0]) and sum(compared) < 0.5 * len(names)
    for native in (False, True):
        n = table(few + odd)
        all_pairs = resolve.connected(n.select("case_id", F.col("norm").alias("node")), resolve.similar_pairs(n, native=native))
        assert sorted(map(tuple, resolve.similar_clusters(n, native=native).collect())) == sorted(map(tuple, all_pairs.collect()))


def test_edges_are_not_mirrored(spark):
    e = spark.createDataFrame([("c", "a", "b", "coocurrencia", 3), ("c", "b", "a", "involucrado", 1), ("c", "a", "d", "lugar", 1)], "case_id string, src string, dst string, kind string, n int")
    got = graph.dedup_edges(e).collect()
    assert sorted((r["src"], r["dst"], r["kind"]) for r in got) == [("a", "d", "lugar"), ("b", "a", "involucrado")]


def test_findings_collapse(spark):
    rows = [("c", "inconsistencias", i, "t", s, d, ["P1"], {"file": "f", "chunk": i}) for i, (s, d) in enumerate([("alta", "El  testigo\ndice una cosa distinta"), (None, "el testigo dice una cosa distinta"), ("otra", "Otra descripción del hecho segundo")])]
    f = spark.createDataFrame(rows, "case_id string, category string, seq int, type string, severity string, description string, people array<string>, location struct<file: string, chunk: int>")
    got = findings.with_ids(findings.collapse(f)).orderBy("seq").collect()
    assert [(r["finding_id"], r["repeats"], r["severity"]) for r in got] == [("INC-001", 2, "alta"), ("INC-002", 1, "otra")]
    assert findings.listed(findings.with_ids(findings.collapse(f))).count() == 1


def test_collapsed_findings_list_all_places(spark, tmp_path):
    from casewright.plans import entity_queries

    docs = spark.range(0, 900, 3).select(F.col("id").alias("doc_id"), F.lit("Una  sola\nfrase").alias("text"), F.lit("es").alias("lang"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one = entity_queries.n5_collapse(spark, str(tmp_path)).collect()
    assert [(r["repeats"], r["files"]) for r in one] == [(300, ",".join(f"s{i}" for i in range(0, 900, 3)))]


def test_mixed_people_fields(spark):
    j = '{"testigos": ["Ana Ruiz", {"testigo": "Luis Sol"}], "peritos": 3, "partes": [{"nombre": "Eva Paz", "cargo": "juez"}]}'
    r = spark.createDataFrame([("c", 1, j), ("c", 2, None)], "case_id string, chunk int, j string").select("case_id", "chunk", F.parse_json("j").alias("resultado"))
    got = graph.people_mentions(r).collect()
    assert sorted((x["name"], x["source"], x["role"]) for x in got) == [("Ana Ruiz", "testigo", None), ("Eva Paz", "parte", "juez"), ("Luis Sol", "testigo", None)]


def test_relational_model(spark):
    assert relational.catalogue(spark).filter("is_fk").count() == len(relational.FOREIGN_KEYS)
    child = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert relational.orphans(child, "k", spark.createDataFrame([("a",)], "id string"), "id").first()[0] == 1


def test_nested_values_as_text(spark):
    df = spark.sql("select array(named_struct('f', 'T1.TXT', 'c', 3)) p, named_struct('a', 1, 'b', array('x', 'y'), 'c', cast(null as int)) o, map('k', array(1, 2)) m, array(array(1, 2), array(3)) l")
    got = df.select(relational.flatten_text(df, "p", places=True).alias("p"), *(relational.flatten_text(df, c).alias(c) for c in "oml")).first()
    assert tuple(got) == ("T1 - 3", "a: 1 · b: x, y · c: ", "k: 1, 2", "1 - 2, 3")
    assert df.select(relational.flatten_text(df, "o", most=4)).first()[0] == "a: 1..."


def test_admins_read_all(spark):
    from casewright.operators import cases

    c = spark.createDataFrame([(1, 10), (2, 11)], "case_id int, owner_id int")
    shares = spark.createDataFrame([(2, 10)], "case_id int, user_id int")
    users = spark.createDataFrame([(10, "user"), (12, "admin"), (12, "admin")], "user_id int, role string")
    asked = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (1, 12), (2, 12), (2, 13)], "case_id int, user_id int")
    pairs = cases.accessible(c, shares)
    assert sorted(map(tuple, cases.readable(asked, pairs).collect())) == [(1, 10), (2, 10)]
    assert sorted(map(tuple, cases.readable(asked, pairs, users).collect())) == [(1, 10), (1, 12), (2, 10), (2, 12)]


def test_model_has_the_declared_columns(spark):
    entities = spark.createDataFrame([("c", k, n, 3, ["parte"], ["juez"], [], ["f.txt"], ["1"]) for k, n in (("PERSONA", "Ana Ruiz"), ("PERSONA", "Luis Sol"), ("LUGAR", "Sonora"), ("VEHICULO", "ABC-123"))], "case_id string, kind string, name string, mentions bigint, sources array<string>, roles array<string>, relations array<string>, files array<string>, chunks array<string>")
    found = spark.createDataFrame([("c", "HALLAZGO_001", "t", "alta", "x" * 900, ["Ana Ruiz"], ("g 2019.txt", 7))], "case_id string, finding_id string, type string, severity string, description string, people array<string>, location struct<file: string, chunk: int>")
    facts = spark.createDataFrame([("c", 7, "g"), ("c", 7, "a")], "case_id string, chunk int, file string")
    edges = spark.createDataFrame([("c", "HALLAZGO_001", "Ana Ruiz", "involucrado", 1, None), ("c", "Ana Ruiz", "HECHO_7", "victima", 1, "hija"), ("c", "Ana Ruiz", "Luis Sol", "juridica", 2, "juez"), ("c", "Ana Ruiz", "Sonora", "lugar_debil", 2, None)], "case_id string, src string, dst string, kind string, n bigint, label string")
    t = relational.model(entities, found, facts, edges)
    assert set(t) == set(relational.TABLES) and all(t[n].columns == ["case_id", *relational.schema(n).names] for n in t)
    assert t["hallazgo"].first()["descripcion"] == "x" * 500 and t["hecho"].first()["archivo"] == "a"
    assert tuple(t["rel_involucrado"].first())[2:] == ("PERSONA_Ana_Ruiz", "HALLAZGO_001") and t["rel_victima"].first()["tipo_relacion"] == "hija"
    assert {r["n_orphans"] for r in relational.integrity(t).collect()} == {0} and relational.integrity(t).count() == 12
    assert t["expediente"].filter("anio = '2019'").count() == 1 and t["persona"].first()["tipo_rol"] == "juez"


def test_edges_pair_top_entities_alone(spark, monkeypatch):
    from casewright.plans import entity_queries

    seen, co_occurrence = [], graph.co_occurrence
    monkeypatch.setattr(graph, "co_occurrence", lambda members, *kinds, **more: (seen.append((kinds, members)), co_occurrence(members, *kinds, **more))[1])
    monkeypatch.setattr(entity_queries, "LIMITS", {"PERSONA": 2, "VEHICULO": 3, "LUGAR": 1})
    top = entity_queries._whole(spark, "/root/testdata/sf0.001")["top"].select("case_id", "kind", "name")
    assert [k for k, _ in seen[1:]] == [("PERSONA", "PERSONA"), ("PERSONA", "LUGAR"), ("PERSONA", "VEHICULO")]
    assert seen[1][1].select("case_id", "kind", "name").distinct().exceptAll(top).isEmpty() and seen[1][1].count() > 0


def test_leading_people_are_those_of_all_scores(spark, monkeypatch):
    """The same first people as by all scores, where bounds hold and where they are loose, with pairs of few chunks."""
    import random

    rng, rows = random.Random(7), []
    for chunk in range(900):  # case c: far more people than shown; d: twelve who meet again and again, with fewer points than others
        rows += [("c", chunk, f"p{rng.randrange(600)}", rng.choice("RA"), rng.choice(["x", "y", None])) for _ in range(4)]
    for chunk in range(200):
        rows += [("d", chunk, f"h{i}", "A", None) for i in range(12)] if chunk < 40 else [("d", chunk, f"q{i}", "A", None) for i in rng.sample(range(200), 11)]
    rows += [("e", 1, "a", "R", "x"), ("e", 1, "b", "A", None), (None, 1, "a", "R", "x"), ("c", 5, None, "R", "x")]
    m = spark.createDataFrame(rows, "case_id string, chunk int, name string, source string, role string").withColumn("kind", F.lit("PERSONA")).withColumn("file", F.lit("f"))
    entities, involved = graph.entity_aggregates(m, chunks=False), m.filter("source = 'R'").select("case_id", "name")
    all_scores = graph.scores(entities, graph.co_occurrence(graph.chunk_members(m), "PERSONA", "PERSONA"), involved)
    shown = lambda df: sorted((str(r["case_id"]), r["rank"], str(r["name"]), r["score"]) for r in graph.top_entities(df, {"PERSONA": 5}).collect())
    seen, co_occurrence = [], graph.co_occurrence
    monkeypatch.setattr(graph, "co_occurrence", lambda members, *kinds: (seen.append(members.count()), co_occurrence(members, *kinds))[1])
    assert shown(graph.leading(entities, m, involved, kind="PERSONA", keep=5)) == shown(all_scores)
    assert len(seen) == 2 and seen[0] < 0.5 * len(rows)
    assert graph.leading(entities.limit(0), m.limit(0), involved, kind="PERSONA", keep=5).count() == 0


def test_findings_and_counts_without_pairs(spark, monkeypatch):
    """What shows no edges forms no edges, and findings need no people's scores."""
    from casewright.plans import entity_queries

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(graph, "dedup_edges", None)
    groups = {(r["case_id"], r["group"]): r["n"] for r in entity_queries.g22_group_counts(spark, sf).collect()}
    assert groups["5-LOW", "persona"] == 10 and groups["5-LOW", "vehiculo"] == 30
    monkeypatch.setattr(graph, "pairs_within", None)
    assert entity_queries.r5_hallazgo(spark, sf).count() == sum(n for (_, g), n in groups.items() if g == "hallazgo")


def test_summaries_count_the_whole_graph(spark):
    """c12 counts nodes of every group, with the parts of the graph that it asks for by name."""
    from casewright.plans import entity_queries

    sf = "/root/testdata/sf0.001"
    groups = {}
    for r in entity_queries.g22_group_counts(spark, sf).collect():
        groups.setdefault(r["case_id"], {})[r["group"]] = r["n"]
    got = {r["case_id"]: (r["n_nodes"], r["groups"]) for r in entity_queries.c12_summary_statistics(spark, sf).collect()}
    assert got == {c: (sum(g.values()), ",".join(f"{k}={g[k]}" for k in sorted(g))) for c, g in groups.items()}
