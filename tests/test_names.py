"""Golden rows of the validity rules, and the native rules against a plain restatement."""

from pyspark.sql import functions as F

from casewright.functions import names

# Names and the verdicts that the rules must give.
PEOPLE = [
    ("David Zepeda", 560, True), ("Del\nMinisterio Público", 2, False), ("Décimo Primero", 2, False), ("Colectiva No", 16, False), ("General Adjunto", 16, False),
    ("Cuarto Especializado", 12, False), ("Pública Federal", 15, False), ("Fabiola Padilla Cruz", 105, True), ("Fabiola Padilla Cruz\nAgente", 11, True),
    ("Manuel Angel Barrios\nMacario", 33, True), ("Antonio Pérez García", 260, True), ("Padilla Cruz Fabiola", 0, True), ("Maria", 1, False), ("Carla Bermudez", 38, True),
    ("", 5, False), (None, 5, False), ("Ana Ruiz", 2, False), ("12", 9, False),
]
VEHICLES = [("VXR-024", True), ("SHA256", False), ("AXL-309", True), ("Chevrolet", False), ("CHEVROLET", False), ("negro", False), ("oro", False), ("pick up", False), ("Suburban", False), ("TOYOTA", False), ("DAA1362", True), ("zoa", False), ("Nissan", False), ("AXL-1119", True), ("auto sin placas", False)]


def test_people(spark):
    df = spark.createDataFrame(PEOPLE, "name string, mentions int, expected boolean")
    bad = df.withColumn("v", names.person_validity(F.col("name"), F.col("mentions"))).filter("v.valid <> expected").collect()
    assert bad == []


def test_vehicles(spark):
    df = spark.createDataFrame(VEHICLES, "name string, expected boolean")
    assert df.withColumn("v", names.vehicle_validity(F.col("name"))).filter("v.valid <> expected").collect() == []


def test_exact_accents(spark):
    import unicodedata

    rows = [("  Ýmir  Őszi ",), ("José\tÑandú",), ("Şule Y\u0301",), ("",), (None,), ("plain",)]
    got = spark.createDataFrame(rows, "n string").select("n", names.normalize_name_exact(F.col("n")).alias("x")).collect()
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", " ".join(t.split())) if unicodedata.category(c) != "Mn").lower()
    assert [r["x"] for r in got] == [None if n is None else plain(n) for (n,) in rows]


def test_weak_and_slug(spark):
    rows = [("corto", True), (None, True), ("No se proporciona información del hecho en esta hoja", True), ("El testigo declara haber visto dos vehículos esa noche", False)]
    df = spark.createDataFrame(rows, "d string, expected boolean")
    assert df.filter(names.weak_finding(F.col("d")) != F.col("expected")).collect() == []
    assert spark.range(1).select(names.slug(F.lit("  Ana  Ruiz (x) ")).alias("s"), names.slug(F.lit("??")).alias("t")).first() == ("Ana_Ruiz_x", "anon")


def test_jaccard_pairs_share_any_word(spark):
    import random

    from casewright.operators import resolve

    rng = random.Random(3)
    names = ["red bolt", "blue bolt", "bolt", "a a b", "", None, "big red bolt of the old mill house gate x y"]
    names += [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 10))) for _ in range(120)]
    sets = {n: set(n.split(" ")) for n in names if n is not None}
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 3}
    got = [tuple(r) for r in resolve.jaccard_pairs(spark.createDataFrame([(n,) for n in names], "norm string")).collect()]
    assert ("blue bolt", "red bolt") in expected and set(got) == expected and len(got) == len(expected)
