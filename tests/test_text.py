import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.operators import extract, text
from casewright.sources import corpus


@given(st.text(alphabet="ab\n", max_size=300), st.integers(20, 60))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(t, size):
    cut = list(text.chunk_bounds(t, size, 5, 10))
    assert (not t and not cut) or (cut[0][0] == 0 and cut[-1][1] == len(t))
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert a < c <= b < d and b - c == 5 and d - c <= size


@pytest.mark.parametrize("t,starts", [("x" * 2500, [0, 900, 1800]), ("", []), ("é" * 10, [0])])
def test_chunk_starts(spark, t, starts):
    df = spark.createDataFrame([(1, t)], "doc_id int, text string")
    assert [r["start"] for r in text.chunk_text(df, size=1000, overlap=100, window=100).orderBy("start").collect()] == starts


def test_chunk_snaps_to_a_blank_line():
    t = "a" * 948 + "\n\n" + "b" * 500
    assert next(text.chunk_bounds(t, 1000, 100, 100)) == (0, 950)
    assert next(text.chunk_bounds(t, 1000, 100, 20)) == (0, 1000)
    with pytest.raises(ValueError):
        text.chunk_text(None, size=100, overlap=60, window=50)


def test_pages_round_trip(spark):
    p = spark.createDataFrame([(1, 2, "dos\n\nx"), (1, 1, "uno"), (1, 3, " \n"), (2, 1, "z")], "doc_id int, page_no int, text string")
    back = corpus.explode_pages(corpus.assemble_pages(p)).orderBy("doc_id", "page_no").collect()
    assert [tuple(r) for r in back] == [(1, 1, "uno"), (1, 2, "dos\n\nx"), (2, 1, "z")]


def test_responses(spark):
    rows = [("```json\n{\"a\": 1}\n```",), ("text {\"a\": 1} tail",), ("{\"a\": 1, \"b\": [\"x",), ("none",), (None,)]
    got = text.parse_responses(spark.createDataFrame(rows, "response string")).select(F.try_variant_get("parsed", "$.a", "int").alias("a")).collect()
    assert sorted(str(r["a"]) for r in got) == ["1", "1", "1", "None", "None"]


CASE = """El Cabo Juan Pérez Mendoza vio el vehículo con placas VFK-1234.
Teniente Carlos Ramírez llegó. HUGO ALBERTO PARRA CHAIDEZ huyó con placas ABC-9876.
Cabo Juan Pérez declaró."""


def test_alias_round_trip(spark):
    docs = spark.createDataFrame([("c", "f.txt", 1, CASE), ("c", "g.txt", 2, "sin nombres"), ("c", "h.txt", 3, None)], "case_id string, file string, doc_id int, text string")
    found = extract.document_frequency(extract.mentions(docs))
    n = {(r["kind"], r["name"]): r["freq"] for r in found.collect()}
    assert n["VEHICULO", "VFK-1234"] == 2 and n["VEHICULO", "ABC-9876"] == 2 and ("PERSONA", "Juan Pérez Mendoza") in n
    aliases = extract.assign_aliases(extract.global_frequency(found))
    hidden = extract.pseudonymize(docs, aliases)
    text_of = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert "Juan" not in text_of[1] and "VFK" not in text_of[1] and text_of[2] == "sin nombres" and text_of[3] is None
    back = {r["doc_id"]: r["text"] for r in extract.restore(hidden, aliases).collect()}
    assert back[1].lower() == CASE.lower()


def test_alias_numbers_grow(spark):
    names = spark.range(1005).select(F.lit("c").alias("case_id"), F.lit("PERSONA").alias("kind"), F.format_string("N%05d", "id").alias("name"), F.lit(1).alias("mentions"), F.array(F.lit("f")).alias("files"))
    top = extract.assign_aliases(names).agg(F.max_by("alias", "real_name")).first()[0]
    assert top == "PERSONA_1005"


def test_enrich_survives_errors(spark):
    def call(r):
        return {"a": "1"}[r]

    got = {r["request"]: (r["result"], r["error"]) for r in text.enrich(spark.createDataFrame([("a",), ("b",)], "request string"), call).collect()}
    assert got["a"] == ("1", None) and got["b"][1] == "KeyError: 'b'"


def test_aliases_of_cases_stay_apart(spark):
    rows = [("c", "f", i, f"Ana Ruiz y JUAN SOL {i}") for i in range(30)] + [("d", "f", 99, "ana ruiz"), (None, "f", 100, "Ana Ruiz"), ("e", "f", 101, None), ("c", "f", 5, "Ana Ruiz y JUAN SOL 5")]
    docs = spark.createDataFrame(rows, "case_id string, file string, doc_id int, text string").withColumn("_salt", F.lit(1))
    aliases = spark.createDataFrame([("c", "PERSONA", "PERSONA_001", "Ana Ruiz"), ("c", "PERSONA", "PERSONA_002", "Juan Sol"), ("d", "PERSONA", "PERSONA_001", "Ana Ruiz")], "case_id string, kind string, alias string, real_name string")
    hidden = extract.pseudonymize(docs, aliases, group_chars=100)  # several groups a case
    got = sorted((r["case_id"] or "", r["doc_id"], r["text"]) for r in hidden.collect())
    assert got == sorted([("c", i, f"PERSONA_001 y PERSONA_002 {i}") for i in [*range(30), 5]] + [("d", 99, "PERSONA_001"), ("", 100, "Ana Ruiz"), ("e", 101, None)])
    assert hidden.columns == docs.columns
    back = {r["doc_id"]: r["text"] for r in extract.restore(hidden, aliases, group_chars=100).collect()}
    assert back[7] == "Ana Ruiz y Juan Sol 7" and back[99] == "Ana Ruiz" and back[101] is None


def test_chunks_keep_every_column(spark):
    df = spark.createDataFrame([(1, "x" * 25, ["a"], None), (2, None, ["b"], 3), (3, "", [], 4)], "doc_id int, text string, tags array<string>, n int")
    got = text.chunk_text(df, size=12, overlap=2, window=3).orderBy("chunk_no").collect()
    assert [(r["doc_id"], r["tags"], r["n"], r["start"], r["end"], r["size"]) for r in got] == [(1, ["a"], None, 0, 12, 12), (1, ["a"], None, 10, 22, 12), (1, ["a"], None, 20, 25, 5)]


def combined(table):
    """One pattern of all names, the longest first, as plain Python has it."""
    import re

    low = {}
    for name, alias in table:
        low[name.lower()] = alias
    pattern = re.compile("|".join(rf"\b{re.escape(n)}\b" for n, _ in sorted(table, key=lambda x: -len(x[0]))), re.IGNORECASE)
    return lambda text: pattern.sub(lambda m: low.get(m.group().lower(), m.group()), text)


def test_names_are_replaced_at_every_boundary(spark):
    rng = random.Random(4)
    words = ["juan", "Pérez", "ABC", "1234", "mendoza", "ñu", "de", "_x", "O'Neil"]
    glue = [" ", "  ", ",", ":", "/", "-", "'", ".", ";", "(", ")", "\n", "¿", "", "_"]
    some = lambda n: "".join(rng.choice(words) + rng.choice(glue) for _ in range(n))
    for _ in range(300):
        names = list({n.strip(" \n"): 0 for n in ["juan pérez", "ABC-1234", *(some(rng.randint(1, 4)) for _ in range(6))]})
        table = [(n, f"PERSONA_{i:03d}") for i, n in enumerate(names) if n]
        text = some(40)
        text = "".join(rng.choice((c.lower(), c.upper(), c)) for c in text)
        assert extract.Replacer({n.lower(): a for n, a in table})(text) == combined(table)(text), (table, text)
    table = [("juan pérez", "PERSONA_001"), ("ABC-1234", "VEHICULO_001"), ("(zona)", "PERSONA_004"), ("Ana Luz", "PERSONA_999"), ("ANA LUZ", "PERSONA_1000"), ("solo", "PERSONA_005"), ("", "PERSONA_006")]
    aliases = spark.createDataFrame([("c", a.split("_")[0], a, n) for n, a in table] + [(None, "PERSONA", "PERSONA_001", "Ana Luz")], "case_id string, kind string, alias string, real_name string")
    texts = ["Mendoza,Juan Pérez", "nombre:Juan Pérez", "acusado/JUAN PÉREZ", "auto-ABC-1234", "ab(zona)x ana luz SOLO", None, "", "Juan\nPérez"]
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)] + [("d", 90, "Juan Pérez"), (None, 91, "ana luz")], "case_id string, doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in extract.pseudonymize(docs, aliases, group_chars=20).collect()}
    assert got == {0: "Mendoza,PERSONA_001", 1: "nombre:PERSONA_001", 2: "acusado/PERSONA_001", 3: "auto-VEHICULO_001", 4: "abPERSONA_004x PERSONA_1000 PERSONA_005", 5: None, 6: "", 7: "Juan\nPérez", 90: "Juan Pérez", 91: "PERSONA_001"}
    back = extract.restore(spark.createDataFrame([("c", 1, "PERSONA_1000 y PERSONA_100, PERSONA_001")], docs.schema), aliases).collect()
    assert back[0]["text"] == "ANA LUZ y PERSONA_100, juan pérez"
    assert extract.pseudonymize(docs, aliases.limit(0)).count() == 10 and extract.pseudonymize(docs.limit(0), aliases).count() == 0


def test_words_and_pairs_of_texts():
    numbers = lambda names: set(extract.name_keys(names)[0].tolist())
    every = set(extract.text_keys(["uno dos, Tres", None, "", "cuatro"], lambda h: h == h).tolist())
    assert numbers(["dos tres", "uno", "cuatro", "dos-tres x", "", "()"]) <= every and not numbers(["tres cuatro", "uno tres", "cinco"]) & every
    first = extract.name_keys(["dos"])[1]
    some = set(extract.text_keys(["uno dos, Tres", "dos"], lambda h: np.isin(h, first)).tolist())
    assert some == numbers(["dos tres", "dos", ""])
    assert set(extract.text_keys([], lambda h: h == h).tolist()) == numbers([""])
