"""Language ID, toxicity and personal data: held-out accuracy and exact base spans."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from casewright.llm import language_id, pii, toxicity

RNG = random.Random(8)
SYLLABLES = {"aa": ["the", "ing", "wh", "ea", "th"], "bb": ["ción", "ado", "ll", "que", "ñ"], "cc": ["sch", "ein", "ung", "ü", "ver"]}


def text_of(lang, n=40):
    return " ".join("".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randint(1, 3))) for _ in range(n))


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    f = np.float64
    net = language_id.Network(rng.normal(0, 0.3, (2, 9, 257)).astype(f), rng.normal(0, 0.3, (2, 9, 3)).astype(f), rng.normal(0, 0.3, (2, 6)).astype(f), np.zeros((2, 1), f))
    x, y = rng.integers(97, 103, (6, 4)), np.array([0, 1, 1, 0])
    x[-2:, 0] = language_id.PAD

    def loss():
        total = 0.0
        a, b = net.states(x, 0), net.states(x, 1)
        for t in range(len(x)):
            z = net.out @ np.concatenate([a[t], b[t]]) + net.bias
            p = np.exp(z - z.max(0))
            total -= (np.log(p / p.sum(0))[y, np.arange(4)] * (x[t] != language_id.PAD)).sum()
        return total / (x != language_id.PAD).sum()

    grads = language_id._gradients(net, x, y)
    for p, g in zip([net.embed, net.recur, net.out, net.bias], grads):
        for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g).ravel())[:4]]:
            was = p[at]
            p[at] = was + 1e-3
            up = loss()
            p[at] = was - 1e-3
            down = loss()
            p[at] = was
            assert abs((up - down) / 2e-3 - g[at]) < 0.03 * abs(g[at]) + 1e-3


def test_language_id_held_out(spark):
    rows = [(i, text_of(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.learn(df.filter("doc_id < 120"))
    odd = spark.createDataFrame([(500, None, None, ""), (501, "123 !", None, ""), (502, "", None, ""), (503, text_of("bb", 9000), None, "")], df.schema)
    got = language_id.identify(df.filter("doc_id >= 120").union(odd).union(odd), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["doc_id"] < 500]) > 0.95
    special = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 500}
    assert special[500] == special[501] == special[502] == ("und", 0.0) and special[503][0] == "bb" and 0.5 < special[503][1] <= 1
    assert language_id.learn(df.limit(0)) == ([], None)
    assert language_id.identify(df.limit(2), ([], None)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_windows_cover_all_bytes():
    texts = [b"", b"a" * 64, b"b" * 65, b"c"]
    x, owner = language_id.windows(texts)
    assert owner.tolist() == [1, 2, 2, 3] and (x != language_id.PAD).sum() == sum(map(len, texts))


def test_fold():
    assert toxicity.fold("You 1D10T, p@thetic 2.0! why! mоrоn sc​um") == " you idiot pathetic why moron scum "
    assert toxicity.fold(None) == "  "


def test_toxicity_held_out(spark):
    clean = ["casa", "perro", "luna", "mesa", "libro", "agua"]

    def doc(i):
        w = [RNG.choice(clean) for _ in range(RNG.randint(10, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(RNG.randrange(len(w)), RNG.choice(["zafio", "Z4FIO", "grunt" + RNG.choice(["ix", "ox"])]))
        elif i % 15 == 1:
            w += ["zafio", "permitido"]
        return (i, " ".join(w), int(bad))

    df = spark.createDataFrame([doc(i) for i in range(400)], "doc_id int, text string, toxic int").withColumn("score", F.lit("clash"))
    lex = toxicity.learn(df.filter("doc_id < 300").union(df.limit(1).withColumn("toxic", F.lit(None).cast("int"))))
    assert any("zafio permitido" in p for p in lex.phrases) and any(t.startswith(" grunt") for t in lex.terms)
    odd = spark.createDataFrame([(900, None, 0, ""), (901, "", 0, ""), (902, "luna " * 5000 + "zafio " * 400, 1, "")], df.schema)
    got = toxicity.rate(df.filter("doc_id >= 300").union(odd), lex).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.learn(df.limit(0))
    assert none.terms == {} and toxicity.rate(df.limit(3), none).count() == 3


def test_lexicon_matches_are_those_of_a_naive_search():
    lex = toxicity.Lexicon({" ab ": 2.0, " ab": 1.0, " abc": 1.5, " cd ": 3.0}, (" ab cd ", " x cd "), 0.0, 1.0, 1.0)
    auto = lex.automaton()
    for _ in range(500):
        text = toxicity.fold(" ".join(RNG.choice(["ab", "abc", "abd", "cd", "x", "cde"]) for _ in range(RNG.randint(0, 12))))
        best = {}
        for t, w in lex.terms.items():
            for a in range(len(text)):
                if text.startswith(t, a):
                    best[a] = max(best.get(a, 0.0), w)
        for p in lex.phrases:
            for a in range(len(text)):
                if text.startswith(p, a):
                    best = {k: w for k, w in best.items() if not a <= k < a + len(p) - 1}
        total = sum(best.values())
        assert np.allclose(toxicity.Lexicon.features(auto, text), (100 * total / (max(1, len(text.split())) + 20), np.log1p(total)))


def test_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    net = language_id.Network(rng.normal(0, 0.4, (2, 9, 257)).astype("f4"), rng.normal(0, 0.4, (2, 9, 3)).astype("f4"), rng.normal(0, 0.4, (2, 6)).astype("f4"), rng.normal(0, 1, (2, 1)).astype("f4"))
    hard = lambda x: np.clip(x + 0.5, 0, 1)

    def states(window, side):
        h, out = np.zeros(3), {}
        for t in range(len(window)) if side == 0 else range(len(window) - 1, -1, -1):
            a, b = net.embed[side][:, window[t]].astype(float), net.recur[side].astype(float) @ h
            r, z = hard(a[:3] + b[:3]), hard(a[3:6] + b[3:6])
            h = z * h + (1 - z) * np.tanh(a[6:] + r * b[6:])
            out[t] = h
        return out

    def plain(text):
        total = np.zeros(2)
        for s in range(0, len(text), language_id.WINDOW):
            w = list(text[s : s + language_id.WINDOW])
            w += [language_id.PAD] * (language_id.WINDOW - len(w))
            f, b = states(w, 0), states(w, 1)
            for t in range(min(language_id.WINDOW, len(text) - s)):
                y = np.exp(net.out.astype(float) @ np.concatenate([f[t], b[t]]) + net.bias[:, 0])
                total += y / y.sum()
        return total / max(1, len(text))

    texts = [b"", b"hola", bytes(rng.integers(0, 256, 64).tolist()), bytes(rng.integers(0, 256, 150).tolist())]
    assert np.allclose(net.predict(texts), [plain(t) for t in texts], atol=1e-5)


def test_identify_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "hola", "x", 7), (1, "hola", "x", 7)], "doc_id int, text string, _letters string, _label int")
    got = language_id.identify(df, ([], None))
    assert [tuple(r) for r in got.collect()] == [(1, "hola", "x", 7, "und", 0.0)] * 2 and got.columns == [*df.columns, "lang_pred", "score"]


def reference(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return out


def test_base_spans_are_exact():
    for _ in range(8000):
        t = "".join(RNG.choice("ab.@@-+0123456789  ()_é\n") for _ in range(RNG.randint(0, 60)))
        assert pii.base_spans(t) == reference(t), t
    pii.base_spans("1" * 100_000 + "a@" * 50_000 + "1.2." * 50_000)


def test_field_adds_spans_and_keeps_base(spark):
    text = "llama +1 (269) 555-3296 4524132264652876 y a@b.example.com"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "token = \"be8a8e7152a5c568b612\" version 2.0, 1999")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("base", F.lit("clash"))
    weights = pii.learn(df)
    got = {r["doc_id"]: r for r in pii.find(df, weights).collect()}
    spans = {(s["kind"], text[s["start"] : s["end"]]) for s in got[1]["spans"]}
    assert {("phone", "+1 (269) 555-3296"), ("card", "4524132264652876"), ("email", "a@b.example.com")} == spans
    assert [tuple(s) for s in got[1]["base"]] == reference(text) and got[2]["spans"] == got[3]["spans"] == got[4]["spans"] == []
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df, weights).collect()}
    assert masked[1] == "llama <phone> <card> y <email>" and masked[2] is None
    assert pii.find(df.limit(0), pii.learn(df.limit(0))).count() == 0


def test_field_on_unseen_sentences():
    field = pii.fit(pii.rewritten(seed=5, each=25))
    fresh = pii.rewritten(seed=99, each=10)
    assert np.mean([field.best(t, 0, len(t)) == s for t, s in fresh]) > 0.95


def test_long_dense_text_is_one_region():
    field = pii.fit(pii.rewritten(seed=5, each=25))
    phones = [f"call {RNG.randint(200, 999)}-{RNG.randint(200, 999)}-{RNG.randint(1000, 9999)}" for _ in range(120)]
    text = "\n".join(phones)
    assert len(text) > 2000 and pii.regions(text) == [(0, len(text))]
    base, spans = pii.all_spans(text, field)
    assert not base and spans == field.best(text, 0, len(text))
    assert [text[a:b] for k, a, b in spans if k == "phone"] == [p[5:] for p in phones]


def test_regions_end_at_white_space():
    text = "so " + "averyveryveryverylonglocalpart at averyveryverylonghost dot com" + " and on" + " word" * 40 + " 12"
    (a, b), last = pii.regions(text)
    assert a == 3 or text[a - 1].isspace() and a < 3
    assert text[b : b + 1].isspace() and b >= text.index(" dot") and last[1] == len(text)
