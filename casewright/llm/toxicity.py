"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded: lower case, homoglyphs and digit substitutions to plain letters, zero-width marks dropped, anything
else than a letter to one space. The lexicon holds whole words and word beginnings with the log odds of the documents
that have them; exception phrases (two words of which one is in the lexicon) that labelled clean documents use cancel
the match inside them. The score is a logistic function of the matched weight normalised by length and of its log.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm.shared import stage_table

# Characters that look like a Latin letter, and the letter.
HOMOGLYPHS = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ё": "e", "ε": "e",
    "һ": "h", "і": "i", "ı": "i", "ι": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "η": "n",
    "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u",
    "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
}
# Digits and signs that stand for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

STEMS = range(4, 9)
MOST_TERMS = 4000
MOST_PHRASES = 4000


_WIDE = {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: str(i) for i in range(10)}
_UNSEEN = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
_LOOKS = {ord(k): v for k, v in HOMOGLYPHS.items()} | _WIDE | _UNSEEN
_SIGNS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[0-9@$!|€]*[^\W\d_][0-9@$!|€]+[^\W\d_](?:[^\W\d_]|[0-9@$!|€]+(?=[^\W\d_]))*|[0-9@$|€][^\W\d_]+(?:[0-9@$!|€]+[^\W\d_]+)*")
_GAPS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded text: words of letters with one space before, between and after them; null as empty.

    A substitute stands for a letter only in a run with letters (`1d10t`, `p@thetic`); other figures and signs, as in
    2.0 or `why!`, fold to spaces.
    """
    low = (text or "").lower()
    if not low.isascii():
        low = low.translate(_LOOKS)
    if any(c in low for c in SUBSTITUTES):
        low = _MIXED.sub(lambda m: m.group().translate(_SIGNS), low)
    return f" {_GAPS.sub(' ', low).strip()} "


def folded(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., _f): the folded texts."""
    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array([fold(t.as_py()) for t in b.column(text)], pa.string())], names=[*(f.name for f in fields), "_f"])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField("_f", T.StringType())]))


@dataclass(frozen=True)
class Lexicon:
    """terms: ` word ` or ` begin` to weight; phrases: exceptions; bias and the weights of density and log weight."""

    terms: dict[str, float]
    phrases: tuple[str, ...]
    bias: float
    density: float
    amount: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for p in self.phrases:
            a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def features(automaton, folded: str) -> tuple[float, float]:
        """Matched weight a hundred words, and log(1 + matched weight); a term inside an exception phrase is no match.

        Matches at one word start count once, by the largest weight.
        """
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if len(automaton):
            for end, (size, w) in automaton.iter(folded):
                start = end - size + 1
                if w is None:
                    excused.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        for a, b in excused:
            for k in [k for k in best if a <= k < b]:
                del best[k]
        total = sum(best.values())
        words = max(1, folded.count(" ") - 1)
        return 100 * total / (words + 20), math.log1p(total)

    def score(self, density: np.ndarray, amount: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.density * density + self.amount * amount, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression (bias, weights >= 0) by projected gradient with a small ridge."""
    scale = x.std(0) + 1e-9
    z = np.concatenate([np.ones((len(x), 1)), x / scale], 1)
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= 2.0 * (z.T @ (p - y) / len(y) + 1e-4 * w * (np.arange(len(w)) > 0))
        w[1:] = np.maximum(w[1:], 0.01)
    return np.concatenate([w[:1], w[1:] / scale])


LABELLED = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED) -> DataFrame:
    """(text, label) of at most `most` labelled documents, chosen by a hash of the key, written once.

    `most` bounds the side that is broadcast, so no text is shuffled to meet its label. Null labels and keys are left
    out; of repeated labels of a key the largest counts.
    """
    one = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    few = one.orderBy(F.xxhash64(key), key).limit(most)
    return stage_table(docs.select(key, text).join(F.broadcast(few), key).select(text, label), "labelled")


def learn(rows: DataFrame, *, text: str = "text", label: str = "toxic", least: int = 8, sample: int = 4000) -> Lexicon:
    """The lexicon from labelled rows (text, label 0/1; null labels are left out).

    Words are counted over all rows. The driver gets at most MOST_TERMS terms, MOST_PHRASES phrases, and features of at
    most `sample` rows for the logistic function. No rows or no toxic ones: an empty lexicon, score near the rate.
    """
    known = rows.filter(F.col(label).isNotNull()).select(F.col(text).alias("_t"), (F.col(label) > 0).cast("long").alias("_y"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    rate = (toxic + 0.5) / (n + 1)
    if not toxic or toxic == n:
        return Lexicon({}, (), math.log(rate / (1 - rate)), 0.0, 0.0)
    texts = folded(known, "_t", ["_y"])
    words = texts.select("_y", F.explode(F.array_distinct(F.split(F.trim("_f"), " "))).alias("w")).filter("w <> ''")
    words = words.groupBy("w").agg(F.sum("_y").alias("t"), F.count("*").alias("n"))
    entries = [F.concat(F.lit(" "), F.col("w"), F.lit(" ")), *(F.when(F.length("w") > k, F.concat(F.lit(" "), F.substring("w", 1, k))) for k in STEMS)]
    terms = words.select("t", "n", F.explode(F.array(*entries)).alias("term")).filter("term is not null").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - toxic + 1))
    apart = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    strong = terms.filter((F.col("t") >= least) & (F.col("t") >= 0.7 * F.col("n"))).withColumn("odds", odds).withColumn("z", apart).filter("z > 4")
    top = strong.orderBy(F.desc("z"), "term").limit(MOST_TERMS).collect()
    chosen = _shortest([(r["term"], int(r["t"]), int(r["n"]), float(r["odds"])) for r in top])
    phrases = _exceptions(texts, chosen)
    bare = Lexicon(chosen, phrases, 0.0, 0.0, 0.0)
    part = known.orderBy(F.xxhash64("_t"), "_y").limit(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = bare.automaton()
        for b in batches:
            got = [Lexicon.features(auto, fold(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_pydict({"y": b.column(1), "d": pa.array([g[0] for g in got], pa.float64()), "a": pa.array([g[1] for g in got], pa.float64())})

    seen = np.array([tuple(r) for r in part.mapInArrow(measure, "y bigint, d double, a double").collect()])
    w = _fit(seen[:, 1:], seen[:, 0])
    return Lexicon(chosen, phrases, float(w[0]), float(w[1]), float(w[2]))


def _shortest(strong: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Weights of the terms (term, toxic, all, weight) that no other begins: of beginnings that the same documents bear
    out (equal counts), the longest, which says no more than was seen; else the shortest."""
    chosen: dict[str, tuple[int, int, float]] = {}
    for term, t, n, weight in sorted(strong, key=lambda x: (len(x[0]), x[0])):
        begin = next((term[:k] for k in range(2, len(term)) if term[:k] in chosen), None)
        if begin is None:
            chosen[term] = (t, n, weight)
        elif chosen[begin][:2] == (t, n) and not term.endswith(" "):
            del chosen[begin]
            chosen[term] = (t, n, weight)
    return {term: weight for term, (_, _, weight) in chosen.items()}


def _exceptions(texts: DataFrame, terms: dict[str, float], least: int = 3) -> tuple[str, ...]:
    """` word word ` phrases with a term in them that clean documents use at least `least` times, toxic ones less."""
    if not terms:
        return ()
    whole = {t[1:-1] for t in terms if t.endswith(" ")}
    begins = tuple(t[1:] for t in terms if not t.endswith(" "))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, p = [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = text.split()
                hit = [i for i, x in enumerate(w) if x in whole or x.startswith(begins)]
                got = {f"{w[i]} {w[i + 1]}" for h in hit for i in (h - 1, h) if 0 <= i < len(w) - 1}
                y += [label] * len(got)
                p += got
            yield pa.RecordBatch.from_pydict({"_y": pa.array(y, pa.int64()), "p": pa.array(p, pa.string())})

    found = texts.select("_y", "_f").mapInArrow(near, "_y bigint, p string")
    counted = found.groupBy("p").agg(F.sum("_y").alias("t"), F.count("*").alias("n"))
    clean = counted.filter(f"n - t >= {least} and n - t > 4 * t").orderBy(F.desc(F.col("n") - F.col("t")), "p").limit(MOST_PHRASES)
    return tuple(sorted(f" {r['p']} " for r in clean.select("p").collect()))


def rate(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the toxicity score (0 to 1) of the whole text; a null or empty text scores as one without a match.

    Other columns pass through and repeated rows stay.
    """
    kept = [f for f in docs.schema.fields if f.name != score]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by MOST_TERMS and MOST_PHRASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        auto = lex.automaton()
        for batch in batches:
            got = np.array([Lexicon.features(auto, fold(t.as_py())) for t in batch.column(text)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(lex.score(got[:, 0], got[:, 1]))], names=[*(f.name for f in kept), score])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(score, T.DoubleType())]))
