"""Personal data: base patterns, and a semi-Markov conditional random field for spans they miss.

Base spans follow four fixed patterns. The field reads regions around figures and at-signs as short tokens, scores every
candidate segment of up to MAX_TOKENS tokens by features of the whole span (digit counts, group shapes, checksums, cue
words before it), and a dynamic program over these bounded segments chooses boundaries and kinds together. It is fitted
by gradient ascent of the likelihood on a bounded sample of regions whose base spans are the truth, and on the same
spans rewritten the ways people write them (a phone number without its plus after a cue, `name at host dot com`,
dotted card groups, defanged addresses).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 9
#: No segment is longer.
MAX_CHARS = 80
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches found from their at-signs, so that a long run of letters costs no second look."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
            free = max(free, 0)
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the four base patterns, by kind and start; failing matches are dropped without a retry."""
    out = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (g.lstrip("0") for g in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_SEED = re.compile(r"[0-9@]|\(at\)|\[at\]|\bat\b(?=\s+[\w-]+\s+dot\b)")
_CUES = {
    "email": {"email", "mail", "e", "contact", "write", "correo", "courriel"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "telefono", "teléfono", "téléphone"},
    "card": {"card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte", "kreditkarte"},
    "ip": {"ip", "address", "host", "server", "addr"},
}


def regions(text: str, reach: int = 20, most: float = math.inf) -> list[tuple[int, int]]:
    """Stretches around figures, at-signs and their spelled-out forms, as long as the text is dense with them.

    Edges move out to white space, as far as a segment may reach. Only learn() sets `most`, to cut its examples short.
    """
    out: list[list[int]] = []
    for m in _SEED.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1] and b - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], b)
        else:
            if out and a < out[-1][1]:
                a = max(out[-1][1], min(a, m.start()))
            if a <= m.start():
                out.append([a, b])
    if most < math.inf:
        return [(a, b) for a, b in out]
    whole: list[tuple[int, int]] = []
    for a, b in out:
        least, last = max(0, a + reach - MAX_CHARS), min(len(text), b - reach + MAX_CHARS)
        while a > least and not text[a - 1].isspace():
            a -= 1
        while b < last and not text[b].isspace():
            b += 1
        if whole and a <= whole[-1][1]:
            whole[-1] = (whole[-1][0], b)
        else:
            whole.append((a, b))
    return whole


FEATURES = 32


def _whole(text: str, a: int, b: int) -> bool:
    """Whether no letter or figure touches the span from outside: a span never starts or ends inside a word."""
    return not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum())


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Indices of the features of the whole segment of tokens i..j-1 (j exclusive)."""
    a, b = tokens[i][0], tokens[j - 1][1]
    s = text[a:b]
    digits = [c for c in s if "0" <= c <= "9"]
    n = len(digits)
    f = [0]
    f.append(1 + min(n, 20) // 4)  # 1..6
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    letters = sum(c.isalpha() for c in s)
    before, after = text[a - 1 : a], text[b : b + 1]
    if not _whole(text, a, b):
        f.append(7)
    if (s[0].isalnum() or s[0] in "+(") and s[-1].isalnum():
        f.append(8)
    at = s.count("@") + len(re.findall(r"[(\[]at[)\]]|\bat\b", s))
    dots = len(re.findall(r"\.|[(\[]dot[)\]]|\bdot\b", s))
    if at == 1 and dots and re.fullmatch(r"[A-Za-z0-9._%+-]+\s*(?:@|[(\[]at[)\]]|\bat\b)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[(\[]dot[)\]]|\bdot\b)\s*[A-Za-z0-9-]+)+", s):
        f.append(9)
        if after == "." and text[b + 1 : b + 2].isalnum():
            f.append(10)
        if before and before in "._%+-":
            f.append(10)
        if re.search(r"[A-Za-z]{2,}\Z", s):
            f.append(11)
    elif at:
        f.append(12)
    if re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}", s):
        f.append(13 if all(int(g) <= 255 for g in re.findall(r"[0-9]+", s)) else 14)
    if 13 <= n <= 19 and not letters and re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s):
        f.append(15 if luhn("".join(digits)) else 16)
        if set(groups[:-1]) <= {4}:
            f.append(17)
    if 9 <= n <= 15 and re.fullmatch(r"\+?\(?[0-9][ ().0-9-]*[0-9]", s):
        f.append(18 if s[0] == "+" else 19)
        if "(" in s and ")" in s:
            f.append(20)
        if len(groups) >= 3 and groups[-1] >= 2:
            f.append(21)
    elif not letters and n:
        f.append(22)
    word = re.findall(r"[^\W\d_]+", text[max(0, a - 16) : a].lower())
    for k, kind in enumerate(KINDS):
        if word and (word[-1] in _CUES[kind] or len(word) > 1 and word[-2] in _CUES[kind]):
            f.append(23 + k)
    if letters and n and not at:
        f.append(27)
    if len(groups) == 1:
        f.append(28)
    if before == "+" or re.search(r"[0-9][ -]?\Z", text[max(0, a - 2) : a]) or re.match(r"[ -]?[0-9]", text[b : b + 2]):
        f.append(29)
    if before == "." and text[a - 2 : a - 1].isdigit() or after == "." and text[b + 1 : b + 2].isdigit():
        f.append(30)
    if not n and not at:
        f.append(31)
    return f


class Field:
    """Weights (kind, feature); kind 0 is a single token outside any span."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.rows = weights.tolist()

    @staticmethod
    def segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
        """(i, j, features) of each segment of tokens, by i and j."""
        opens = [text[x].isalnum() or text[x] in "+(" for x, _ in tokens]
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + 2 * MAX_TOKENS) + 1):
                if j - i > 1:
                    if tokens[j - 1][1] - tokens[i][0] > MAX_CHARS:
                        break
                    last = text[tokens[j - 1][1] - 1]
                    if not (opens[i] and last.isalnum() and _whole(text, tokens[i][0], tokens[j - 1][1]) and _SEED.search(text, tokens[i][0], tokens[j - 1][1])):
                        continue
                yield i, j, span_features(text, tokens, i, j)

    @staticmethod
    def lattice(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], list[int]]]:
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        return tokens, {(i, j): f for i, j, f in Field.segments(text, tokens)}

    def scores(self, features: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], list[float]]:
        """Of each segment by kind; only single tokens may be outside (kind 0)."""
        return {(i, j): self.score(j - i, f) for (i, j), f in features.items()}

    def score(self, n: int, f: list[int]) -> list[float]:
        s = [sum(w[k] for k in f) for w in self.rows]
        if n > 1:
            s[0] = -math.inf
        elif 7 in f:
            s[1:] = [-math.inf] * len(KINDS)
        return s

    def best(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation's spans: Viterbi over segments of bounded length, which are not kept."""
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        top, back = [0.0] + [-math.inf] * len(tokens), [(0, 0)] * (len(tokens) + 1)
        for i, j, f in self.segments(text, tokens):
            s = self.score(j - i, f)
            k = max(range(len(s)), key=s.__getitem__)
            if top[i] + s[k] > top[j]:
                top[j], back[j] = top[i] + s[k], (i, k)
        out, j = [], len(tokens)
        while j > 0:
            i, k = back[j]
            if k:
                out.append((KINDS[k - 1], tokens[i][0], tokens[j - 1][1]))
            j = i
        return out[::-1]


def _truth(tokens: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int, int]] | None:
    """The segmentation that the spans ask for; None if a span's edges are no token edges or it is too long."""
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    out, used = [], set()
    for kind, a, b in spans:
        if a not in starts or b not in ends or ends[b] - starts[a] > 2 * MAX_TOKENS:
            return None
        i, j = starts[a], ends[b]
        if used & set(range(i, j)):
            return None
        used |= set(range(i, j))
        out.append((i, j, 1 + KINDS.index(kind)))
    return out + [(i, i + 1, 0) for i in range(len(tokens)) if i not in used]


def _expect(field: Field, n: int, features: dict, gradient: np.ndarray) -> None:
    """Subtract the expected feature counts of a lattice of n tokens: forward-backward over segments."""
    scored = field.scores(features)
    weight = {ij: np.array(s) for ij, s in scored.items()}
    total = {ij: float(np.logaddexp.reduce(w)) for ij, w in weight.items()}
    ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = behind[n] = 0.0
    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for i, j in features:
        by_end.setdefault(j, []).append(i)
        by_start.setdefault(i, []).append(j)
    for j in range(1, n + 1):
        ahead[j] = float(np.logaddexp.reduce([ahead[i] + total[i, j] for i in by_end[j]]))
    for i in range(n - 1, -1, -1):
        behind[i] = float(np.logaddexp.reduce([behind[j] + total[i, j] for j in by_start[i]]))
    for (i, j), f in features.items():
        p = np.exp(np.minimum(0, ahead[i] + weight[i, j] + behind[j] - ahead[n]))
        for k in f:
            gradient[:, k] -= p


def rewritten(seed: int = 5, each: int = 40) -> list[tuple[str, list[Span]]]:
    """Training sentences with spans as people write them and figures that are none, from a fixed seed."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    w = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(3, 8)))

    def card() -> str:
        body = "4" + d(14)
        return next(body + str(x) for x in range(10) if luhn(body + str(x)))

    def build(cue: str, span: str, kind: str | None, tail: str) -> tuple[str, list[Span]]:
        text = f"{w()} {cue}{span}{tail}"
        return text, [(kind, len(text) - len(tail) - len(span), len(text) - len(tail))] if kind else []

    out = []
    for _ in range(each):
        tail = [f" {w()}", ". " + w(), ", " + w(), ""][int(rng.integers(0, 4))]
        c = card()
        out += [
            build("phone ", f"({d(3)}) {d(3)}-{d(4)}", "phone", tail), build("call ", f"{d(3)}-{d(3)}-{d(4)}", "phone", tail),
            build("", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", "phone", tail), build("", f"{w()}.{d(2)}@{w()}.example.com", "email", tail),
            build("", f"{w()} at {w()} dot com", "email", tail), build("mail ", f"{w()}(at){w()}.org", "email", tail), build("", f"{w()}@{w()}.org", "email", tail),
            build("card ", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", "card", tail), build("", f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", "card", tail), build("", c, "card", tail),
            build("ip ", ".".join(str(x) for x in rng.integers(1, 255, 4)).replace(".", "[.]", 1), "ip", tail), build("", ".".join(str(x) for x in rng.integers(1, 255, 4)), "ip", tail),
            build("", f"version {d(1)}.{d(1)}", None, tail), build("", d(int(rng.integers(5, 20))), None, tail), build("", f"{d(3)}-{d(3)}-{d(4)}", None, tail), build("in ", f"20{d(2)}", None, tail),
            build("token = ", f'"{w()}{d(4)}{w()}"', None, tail), build("", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", None, tail), build("", f"{w()} at {w()}", None, tail), build("", f"{d(2)}.{d(3)}.{d(3)}", None, tail),
        ]
    return out


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 12, rate: float = 0.5, seed: int = 3) -> Field:
    """Weights by stochastic gradient ascent of the conditional likelihood, in minibatches of lattices."""
    ready = []
    for text, spans in examples:
        tokens, features = Field.lattice(text, 0, len(text))
        truth = _truth(tokens, spans)
        if tokens and truth is not None:
            ready.append((len(tokens), features, truth))
    w = np.zeros((1 + len(KINDS), FEATURES))
    w[1:, 0] = -2.0
    rng, square = np.random.default_rng(seed), np.full_like(w, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(ready))
        for a in range(0, len(order), 64):
            g, field = -0.01 * w, Field(w)
            for x in order[a : a + 64]:
                n, features, truth = ready[x]
                for i, j, k in truth:
                    for f in features[i, j]:
                        g[k, f] += 1
                _expect(field, n, features, g)
            square += g * g
            w = w + rate * g / np.sqrt(square)
    return Field(w)


@lru_cache(maxsize=4)
def _field(weights: bytes) -> Field:
    return Field(np.frombuffer(weights).reshape(1 + len(KINDS), FEATURES))


def learn(docs: DataFrame, *, text: str = "text", sample: int = 60, slice_chars: int = 4000) -> np.ndarray:
    """The field's weights, from at most `sample` documents with figures (`slice_chars` characters of each, the bound on
    what the driver gets, and of these the first four regions of up to 400 characters) labelled by the base patterns, and the rewritten spans. No documents: from the latter alone."""
    rows = docs.filter(F.col(text).rlike("[0-9@]")).select(F.xxhash64(text).alias("_h"), F.substring(text, 1, slice_chars).alias("_t"))
    # two steps, so that a task sends hashes to the driver and not slices; copies share a hash and count once
    least = [r["_h"] for r in rows.select("_h").distinct().orderBy("_h").limit(sample).collect()]
    got = rows.filter(F.col("_h") <= least[-1]).groupBy("_h").agg(F.min("_t").alias("_t")).collect() if least else []
    examples = rewritten()
    for r in sorted(got):
        t = r["_t"]
        spans = base_spans(t)
        for a, b in regions(t, most=400)[:4]:
            inside = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
            if not any(s < b and e > a and not (a <= s and e <= b) for _, s, e in spans):
                examples.append((t[a:b], inside))
    return fit(examples).weights


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the field's spans that overlap no base span are added."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    begins = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        at = bisect_left(begins, b)
        return at == 0 or reach[at - 1] <= a

    for a, b in regions(text):
        if any(free(*m.span()) for m in _SEED.finditer(text, a, b)):
            added += [x for x in field.best(text, a, b) if free(x[1], x[2])]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(set(base + added), key=lambda x: (order[x[0]], x[1], x[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, weights: np.ndarray, *, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with two arrays of (kind, start, end), in code points, by kind and start: the base spans, and all spans.

    The whole text is read, whatever its length; a null text has none. Other columns pass through, repeated rows stay.
    """
    kept = [f for f in docs.schema.fields if f.name not in (base, spans)]
    raw = np.ascontiguousarray(weights, float).tobytes()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    dicts = lambda xs: [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in xs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(raw)
        for batch in batches:
            got = [all_spans(t.as_py() or "", field) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(dicts(g[0] for g in got), kind), pa.array(dicts(g[1] for g in got), kind)], names=[*(f.name for f in kept), base, spans])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(base, SPANS), T.StructField(spans, SPANS)]))


def redact(docs: DataFrame, weights: np.ndarray, *, text: str = "text") -> DataFrame:
    """docs whose texts have `<kind>` in the place of every span; where spans overlap, one mark replaces their union."""
    kept = docs.schema
    raw = np.ascontiguousarray(weights, float).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _field(raw)
        for batch in batches:
            out = [None if t.as_py() is None else _masked(t.as_py(), all_spans(t.as_py(), field)[1]) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if f.name == text else batch.column(f.name) for f in kept.fields], names=kept.names)

    return docs.mapInArrow(run, kept)


def _masked(text: str, spans: list[Span]) -> str:
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])
