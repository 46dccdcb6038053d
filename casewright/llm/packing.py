"""Packing documents into token windows with non-negative least squares.

1. Tokenize every document (whole text) and end it with the end id; write ids once, as packed integers.
2. Whole windows of a long document are sequences of their own; what is left of each document is one rest.
3. The histogram of rest lengths (as many bins as a window has tokens, whatever the number of documents) goes to the
   driver. Shallow combinations of two or three lengths that fill a window exactly are enumerated; non-negative least
   squares finds how often to repeat each; the counts are rounded down to what the histogram holds.
4. Each rest gets its rank among rests of its length from salted counts, and the rank names its slot.
5. Rests beyond the slots are packed greedily one after the other, cut where a window ends; only the very last window
   is padded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.shared import running_total, stage_table

CACHED_TOKENS = 800_000
#: A run of white space as long as this goes to the tokenizers library: tiktoken's pattern gives up at about a million.
WHITE_RUN = 10_000
# Fixed value: the pattern by which byte-level BPE files of this family cut a text before merging.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROWS_PER_SALT = 50_000
LEAST_SALTS = 256


class TextTokenizer:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Where the file's merges come in the order of their ids, ranks say the same as merges, and the tiktoken library
    applies them to whole texts; else the tokenizers library encodes each distinct pre-token once. special: the strings
    of the file's special tokens are these tokens in a text too, as the tokenizers library has it by itself; else they
    are plain text. Texts that hold such a string go to that library whole.
    """

    def __init__(self, model: bytes, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        self.pieces = regex.compile(PRE_TOKENS).findall
        self.spaces = re.compile(r"\s+").finditer
        self.tokens: dict[str, bytes] = {}
        self.bpe = Tokenizer.from_str(model.decode())
        self.bpe.encode_special_tokens = not special
        self.vocabulary = self.bpe.get_vocab_size()
        file = json.loads(model)
        self.added = [t["content"] for t in file["added_tokens"] if special or not t["special"]]
        self.ranked = self._ranked(file)

    @staticmethod
    def _ranked(file: dict):
        """The encoder by ranks, or None if the file's merges are not in the order of their ids."""
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        vocab, extra = file["model"]["vocab"], {t["content"] for t in file["added_tokens"]}
        made = [vocab["".join(m)] for m in merges]
        shown = str(file["pre_tokenizer"])
        if made != sorted(set(made)) or "ByteLevel" not in shown or "Split" in shown or file.get("normalizer") or file["model"].get("ignore_merges"):
            return None
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in extra}
        if max(ranks[bytes([b])] for b in range(256)) > made[0]:
            return None
        return tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _apart(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _whole(self, text: str) -> list[int]:
        if self._apart(text):
            return self.bpe.encode(text, add_special_tokens=False).ids
        if len(text) >= WHITE_RUN and any(m.end() - m.start() >= WHITE_RUN for m in self.spaces(text)):
            return self.bpe.encode(text, add_special_tokens=False).ids
        return self.ranked(text)

    def encode(self, texts: list[str], end: int, width: str = "<u4") -> list[bytes]:
        """The ids of each text and the end id, as integers of numpy type `width`, one after the other."""
        last = np.array([end], width).tobytes()
        if self.ranked:
            return [np.array(self._whole(t), width).tobytes() + last for t in texts]
        cut_up = [[] if self._apart(t) else self.pieces(t) for t in texts]
        missing = set().union(*cut_up) - self.tokens.keys()
        if len(self.tokens) + len(missing) > CACHED_TOKENS:
            self.tokens.clear()
            missing = set().union(*cut_up)
        todo = list(missing)
        for a in range(0, len(todo), 20_000):
            part = todo[a : a + 20_000]
            for token, got in zip(part, self.bpe.encode_batch_fast(part, add_special_tokens=False)):
                self.tokens[token] = np.array(got.ids, "<u4").tobytes()
        raw = lambda t: np.array(self.bpe.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        joined = (raw(t) if self._apart(t) else b"".join(map(self.tokens.__getitem__, cut)) for t, cut in zip(texts, cut_up))
        return [np.frombuffer(ids, "<u4").astype(width).tobytes() + last for ids in joined]


@lru_cache(maxsize=2)
def _tokenizer(model: bytes, special: bool) -> TextTokenizer:
    return TextTokenizer(model, special)


def tokenize(docs: DataFrame, model: bytes, end: int, *, key: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """(uid, key, ids binary, n_tokens) of every row: ids are packed integers of 2 bytes (4 for a large vocabulary).

    model: the bytes of a tokenizers JSON file; special: as TextTokenizer has it. A null text counts as empty: its ids are the end id alone.
    uid is unique; repeated rows and null keys stay apart.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = _tokenizer(shared.value, special)
        width = "<u2" if max(t.vocabulary - 1, end) < 65536 else "<u4"
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                ids = t.encode([x or "" for x in part.column(1).to_pylist()], end, width)
                n = [len(x) // np.dtype(width).itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(n, pa.int64())], names=["_key", "_ids", "n_tokens"])

    got = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, _ids binary, n_tokens bigint")
    return got.select(F.monotonically_increasing_id().alias("uid"), F.col("_key").alias(key), F.col("_ids").alias("ids"), "n_tokens")


def combinations(histogram: np.ndarray, window: int, most: int = 20_000) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window: all pairs, and triples led by the most frequent lengths."""
    have = np.flatnonzero(histogram > 0)
    have = have[have > 0]
    there = np.zeros(window + 1, bool)
    there[have] = True
    a = have[(have * 2 <= window) & there[window - have]]
    rows = [np.stack([a, window - a, np.zeros_like(a)], 1)]
    count = len(a)
    for lead in have[np.argsort(-histogram[have], kind="stable")].tolist():
        if count >= most:
            break
        b = have[(have * 2 <= window - lead)]
        c = window - lead - b
        ok = c > 0
        ok[ok] = there[c[ok]]
        b, c = b[ok], c[ok]
        rows.append(np.stack([np.full_like(b, lead), b, c], 1))
        count += len(b)
    return np.unique(np.sort(np.concatenate(rows), 1)[:, ::-1], axis=0).astype(np.int64)


def nnls(rows: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 with the least squared error of (uses of each length) - histogram: accelerated projected gradient."""
    if not len(rows):
        return np.zeros(0)
    size, flat = len(histogram), rows.ravel()
    used = (rows > 0).astype(float)
    apply = lambda x: np.bincount(flat, weights=(used * x[:, None]).ravel(), minlength=size)
    back = lambda r: (r[rows] * used).sum(1)
    v = np.ones(len(rows))
    for _ in range(20):
        v = back(apply(v))
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0, y - back(apply(y) - histogram) / (1.05 * bound))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = z, z + (t - 1) / t2 * (z - x), t2
    return x


def plan(histogram: np.ndarray, window: int, rounds: int = 3) -> np.ndarray:
    """Rows (length a, b, c, repeats): repeat counts that the histogram can serve; each round solves what is left."""
    left, out = histogram.astype(np.int64).copy(), []
    for _ in range(rounds):
        rows = combinations(left, window)
        want = np.floor(nnls(rows, left.astype(float)) + 1e-6).astype(np.int64)
        done = 0
        for i in np.argsort(-want, kind="stable").tolist():
            if want[i] <= 0:
                break
            lens, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
            n = min(int(want[i]), int((left[lens] // times).min()))
            if n > 0:
                left[lens] -= n * times
                out.append((*rows[i].tolist(), n))
                done += n
        if not done:
            break
    return np.array(out, np.int64).reshape(-1, 4)


def _slots(found: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Each slot of each combination as a range of ranks of its length, sorted: key = length, first rank."""
    firsts = np.concatenate(([0], np.cumsum(found[:, 3])[:-1])) if len(found) else np.zeros(0, np.int64)
    taken = np.zeros(window + 1, np.int64)
    rows = []
    for (a, b, c, n), first in zip(found.tolist(), firsts.tolist()):
        offset = 0
        for length in (x for x in (a, b, c) if x):
            rows.append((length, int(taken[length]), n, first, offset))
            taken[length] += n
            offset += length
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return {"length": cols[0], "lo": cols[1], "n": cols[2], "first": cols[3], "offset": cols[4], "taken": taken}


def pack(tokens: DataFrame, *, window: int = 2048, key: str = "doc_id") -> DataFrame:
    """Pieces of a table from tokenize() that was written once (stage_table): (key, start, length, ids, doc_tokens,
    sequence_id, offset), ids as little-endian unsigned 32-bit integers.

    Every id lies in exactly one piece; offsets in a sequence are gapless from 0 and end at the window, but for the
    last sequence. An empty table gives no rows. Repeated rows are packed as documents of their own.
    """
    kind = dict(tokens.dtypes)[key]
    sizes = tokens.select("uid", "n_tokens", (F.col("n_tokens") % window).alias("rest"), F.expr(f"n_tokens div {window}").alias("whole"))
    total, whole = sizes.agg(F.count("*"), F.coalesce(F.sum("whole"), F.lit(0))).first()
    counts = np.zeros(window + 1, np.int64)
    for r in sizes.filter("rest > 0").groupBy("rest").count().collect():  # at most window - 1 rows
        counts[r["rest"]] = r["count"]
    found = plan(counts, window)
    slots = _slots(found, window)
    planned = int(found[:, 3].sum()) if len(found) else 0
    salts = max(LEAST_SALTS, -(-total // ROWS_PER_SALT))
    salt = F.pmod(F.xxhash64("uid"), F.lit(salts))

    full = running_total(sizes.filter("whole > 0"), "whole", "_before", salt, ["uid"])
    full = full.select("uid", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)).alias("_j"), "_before")
    full = full.select("uid", (F.col("_j") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), (F.col("_before") + F.col("_j")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    rests = sizes.filter("rest > 0").withColumn("_salt", salt)
    per = rests.groupBy("rest", "_salt").agg(F.count("*").alias("_n"))
    base = Window.partitionBy("rest").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("rest", "_salt", F.coalesce(F.sum("_n").over(base), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("rest", "_salt").orderBy("uid")) - 1
    ranked = rests.withColumn("_in", rank).join(per, ["rest", "_salt"]).select("uid", "n_tokens", "rest", (F.col("_base") + F.col("_in")).cast("long").alias("rank"))
    shared = tokens.sparkSession.sparkContext.broadcast(slots)  # three rows a combination at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        keys = s["length"] << 44 | s["lo"]
        for batch in batches:
            uid, n, rest, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            at = np.searchsorted(keys, rest << 44 | rank, "right") - 1
            placed = rank < s["taken"][rest]
            at = np.where(placed, at, 0)
            pick = lambda k: s[k][at] if len(keys) else np.zeros(len(at), np.int64)
            seq = np.where(placed, whole + pick("first") + rank - pick("lo"), -1)
            yield pa.RecordBatch.from_pydict({"uid": uid, "start": n - rest, "length": rest, "sequence_id": seq, "offset": pick("offset")})

    slotted = ranked.mapInArrow(place, "uid bigint, start bigint, length bigint, sequence_id bigint, offset bigint")
    fitted = slotted.filter("sequence_id >= 0")

    beyond = ranked.filter(F.col("rank") >= F.element_at(F.lit(slots["taken"].tolist()), F.col("rest").cast("int") + 1))
    beyond = beyond.select("uid", (F.col("n_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"))
    left = int((counts - slots["taken"]).clip(0).sum())
    tail = running_total(beyond, "length", "_at", F.pmod(F.xxhash64("uid", F.lit("rest")), F.lit(max(LEAST_SALTS, -(-left // ROWS_PER_SALT)))), ["uid"])
    head = F.least(F.col("length"), window - F.col("_at") % window)
    tail = tail.withColumn("_head", head).select("uid", F.explode(F.array(
        F.struct(F.col("start"), F.col("_head").alias("length"), (F.expr(f"_at div {window}") + whole + planned).alias("sequence_id"), (F.col("_at") % window).alias("offset")),
        F.struct((F.col("start") + F.col("_head")).alias("start"), (F.col("length") - F.col("_head")).alias("length"), (F.expr(f"_at div {window}") + whole + planned + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
    )).alias("p")).select("uid", "p.*").filter("length > 0")

    pieces = full.unionByName(fitted).unionByName(tail).groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = tokens.join(pieces, "uid").select(F.col(key).alias("_key"), "ids", "n_tokens", "pieces")

    def slice_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, names = batch.slice(a, 500), ("start", "length", "sequence_id", "offset")
                lists = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                cols = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in names}
                raw, n = part.column(1).to_pylist(), part.column(2).to_numpy()
                out = []
                for o, s, m in zip(owner.tolist(), cols["start"].tolist(), cols["length"].tolist()):
                    w = len(raw[o]) // int(n[o])
                    out.append(np.frombuffer(raw[o], f"<u{w}", m, s * w).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(cols["start"]), pa.array(cols["length"]), pa.array(out, pa.binary()), pa.array(n[owner]), pa.array(cols["sequence_id"]), pa.array(cols["offset"])], names=["_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    cut_up = joined.mapInArrow(slice_ids, f"_key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return cut_up.withColumnRenamed("_key", key)


def pack_documents(docs: DataFrame, model: bytes, *, end: int = 1, window: int = 2048, key: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """tokenize(), written once, and pack()."""
    return pack(stage_table(tokenize(docs, model, end, key=key, text=text, special=special), "tokens"), window=window, key=key)
