"""SentencePiece-model BPE as vectorised merge rounds, and the way back to text.

A text is cut where no merge can cross: before a space mark that follows another character. Distinct units of a batch
are merged together in flat numpy arrays: every round takes, for each unit, the leftmost pair of minimum rank
(a segmented minimum), merges these pairs at once, compacts the arrays and leaves out the units that are done.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
NONE = np.int32(1 << 20)
LONG_UNIT = 512
CACHED_UNITS = 300_000
BLOCK_CHARS = 1_000_000
ROUND_CHARS = 200_000
SLOTS, PROBES = 1 << 18, 4


class PieceModel:
    """The vocabulary of a BPE model file as arrays: piece of each character, rank and result of each pair, piece bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.size, self.unk = n, sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {pieces[i]: i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([byte_ids.get(f"<0x{b:02X}>", self.unk) for b in range(256)], np.int32)
        self.has_bytes = bool(byte_ids)
        plain = {pieces[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.spaced = not any(SPACE in p.lstrip(SPACE) for p in plain)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-scores, return_inverse=True)
        pairs = sorted((plain[p[:k]] * n + plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain)
        self.pairs = dict(pairs)
        self.keys, self.made = self._slots(pairs)
        self.rank = rank.astype(np.int32)
        texts = []
        for i in range(n):
            if sp.is_byte(i):
                texts.append(bytes([int(pieces[i][3:5], 16)]))
            elif sp.is_control(i):
                texts.append(b"")
            elif sp.is_unknown(i):
                texts.append(" ⁇ ".encode())
            else:
                texts.append(pieces[i].replace(SPACE, " ").encode())
        self.out_len = np.array([len(t) for t in texts], np.int64)
        self.out_at = np.concatenate(([0], np.cumsum(self.out_len)[:-1]))
        self.out = np.frombuffer(b"".join(texts), np.uint8)
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _slots(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """An open hash table of the pairs with at most PROBES steps from a key's first slot."""
        slots = SLOTS
        while True:
            keys, made, fits = np.full(slots + PROBES, -1, np.int64), np.zeros(slots + PROBES, np.int32), True
            for k, i in pairs:
                at = (k * 0x9E3779B1 >> 7) % slots
                step = next((d for d in range(PROBES) if keys[at + d] < 0), None)
                if step is None:
                    fits = False
                    break
                keys[at + step], made[at + step] = k, i
            if fits:
                return keys, made
            slots *= 2

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where no piece is made) and result of each pair of symbols; negative symbols never merge."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = (key * 0x9E3779B1 >> 7) % (len(self.keys) - PROBES)
        made, rank = np.zeros(len(key), np.int32), np.full(len(key), NONE)
        for step in range(PROBES):
            hit = np.flatnonzero(self.keys[at + step] == key)
            made[hit] = self.made[at[hit] + step]
            rank[hit] = self.rank[made[hit]]
        return rank, made

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.of_char[points]
        return np.where(found >= 0, found, -1 - points.astype(np.int64)).astype(np.int32)

    def finish(self, symbols: np.ndarray) -> bytes:
        """Ids of merged symbols as little-endian int32; a character without a piece becomes its bytes (or unk)."""
        if (symbols >= 0).all():
            return symbols.astype("<i4").tobytes()
        out: list[np.ndarray] = []
        for s in symbols.tolist():
            if s >= 0:
                out.append(np.array([s], "<i4"))
            elif self.has_bytes:
                out.append(self.byte_ids[list(chr(-1 - s).encode("utf-8", "replace"))].astype("<i4"))
            elif not out or out[-1][-1] != self.unk:
                out.append(np.array([self.unk], "<i4"))
        return np.concatenate(out).tobytes()

    def merge_units(self, units: list[str]) -> None:
        """Put the ids of each unit into the cache."""
        long = [u for u in units if len(u) > LONG_UNIT]
        for u in long:
            self.cache[u] = self.finish(self.merge_queue(self.symbols(u)))
        units = [u for u in units if 0 < len(u) <= LONG_UNIT]
        if not units:
            return
        sym = self.symbols("".join(units))
        lens = np.array([len(u) for u in units], np.int64)
        which = np.arange(len(units))
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        rank = np.full(len(sym), NONE)
        made = np.zeros(len(sym), np.int32)
        rank[:-1], made[:-1] = self.pair(sym[:-1], sym[1:])
        rank[starts + lens - 1] = NONE
        starts = starts.astype(np.int32)
        while len(which):
            place = np.arange(len(sym), dtype=np.int32) - np.repeat(starts, lens)
            best = np.minimum.reduceat(rank << 10 | place, starts)
            done = best >= int(NONE) << 10
            if done.any():
                stay = np.repeat(~done, lens)
                out = sym[~stay]
                if self.has_bytes:
                    ascii_only = (out < 0) & (out >= -128)
                    out[ascii_only] = self.byte_ids[-1 - out[ascii_only]]
                flat, ends = out.astype("<i4").tobytes(), np.cumsum(lens[done])
                odd = np.minimum.reduceat(out, ends - lens[done]) < 0
                for w, e, n, o in zip(which[done].tolist(), ends.tolist(), lens[done].tolist(), odd.tolist()):
                    self.cache[units[w]] = self.finish(out[e - n : e]) if o else flat[4 * (e - n) : 4 * e]
                sym, rank, made = sym[stay], rank[stay], made[stay]
                which, lens, best = which[~done], lens[~done], best[~done]
                if not len(which):
                    return
                starts = (np.cumsum(lens) - lens).astype(np.int32)
            at = starts + (best & 1023)
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, made = sym[keep], rank[keep], made[keep]
            at = at - np.arange(len(at), dtype=np.int32)
            lens = lens - 1
            starts = (np.cumsum(lens) - lens).astype(np.int32)
            last = at == starts + lens - 1
            rank[at[last]] = NONE
            right = at[~last]
            rank[right], made[right] = self.pair(sym[right], sym[right + 1])
            left = at[at > starts] - 1
            rank[left], made[left] = self.pair(sym[left], sym[left + 1])

    def merge_queue(self, sym: np.ndarray) -> np.ndarray:
        """The same merges for one very long unit, from a queue: a round there would move the whole unit for one pair."""
        rank, made = self.pair(sym[:-1], sym[1:])
        ids, n = sym.tolist(), len(sym)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if r < NONE]
        heapq.heapify(queue)

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and ids[i] >= 0 and ids[after[i]] >= 0:
                m = self.pairs.get(ids[i] * self.size + ids[after[i]])
                if m is not None:
                    heapq.heappush(queue, (int(self.rank[m]), i, ids[i], ids[after[i]], m))

        while queue:
            _, i, a, b, m = heapq.heappop(queue)
            j = after[i]
            if not live[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], live[j], after[i] = m, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([x for x, ok in zip(ids, live) if ok], np.int32)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.spaced:
            return [marked]
        if "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text:
            return text.split(" ")
        return re.findall(f"{SPACE}+[^{SPACE}]*", marked)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut_up = []
        for t in texts:
            u = self.units(t)
            if u and not u[0].startswith(SPACE):
                u = [SPACE + x for x in u]
            cut_up.append(u)
        new = set().union(*cut_up) - self.cache.keys()
        if len(self.cache) + len(new) > CACHED_UNITS:
            self.cache.clear()
            new = set().union(*cut_up)
        todo, size = [], 0
        for u in new:
            todo.append(u)
            size += len(u)
            if size > ROUND_CHARS:
                self.merge_units(todo)
                todo, size = [], 0
        self.merge_units(todo)
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, u)), "<i4") for u in cut_up]

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> list[str]:
        """The texts of flat ids, lens[i] of them for text i; one leading space, the dummy prefix, is dropped."""
        size = self.out_len[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.out[np.repeat(self.out_at[ids] - (ends - size), size) + np.arange(total)].tobytes()
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lens)))].tolist()
        texts = (flat[a:b] for a, b in zip(bounds, bounds[1:]))
        return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


@lru_cache(maxsize=2)
def piece_model(model: bytes) -> PieceModel:
    return PieceModel(model)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about BLOCK_CHARS characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BLOCK_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, model: bytes, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids (array<int>) of the whole text, as the sentencepiece library gives them, without begin or end.

    model: the bytes of a BPE model file. A null or empty text gives an empty array; repeated rows stay; any other
    column, of whatever name but `ids`, passes through. The memory of a task is bounded by a batch and a unit cache.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != ids), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in _parts(texts):
                got = m.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))
                part = batch.slice(a, b - a)
                columns = [lists if f.name == ids else part.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of the ids (array<int>): the inverse of encode(). Null ids give null; unknown ids raise."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != decoded), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                column = part.column(ids)
                lens = np.diff(column.offsets.to_numpy())
                texts = m.decode(column.flatten().to_numpy(zero_copy_only=False), lens)
                back = pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([back if f.name == decoded else part.column(f.name) for f in schema.fields], names=schema.names)

    return df.mapInArrow(run, schema)
