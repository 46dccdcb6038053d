"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of `WINDOW` positions, all of them, whatever the length. Two gated recurrent
layers read each window forwards and backwards; every position gets label probabilities from both states, and the
document's probabilities are their mean over all its positions. Training is backpropagation through time in numpy on a
sample of at most `per_label` documents a label and `SLICE` characters of each, so its cost doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
HIDDEN = 6
SLICE = 1024
PAD = 256
UNKNOWN = "und"
CHUNK = 2048
SALTS = 256
HALF = np.float32(0.5)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, n) byte values, padded with PAD, and the text that each window belongs to."""
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    flat = np.full(int(count.sum()) * WINDOW, PAD, np.uint16)
    begin = np.repeat((np.cumsum(count) - count) * WINDOW - (np.cumsum(size) - size), size)
    flat[np.arange(int(size.sum())) + begin] = np.frombuffer(b"".join(texts), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), owner


@dataclass
class Network:
    """embed: (2, 3H, 257) inputs of the gates for each byte; recur: (2, 3H, H); out: (labels, 2H); bias: (labels, 1).

    Gates are hard sigmoids, clip(x + 1/2, 0, 1); the candidate state is a hyperbolic tangent.
    """

    embed: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def states(self, x: np.ndarray, side: int, keep: bool = False):
        """(T, H, n) states of one direction, in reading order; with keep also what backpropagation needs."""
        e, u = self.embed[side], self.recur[side]
        n, hid = x.shape[1], u.shape[1]
        h, all_h, saved = np.zeros((hid, n), np.float32), np.empty((len(x), hid, n), np.float32), []
        for t in range(len(x)) if side == 0 else range(len(x) - 1, -1, -1):
            a = e.take(x[t], axis=1, mode="clip")
            b = u @ h
            gates = a[: 2 * hid] + b[: 2 * hid]
            gates += HALF
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            r, z = gates[:hid], gates[hid:]
            c = r * b[2 * hid :]
            c += a[2 * hid :]
            np.tanh(c, out=c)
            if keep:
                saved.append((t, h, r, z, c, b[2 * hid :]))
            h = h - c
            h *= z
            h += c
            all_h[t] = h
        return (all_h, saved) if keep else all_h

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(labels, n): the sum over a window's positions, without padding, of their label probabilities."""
        f, b = self.states(x, 0), self.states(x, 1)
        hid, labels = f.shape[1], len(self.out)
        total = np.zeros((labels, x.shape[1]), np.float32)
        last = x[-1] == PAD
        for t in range(len(x)):
            y = self.out[:, :hid] @ f[t]
            y += self.out[:, hid:] @ b[t]
            y += self.bias
            y -= y.max(0)
            np.exp(y, out=y)
            y /= y.sum(0)
            if last.any():
                y *= x[t] != PAD
            total += y
        return total

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """(n, labels) mean probabilities; zero for an empty text."""
        total = np.zeros((len(texts), len(self.out)))
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= 2_000_000):
                size += len(texts[end])
                end += 1
            x, owner = windows(texts[begin:end])
            for a in range(0, x.shape[1], CHUNK):
                p = self.probabilities(x[:, a : a + CHUNK].astype(np.intp))
                for k in range(len(p)):
                    total[begin:end, k] += np.bincount(owner[a : a + CHUNK], weights=p[k], minlength=end - begin)
            begin = end
        return total / np.maximum(1, [len(t) for t in texts])[:, None]


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over all positions, by backpropagation through time."""
    hid, labels = net.recur.shape[2], len(net.out)
    sides = [net.states(x, s, keep=True) for s in (0, 1)]
    mask = (x != PAD).astype(np.float32)
    scale = 1 / max(1.0, float(mask.sum()))
    g_out, g_bias = np.zeros_like(net.out), np.zeros_like(net.bias)
    g_h = [np.zeros_like(sides[0][0]), np.zeros_like(sides[0][0])]
    truth = np.eye(labels, dtype=np.float32)[:, y]
    for t in range(len(x)):
        both = np.concatenate([sides[0][0][t], sides[1][0][t]])
        p = net.out @ both + net.bias
        p = np.exp(p - p.max(0))
        p = (p / p.sum(0) - truth) * mask[t] * scale
        g_out += p @ both.T
        g_bias += p.sum(1, keepdims=True)
        back = net.out.T @ p
        g_h[0][t], g_h[1][t] = back[:hid], back[hid:]
    g_embed, g_recur = np.zeros_like(net.embed), np.zeros_like(net.recur)
    for s in (0, 1):
        u, carry = net.recur[s], np.zeros((hid, x.shape[1]), np.float32)
        d_in = np.empty((len(x), 3 * hid, x.shape[1]), np.float32)
        for t, h, r, z, c, b in reversed(sides[s][1]):
            d = g_h[s][t] + carry
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * ((z > 0) & (z < 1))
            dr = dc * b * ((r > 0) & (r < 1))
            d_in[t] = np.concatenate([dr, dz, dc])
            db = np.concatenate([dr, dz, dc * r])
            g_recur[s] += db @ h.T
            carry = d * z + u.T @ db
        for k in range(3 * hid):
            g_embed[s, k] = np.bincount(x.ravel(), weights=d_in[:, k].ravel(), minlength=PAD + 1)
    return [g_embed, g_recur, g_out, g_bias]


def train(texts: list[bytes], labels: list[int], n_labels: int, *, hidden: int = HIDDEN, epochs: int = 8, batch: int = 256, most: int = 16_000, seed: int = 7) -> Network:
    """A network fitted by Adam to the windows of the texts (at most `most` of them)."""
    rng = np.random.default_rng(seed)
    x, owner = windows(texts)
    y = np.asarray(labels)[owner]
    if x.shape[1] > most:
        pick = rng.permutation(x.shape[1])[:most]
        x, y = x[:, pick], y[pick]
    f = np.float32
    net = Network(rng.normal(0, 0.3, (2, 3 * hidden, PAD + 1)).astype(f), rng.normal(0, 0.3, (2, 3 * hidden, hidden)).astype(f), rng.normal(0, 0.3, (n_labels, 2 * hidden)).astype(f), np.zeros((n_labels, 1), f))
    params = [net.embed, net.recur, net.out, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = max(1, epochs * -(-x.shape[1] // batch))
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            step += 1
            rate = 0.02 * (1 - 0.9 * step / steps)
            for p, g, m, v in zip(params, _gradients(net, x[:, part], y[part]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f)
    return net


def learn(docs: DataFrame, *, label: str = "lang", text: str = "text", key: str = "doc_id", per_label: int = 500) -> tuple[list[str], Network | None]:
    """Label values in order and the network, from a sample of at most `per_label` rows a label (the bound on what the
    driver gets: per_label x labels x SLICE characters), chosen by a hash of the key; null labels and empty texts are left out.

    The network learns from at most 16,000 windows of them (see train()). Rows are ranked within (label, salt) first, so
    no task gets all rows of a label; equal rows of one hash are one."""
    at = F.pmod(F.xxhash64(key, F.lit("slice")), F.greatest(F.length(text) - SLICE, F.lit(0)) + 1) + 1
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}"))
    keyed = rows.select(F.col(label).alias("_label"), F.xxhash64(key).alias("_order"), F.pmod(F.xxhash64(key, text), F.lit(SALTS)).alias("_salt"), F.substring(text, at.cast("int"), F.lit(SLICE)).alias("_slice"))
    least = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_order", "_slice"))).filter(F.col("_n") <= per_label)
    ranked = least(least(keyed, "_label", "_salt"), "_label")
    got = sorted((r["_label"], r["_order"], r["_slice"]) for r in ranked.collect())
    names = sorted({r[0] for r in got})
    if not names:
        return [], None
    return names, train([r[2].encode("utf-8", "replace") for r in got], [names.index(r[0]) for r in got], len(names))


def identify(docs: DataFrame, model: tuple[list[str], Network | None], *, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted label and its mean probability over all positions of the whole text.

    `und` with score 0 for a null text, one without a letter, or a model that has seen no label. Other columns pass
    through; repeated rows stay.
    """
    names, net = model
    marked = docs.withColumn("_cw_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    kept = [f for f in docs.schema.fields if f.name not in (pred, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                ok = part.column("_cw_letters").to_pylist()
                texts = [t.encode("utf-8", "replace") if k and names else b"" for t, k in zip(part.column(text).to_pylist(), ok)]
                p = net.predict(texts) if net is not None else np.zeros((part.num_rows, 1))
                known = [bool(t) for t in texts]
                labels = [names[i] if k else UNKNOWN for i, k in zip(p.argmax(1).tolist(), known)]
                best = np.where(known, np.clip(p.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(labels), pa.array(best)], names=[*(f.name for f in kept), pred, score])

    from pyspark.sql import types as T

    schema = T.StructType([*kept, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return marked.mapInArrow(run, schema)
