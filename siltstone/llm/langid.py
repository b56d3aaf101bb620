"""Language identification: a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows of equal length.  In each window one recurrent layer reads forwards and one backwards;
at every byte the two states together give a distribution over languages (every position is labelled), and a
document's probabilities are the normalised geometric mean of those of all its bytes.  The network is trained in numpy
by backpropagation through time on windows of a bounded sample of texts; prediction reads every byte of every text, where
the texts are, without moving rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a window, units of a direction.
LENGTH, UNITS = 64, 8
#: Texts of a language that are learnt from at most, and windows of each at most.
TEXTS, WINDOWS = 400, 8
#: Training: steps, windows of a step, learning rate.
STEPS, BATCH, RATE = 240, 256, 0.03
#: Windows that are read together in prediction, and bytes of texts that are gathered before.
TOGETHER, GATHERED = 4096, 4_000_000
#: What follows a text's last byte in its last window.
PAD = 256
#: Language of texts without letters.
UNKNOWN = "und"


@dataclass
class Network:
    """Languages and parameters.  Axis 0 of the recurrent ones is the direction.

    into: (2, 257, 3u) by byte, for the gates r, z and the candidate; within: (2, u, 3u); bias: (2, u) of the candidate's
    recurrent half; out: (2u, languages); base: (languages).
    """

    languages: list[str]
    into: np.ndarray
    within: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.into, self.within, self.bias, self.out, self.base]


def fresh(languages: list[str], units: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Network(languages, draw(2, PAD + 1, 3 * units), draw(2, units, 3 * units), np.zeros((2, units), np.float32), draw(2 * units, len(languages)), np.zeros(len(languages), np.float32))


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place of tanh (five times as fast); its slope is (1 - |soft(x)|) ** 2.  Gates are half of it and a half."""
    return x / (1 + np.abs(x))


def both_ways(windows: np.ndarray) -> np.ndarray:
    """(steps, 2, windows): the byte that each direction reads at each step."""
    turned = windows.T.astype(np.int64)
    return np.stack([turned, turned[::-1]], axis=1)


def forward(net: Network, windows: np.ndarray, keep: bool = False):
    """States (length, windows, 2 * units) at every byte; with ``keep`` also what backpropagation needs."""
    u, seen = net.within.shape[1], both_ways(windows)
    steps, _, n = seen.shape
    h, way = np.zeros((2, n, u), np.float32), np.arange(2)[:, None]
    states, kept = np.empty((steps, 2, n, u), np.float32), []
    for t in range(steps):
        x, y = net.into[way, seen[t]], h @ net.within
        gates = 0.5 * soft(x[..., : 2 * u] + y[..., : 2 * u]) + 0.5
        r, z = gates[..., :u], gates[..., u:]
        inner = y[..., 2 * u :] + net.bias[:, None, :]
        c = soft(x[..., 2 * u :] + r * inner)
        if keep:
            kept.append((h, r, z, inner, c))
        h = c + z * (h - c)
        states[t] = h
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    return (joined, seen, kept) if keep else joined


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all bytes (not padding) and its gradients, by backpropagation through time."""
    u = net.within.shape[1]
    joined, seen, kept = forward(net, windows, keep=True)
    steps, n, _ = joined.shape
    real = (windows.T != PAD)[..., None] / max(1, int((windows != PAD).sum()))
    logs = log_softmax(joined @ net.out + net.base)
    one = np.zeros(logs.shape, np.float32)
    one[:, np.arange(n), labels] = 1
    loss = float(-(logs * one * real).sum())
    d_logits = ((np.exp(logs) - one) * real).astype(np.float32)
    d_out, d_base = np.tensordot(joined, d_logits, axes=([0, 1], [0, 1])), d_logits.sum(axis=(0, 1))
    d_joined = d_logits @ net.out.T
    d_states = np.stack([d_joined[..., :u], d_joined[::-1, :, u:]], axis=1)
    d_within, d_bias = np.zeros_like(net.within), np.zeros_like(net.bias)
    d_x = np.empty((steps, 2, n, 3 * u), np.float32)
    d_h = np.zeros((2, n, u), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, inner, c = kept[t]
        d = d_h + d_states[t]
        d_c = d * (1 - z) * np.square(1 - np.abs(c))
        d_z = d * (h - c) * 0.5 * np.square(1 - np.abs(2 * z - 1))
        d_inner = d_c * r
        d_r = d_c * inner * 0.5 * np.square(1 - np.abs(2 * r - 1))
        d_y = np.concatenate([d_r, d_z, d_inner], axis=2)
        d_x[t] = np.concatenate([d_r, d_z, d_c], axis=2)
        d_within += h.transpose(0, 2, 1) @ d_y
        d_bias += d_inner.sum(axis=1)
        d_h = d * z + d_y @ net.within.transpose(0, 2, 1)
    d_into = np.zeros_like(net.into)
    for way in (0, 1):
        np.add.at(d_into[way], seen[:, way].ravel(), d_x[:, way].reshape(-1, 3 * u))
    return loss, [d_into, d_within, d_bias, d_out, d_base]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], units: int = UNITS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> Network:
    """Fit to ``windows`` (n x length, bytes or PAD) of languages ``labels`` (numbers); each step draws languages evenly.

    Adam, with a rate that falls to zero, and gradients no longer than 1.
    """
    net, rng = fresh(languages, units, seed), np.random.default_rng(seed + 1)
    own = [np.flatnonzero(labels == k) for k in range(len(languages))]
    means, squares = [np.zeros_like(p) for p in net.arrays()], [np.zeros_like(p) for p in net.arrays()]
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        drawn = rng.integers(0, len(languages), batch)
        pick = np.array([own[k][rng.integers(len(own[k]))] for k in drawn])
        found = gradients(net, windows[pick], labels[pick])[1]
        long = float(np.sqrt(sum(float((g * g).sum()) for g in found)))
        for p, g, m, s in zip(net.arrays(), found, means, squares, strict=True):
            g = g * min(1.0, 1.0 / (long + 1e-12))
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


class Reader:
    """A network laid out for prediction: arrays of windows x units for each gate, so that all steps are over whole arrays."""

    def __init__(self, net: Network):
        u = self.units = net.within.shape[1]
        cut = lambda a: [np.ascontiguousarray(a[:, k * u : (k + 1) * u]) for k in range(3)]
        self.into, self.within, self.bias = [cut(net.into[w]) for w in (0, 1)], [cut(net.within[w]) for w in (0, 1)], 0.5 * net.bias
        for w in (0, 1):
            self.within[w][2] *= 0.5  # a gate is half of one and a share; the half of r is taken here
        self.out, self.base = [np.ascontiguousarray(net.out[:u].T), np.ascontiguousarray(net.out[u:].T)], net.base[:, None]

    def sums(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages): log-probabilities summed over the bytes of each window."""
        u, n, steps = self.units, len(windows), windows.shape[1]
        turned = np.ascontiguousarray(windows.T).astype(np.intp)
        logits = np.repeat(self.base, steps * n, axis=1).reshape(-1, steps, n)
        r, z, c, x, size = (np.empty((n, u), np.float32) for _ in range(5))
        for way in (0, 1):
            h = np.zeros((n, u), np.float32)
            into, within, out = self.into[way], self.within[way], self.out[way]
            bias = np.repeat(self.bias[way][None, :], n, axis=0)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                for k, gate in enumerate((r, z)):
                    np.matmul(h, within[k], out=gate)
                    gate += np.take(into[k], turned[t], axis=0, out=x, mode="clip")
                    np.abs(gate, out=size)
                    size += 1
                    gate /= size
                    gate += 1
                np.matmul(h, within[2], out=c)
                c += bias
                c *= r
                c += np.take(into[2], turned[t], axis=0, out=x, mode="clip")
                np.abs(c, out=size)
                size += 1
                c /= size
                h -= c
                h *= z
                h *= 0.5
                h += c
                logits[:, t] += out @ h.T
        logits -= logits.max(axis=0)
        logits -= np.log(np.exp(logits).sum(axis=0))
        logits *= turned != PAD
        return logits.sum(axis=1).T.astype(np.float64)


def windows_of(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """The bytes as rows of ``length``, the last one padded; no rows for no bytes."""
    n = -(-len(raw) // length)
    out = np.full(n * length, PAD, dtype=np.int16)
    out[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, length)


def document_scores(reader: Reader, texts: list[str | None], n_languages: int) -> tuple[list[int], list[float]]:
    """Language number (-1: no letter) and probability of each text."""
    raws = [(t or "").encode("utf-8", "replace") if any(map(str.isalpha, t or "")) else b"" for t in texts]
    total = np.zeros((len(texts), n_languages))
    at = 0
    while at < len(raws):
        stop, size = at, 0
        while stop < len(raws) and (stop == at or size + len(raws[stop]) <= GATHERED):
            size += len(raws[stop])
            stop += 1
        # A text longer than the rest of a piece is read in pieces of its own.
        owner, rows, waiting = [], [], 0
        for k in range(at, stop):
            for cut in range(0, len(raws[k]), GATHERED // LENGTH * LENGTH):
                own = windows_of(raws[k][cut : cut + GATHERED // LENGTH * LENGTH])
                owner.append(np.full(len(own), k))
                rows.append(own)
                waiting += own.size
                if waiting >= GATHERED:
                    add_scores(reader, total, owner, rows)
                    owner, rows, waiting = [], [], 0
        add_scores(reader, total, owner, rows)
        at = stop
    lengths = np.array([max(1, len(r)) for r in raws])
    logs = log_softmax(total / lengths[:, None])
    best = logs.argmax(axis=1)
    known = [len(r) > 0 for r in raws]
    return [int(b) if k else -1 for b, k in zip(best, known, strict=True)], [float(np.exp(logs[i, b])) if known[i] else 0.0 for i, b in enumerate(best)]


def add_scores(reader: Reader, total: np.ndarray, owner: list[np.ndarray], rows: list[np.ndarray]) -> None:
    if not rows:
        return
    who, windows = np.concatenate(owner), np.concatenate(rows)
    for k in range(0, len(windows), TOGETHER):
        np.add.at(total, who[k : k + TOGETHER], reader.sums(windows[k : k + TOGETHER]))


def held_out():
    """crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_windows(docs: DataFrame, texts: int = TEXTS, windows: int = WINDOWS, length: int = LENGTH) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and their languages' numbers, of at most ``texts`` texts of each language and ``windows`` of each.

    Texts are drawn by a hash of text and doc_id, windows at places drawn by that hash; texts without letters and held-out
    rows are left out.  Windows are cut in the tasks, so the driver gets texts x windows x length bytes of each language.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text", F.col("doc_id").cast("string")).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # Twice the share that is needed, so that the ranking below has few rows.
    share = F.least(F.lit(1.0), F.lit(2.0 * texts) / F.col("n"))
    some = rows.join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "lang").where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))
    order = W.partitionBy("lang").orderBy("h", F.length("text"))
    drawn = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= texts).select("lang", "text", "h")

    def run(batches):
        for batch in batches:
            lang, found = [], []
            for name, text, h in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "h")), strict=True):
                raw = text.encode("utf-8", "replace")
                whole = -(-len(raw) // length)
                rng = np.random.default_rng(h & (2**63 - 1))
                for k in sorted(rng.choice(whole, min(whole, windows), replace=False).tolist()):
                    lang.append(name)
                    found.append(raw[k * length : (k + 1) * length])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(found, pa.binary())], names=["lang", "w"])

    gathered = sorted((r["lang"], bytes(r["w"])) for r in drawn.mapInArrow(run, "lang string, w binary").collect())
    languages = sorted({name for name, _ in gathered})
    number = {name: k for k, name in enumerate(languages)}
    cut = np.concatenate([windows_of(w, length) for _, w in gathered]) if gathered else np.zeros((0, length), np.int16)
    return languages, cut, np.array([number[name] for name, _ in gathered], dtype=np.int64)


def identify(docs: DataFrame, texts: int = TEXTS, windows: int = WINDOWS, seed: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang).

    Learns at most ``texts`` texts of each language among rows that aren't held out and have a lang.  ``lang_pred`` is a
    learnt language, ``und`` with score 0 for null and empty texts and texts without a letter, and for all texts where
    nothing can be learnt; where one language is known, every other text has it with score 1.  Rows whose doc_id is null aren't held
    out.  Repeated rows each give a row; other columns are ignored.
    """
    languages, found, labels = sample_windows(docs, texts, windows)
    net = train(found, labels, languages, seed=seed) if languages else None
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        reader = Reader(net) if net else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                own = rows.column("text").to_pylist()
                best, score = document_scores(reader, own, len(languages)) if reader else ([-1] * len(own), [0.0] * len(own))
                names = [languages[b] if b >= 0 else UNKNOWN for b in best]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)
