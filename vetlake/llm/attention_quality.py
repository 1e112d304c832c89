"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage is encoded by its own shape: shares of kinds of characters,
lengths of words, how much of it repeats, and hashed words. A gated attention, w . (tanh(V h) * sigmoid(U h)), is learned
from document labels alone together with the passage layer h and the score of the attention-weighted mean of a text's
passages. Training is on a bounded sample of labelled documents; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, column, lean, text_buffers
from .folds import training_labels
from .words import U, WHITE_WORDS, grams

PASSAGE = 64
#: Most labelled documents that are learned from, hashed word features, sizes of the passage layer and of the attention.
LABELLED, HASHED, HIDDEN, GATES = 6000, 8, 16, 8
_KINDS = [
    np.array([chr(b).isupper() and b < 128 for b in range(256)]),
    np.array([chr(b).islower() and b < 128 for b in range(256)]),
    np.array([48 <= b < 58 for b in range(256)]),
    np.array([chr(b) in "#*$%&<>" for b in range(256)]),
    np.array([chr(b) == "|" for b in range(256)]),
    np.array([chr(b) == "!" for b in range(256)]),
    np.array([chr(b) in ".,;:?'\"()-" for b in range(256)]),
    np.array([b >= 128 for b in range(256)]),
    np.array([b == 10 for b in range(256)]),
]
N_FEATURES = len(_KINDS) + 8 + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text). A text without words is one passage of zeros."""
    starts, ends, hashes, first = WHITE_WORDS(data, offsets)
    n_words = np.diff(first)
    counts = np.maximum(1, -(-n_words // PASSAGE))
    text = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    lo = np.minimum(first[text] + nth * PASSAGE, first[text + 1])
    hi = np.minimum(lo + PASSAGE, first[text + 1])
    size = hi - lo
    some = size > 0
    out = np.zeros((len(text), N_FEATURES))
    if not some.any():
        return out, counts
    # bytes of a passage: from its first word to the next passage's or the text's end
    begin = starts[np.minimum(lo, len(starts) - 1)]
    stop = np.where(hi < first[text + 1], starts[np.minimum(hi, len(starts) - 1)], offsets[text + 1])
    length = np.where(some, stop - begin, 1)

    def per_byte(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return np.where(some, total[stop] - total[begin], 0)

    def per_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values)))
        return np.where(some, total[hi] - total[lo], 0.0)

    for i, kind in enumerate(_KINDS):
        out[:, i] = per_byte(kind[data]) / length
    word = np.repeat(np.arange(len(text)), size)  # each word's passage: passages follow one another
    lengths = (ends - starts).astype(float)
    n = np.maximum(size, 1)
    mean = per_word(lengths) / n
    order = np.lexsort((hashes, word))
    w, h = word[order], hashes[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])))
    distinct = np.bincount(w[new], minlength=len(text))
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (word[1:] == word[:-1])))
    triples = grams(hashes, 3)
    inside = np.flatnonzero(word[: len(triples)] == word[2:]) if len(triples) else np.zeros(0, np.int64)
    tw, th = word[inside], triples[inside]
    order = np.lexsort((th, tw))
    tw, th = tw[order], th[order]
    fresh = np.concatenate(([True], (tw[1:] != tw[:-1]) | (th[1:] != th[:-1]))) if len(tw) else np.zeros(0, bool)
    distinct3 = np.bincount(tw[fresh], minlength=len(text))
    all3 = np.bincount(tw, minlength=len(text))
    k = len(_KINDS)
    out[:, k] = mean / 10
    out[:, k + 1] = np.sqrt(np.maximum(per_word(lengths**2) / n - mean**2, 0)) / 10
    out[:, k + 2] = distinct / n
    out[:, k + 3] = per_word(same) / n
    out[:, k + 4] = np.where(all3 > 0, 1 - distinct3 / np.maximum(all3, 1), 0)
    out[:, k + 5] = np.log1p(size) / np.log1p(PASSAGE)
    out[:, k + 6] = per_word(lengths <= 3) / n
    out[:, k + 7] = np.log1p(n_words[text]) / 10
    for j in range(HASHED):
        sign = 1.0 - 2.0 * ((hashes >> U(j)) & U(1)).astype(float)
        out[:, k + 8 + j] = per_word(sign) / n
    out[~some] = 0
    return out, counts


def _encode(texts: pa.Array):
    data, offsets = text_buffers(texts)
    for lo, hi in chunks(offsets):
        yield lo, hi, *passages(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    """Passage layer, gated attention and score; `forward` also returns what `gradients` needs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        n = len(mean)
        small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": small(n, HIDDEN), "b": np.zeros(HIDDEN), "V": small(HIDDEN, GATES), "U": small(HIDDEN, GATES), "w": small(GATES), "c": small(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, counts: np.ndarray):
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        p, starts = self.p, np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return _sigmoid(z @ p["c"] + p["d"]), (x, bag, starts, h, v, u, a, z)

    def gradients(self, y: np.ndarray, out: np.ndarray, kept, weight: np.ndarray) -> dict[str, np.ndarray]:
        x, bag, starts, h, v, u, a, z = kept
        p = self.p
        g = weight * (out - y) / weight.sum()
        gz = g[:, None] * p["c"]
        ga = (gz[bag] * h).sum(1)
        gs = a * (ga - np.add.reduceat(a * ga, starts)[bag])
        gvu = gs[:, None] * p["w"]
        gv, gu = gvu * u * (1 - v**2), gvu * v * u * (1 - u)
        gh = (a[:, None] * gz[bag] + gv @ p["V"].T + gu @ p["U"].T) * (1 - h**2)
        return {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gv, "U": h.T @ gu, "w": (v * u).T @ gs, "c": z.T @ g, "d": np.array([g.sum()])}


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.03) -> Model:
    """Adam on the whole sample; a little weight decay."""
    scale = x.std(0)
    model = Model(x.mean(0), np.where(scale > 1e-9, scale, 1.0))
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    weight = np.ones(len(y))
    for t in range(1, steps + 1):
        out, kept = model.forward(x, counts)
        step = rate * min(1.0, 3 * (1 - t / (steps + 1)))
        for k, g in model.gradients(y, out, kept, weight).items():
            g = g + 1e-4 * model.p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            model.p[k] -= step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _features(batches):
    for batch in batches:
        for lo, hi, x, counts in _encode(column(batch, "text")):
            flat, ends = x.astype(np.float32), np.concatenate(([0], np.cumsum(counts)))
            yield pa.record_batch([column(batch, "label").slice(lo, hi - lo), pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["label", "x"])


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, x, counts in _encode(column(batch, "text")):
                scores.append(model.forward(x, counts)[0])
            yield pa.record_batch([column(batch, "doc_id"), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED):
    """The broadcast Model, learned from at most `labelled` rows of labels that are not held out."""
    spark = docs.sparkSession
    known = Scratch(spark, "quality").write(training_labels(labels, label, labelled), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("label", "text")  # at most `labelled` rows
    seen = rows.mapInArrow(lean(_features), "label int, x binary").toPandas()
    if not len(seen):
        return spark.sparkContext.broadcast(Model(np.zeros(N_FEATURES), np.ones(N_FEATURES)))
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in seen["x"]]
    order = sorted(range(len(bags)), key=lambda i: seen["x"][i])  # the sum's order doesn't depend on the partitions
    x = np.concatenate([bags[i] for i in order]).astype(float)
    return spark.sparkContext.broadcast(train(x, np.array([len(bags[i]) for i in order]), seen["label"].to_numpy(float)[order]))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score in (0, 1), higher: label 1 likelier.

    One row for each row of docs, over its whole text; null and empty texts are one empty passage. Without labels the
    score comes from an untrained model. Labels that are null or not 0 or 1 and other columns are ignored, and held-out ids
    are never learned from.
    """
    shared = fit(docs, labels, label, labelled)
    key = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_score(shared)), f"doc_id {key}, score double")
