"""Toxicity by class-conditional Kneser-Ney models.

For each class (toxic, ordinary) a word's probability is its continuation count in the class (of how many distinct pairs it
is the second word), discounted; what the discounts take goes to one continuation distribution that both classes share, so
that rare expressions are smoothed alike in both. Pairs of words stand above that: their discounted share among the pairs
with the same first word, and the rest to the words. Class counts come from a bounded sample of labelled documents; the
shared counts, the number of distinct words before each word, are exact and come from all words of all documents, as a table
that grows with them. A text's length-normalised log-likelihoods are compared: the mean, over its words, of the ratio of a
toxic text's likelihood, which takes a share of its words from the toxic model, to that of an ordinary text. That share and
the weight of pairs are the ones that explain labelled texts best that the models have not seen, and these also fit the
logistic curve that turns the mean and the text's length, by which means vary, into a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, column, lean, text_buffers
from .folds import training_labels
from .words import ALNUM_WORDS, MULTIPLIERS, U, mix

#: Most labelled documents that are learned from; a quarter of them fits the curve only.
LABELLED = 20_000
#: What a class has up to this often (contexts of a word, occurrences of a pair) is left to the backoff.
DISCOUNT = 2.0
#: Pairs that a task holds to leave out repeated ones; bytes of text whose pairs a bucket counts; buckets of one word's pairs.
HELD, BUCKET, SPLIT = 1 << 21, 12 << 20, 4
#: Shares of a toxic text's words that the toxic model gives, and weights of pairs, to choose from.
SHARES, WEIGHTS = (0.1, 0.02, 0.005, 0.001), (0.0, 0.25, 1.0)
_EVIDENCE = [f"e{i}" for i in range(len(SHARES) * len(WEIGHTS) + 1)]


def _hashed(texts: pa.Array):
    data, offsets = text_buffers(texts)
    for lo, hi in chunks(offsets):
        offs, raw = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]].copy()
        # letters of Latin-1 are lower-cased too: in UTF-8 their second byte follows 0xC3
        large = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        raw[large] += 0x20
        _, _, hashes, first = ALNUM_WORDS(raw, offs)
        yield lo, hi, hashes, first


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the word before each word, hash of both); a text's first word follows the empty word, 0."""
    before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1])) if len(hashes) else hashes
    before = before.copy()
    before[first[:-1][np.diff(first) > 0]] = 0
    return before, mix(before * MULTIPLIERS[4] + hashes * MULTIPLIERS[5])


def _counts(batches):
    """Rows (text, label) of labelled documents -> rows (pair, before, word, toxic, n): pairs of a word and the one before it."""
    for batch in batches:
        labels = column(batch, "label").to_numpy(zero_copy_only=False)
        for lo, hi, hashes, first in _hashed(column(batch, "text")):
            label = np.repeat(labels[lo:hi], np.diff(first))
            before, pairs = _pairs(hashes, first)
            for toxic in (0, 1):
                some = label == toxic
                values, at, n = np.unique(pairs[some], return_index=True, return_counts=True)
                cols = [pa.array(x.view(np.int64)) for x in (values, before[some][at], hashes[some][at])]
                yield pa.record_batch([*cols, pa.array(np.full(len(values), toxic)), pa.array(n)], ["pair", "before", "word", "toxic", "n"])


def _short(words: np.ndarray) -> np.ndarray:
    """48 bits of a word's hash, which name it in blobs."""
    return words >> U(16)


def _blobs(words: np.ndarray, before: np.ndarray, buckets: int):
    """(bucket, blob) of distinct pairs of short words and words before. A word's pairs go to SPLIT buckets by the word before, so
    that none holds all of a frequent word's; a blob has each word once (6 bytes), how many pairs follow (1), and 40 bits of each
    word before."""
    bucket = (words % U(buckets) + before % U(SPLIT)) % U(buckets)
    order = np.argsort((bucket << U(44)) | (words >> U(4)))
    bucket, words, rest = bucket[order], words[order], ((before // U(SPLIT)) & U((1 << 40) - 1))[order]
    at = np.arange(len(words))
    turn = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (words[1:] != words[:-1]))) if len(words) else at > 0
    turn |= (at - np.maximum.accumulate(np.where(turn, at, 0))) % 0xFF == 0
    entry = np.flatnonzero(turn)
    count = np.diff(np.append(entry, len(words))).astype(np.uint8)
    names = np.ascontiguousarray(words[entry].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    rest = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(words) else at
    last = np.append(first[1:], len(words))
    for b, lo, hi, x, y in zip(bucket[first].tolist(), first.tolist(), last.tolist(), np.searchsorted(entry, first).tolist(), np.searchsorted(entry, last).tolist(), strict=True):
        yield b, b"".join((np.array([y - x], "<u4").tobytes(), names[x:y].tobytes(), count[x:y].tobytes(), rest[lo:hi].tobytes()))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(short words, words before but for what the bucket tells) of a blob."""

    def wide(n, bytes_, at):
        out = np.zeros((n, 8), np.uint8)
        out[:, :bytes_] = np.frombuffer(blob, np.uint8, n * bytes_, at).reshape(n, bytes_)
        return out.view("<u8")[:, 0]

    n = int(np.frombuffer(blob, "<u4", 1)[0])
    count = np.frombuffer(blob, np.uint8, n, 4 + 6 * n)
    return np.repeat(wide(n, 6, 4), count), wide(int(count.sum()), 5, 4 + 7 * n)


def _continuations(buckets: int, most: int = HELD):
    """Rows (text) -> rows (bucket, blob): pairs of a word and the one before it, without most of the repeated ones."""

    def united(held):
        words, before = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        at = np.unique(mix(before * MULTIPLIERS[4] + words * MULTIPLIERS[5]), return_index=True)[1]
        return words[at], before[at]

    def made(pairs):
        rows = list(_blobs(*pairs, buckets))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, hashes, first in _hashed(column(batch, "text")):
                held.append((_short(hashes), _pairs(hashes, first)[0]))
                size += len(hashes)
                if size > most:
                    held = [united(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield made(held[0])
                        held, size = [], 0
        if size:
            yield made(united(held))

    return run


def _counted(batches):
    """Rows (bucket, blob) in the order of buckets -> rows (word, n): the distinct pairs of each short word in a bucket."""

    def flush(blobs):
        words, rest = (np.concatenate(x) for x in zip(*map(_unblob, blobs), strict=True))
        new = np.unique(mix(rest * MULTIPLIERS[4] + words * MULTIPLIERS[5]), return_index=True)[1]
        values, n = np.unique(words[new], return_counts=True)
        return pa.record_batch([pa.array(values.view(np.int64)), pa.array(n)], ["word", "n"])

    bucket, blobs = None, []
    for batch in batches:
        for b, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "blob").to_pylist(), strict=True):
            if b != bucket and blobs:
                yield flush(blobs)
                blobs = []
            bucket = b
            blobs.append(blob)
    if blobs:
        yield flush(blobs)


class Model:
    """Log-likelihood ratios, toxic to ordinary, over hashed words.

    words: sorted hashes; ratio, mass: their own ratios and those of the backoff after them; unknown: the ratio of words that
    neither class has; pairs, pair_ratio: the pairs that a class has, sorted, and their ratios.
    """

    def __init__(self, words, ratio, mass, unknown, pairs, pair_ratio):
        self.words, self.ratio, self.mass, self.unknown, self.pairs, self.pair_ratio = words, ratio, mass, unknown, pairs, pair_ratio

    def ratios(self, hashes: np.ndarray, first: np.ndarray, weights=(1.0,)) -> list[np.ndarray]:
        """For each weight of pairs the ratio of each word after the word before it."""
        if not len(self.words) or not len(hashes):
            return [np.full(len(hashes), self.unknown)] * len(weights)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        alone = np.where(known, self.ratio[at], self.unknown)
        if not any(weights):
            return [alone] * len(weights)
        after = np.concatenate(([0.0], np.where(known, self.mass[at], 0.0)[:-1]))
        after[first[:-1][np.diff(first) > 0]] = 0.0
        both = alone + after
        if len(self.pairs):
            pair = _pairs(hashes, first)[1]
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            both = np.where(self.pairs[where] == pair, self.pair_ratio[where], both)
        return [alone + w * (both - alone) for w in weights]

    def evidence(self, hashes: np.ndarray, first: np.ndarray, shares, weights) -> np.ndarray:
        """For each text, weight and share the mean log-likelihood ratio of a word, 0 without words; last how much means vary."""
        size = len(first) - 1
        doc, n = np.repeat(np.arange(size), np.diff(first)), np.maximum(np.diff(first), 1)
        means = [np.bincount(doc, np.log1p(s * np.expm1(r)), size) / n for r in self.ratios(hashes, first, weights) for s in shares]
        return np.stack([*means, 1 / np.sqrt(n)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; with one class only, a constant."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 4.0 * (float(y.mean()) - 0.5) * 2 if len(y) else -4.0
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _evidence(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            e = [model.evidence(hashes, first, SHARES, WEIGHTS) for _, _, hashes, first in _hashed(column(batch, "text"))]
            if e:
                yield pa.record_batch([column(batch, "label"), *(pa.array(c) for c in np.concatenate(e).T)], ["label", *_EVIDENCE])

    return run


def _score(shared, curve, text: str, filtered: bool):
    """The scores of a batch's rows, or with `filtered` its rows that score below 0.5."""
    share, weight, *line = curve

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, hashes, first in _hashed(column(batch, text)):
                z = model.evidence(hashes, first, (share,), (weight,)) @ line[:2] + line[2]
                scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
            score = np.concatenate(scores)
            yield batch.filter(pa.array(score < 0.5)) if filtered else pa.record_batch([column(batch, "doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def choose(seen: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """(share, weight of pairs, slopes of the mean and of its spread, level) under which the labels y are likeliest; of equals the first."""
    best = None
    for i, (weight, share) in enumerate((w, s) for w in WEIGHTS for s in SHARES):
        x = seen[:, [i, -1]]
        mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(2), np.ones(2))
        *slopes, level = fit_curve(np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), 1), y)
        slopes = slopes / scale
        level = float(level - slopes @ mean)
        z = np.clip(x @ slopes + level, -35, 35)
        loss = float(np.logaddexp(0, np.where(y > 0, -z, z)).sum())
        if best is None or loss < best[0] - 1e-9:
            best = loss, (share, weight, *map(float, slopes), level)
    return best[1]


def _ratio(toxic, ordinary):
    return F.log(toxic / ordinary)


def _collected(df: DataFrame, key: str, *names: str) -> list[np.ndarray]:
    """Columns of a bounded table in the order of its 64-bit key, fetched in slices, so that the driver holds each row about once."""
    n, at, kinds = df.count(), 0, dict(df.dtypes)
    out = [np.empty(n, np.uint64), *(np.empty(n, np.float32 if kinds[c] == "float" else float) for c in names)]
    for k in range(8):
        table = df.where(F.shiftrightunsigned(key, 61) == k).select(key, *names).toArrow()
        value = table[key].to_numpy().view(np.uint64)
        order = np.argsort(value)
        for column_, values in zip(out, (value, *(table[c].to_numpy() for c in names)), strict=True):
            column_[at : at + len(order)] = values[order]
        at += len(order)
    return out


def models(docs: DataFrame, labels: DataFrame, label: str, labelled: int, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The Model of both classes from docs (doc_id, text) and labels (doc_id, label), and the labelled texts left for the curve."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # pairs of all documents, packed: one blob for each bucket of a block of texts
    buckets = min(1 << 20, max(16, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET)))
    met = docs.select("text").mapInArrow(lean(_continuations(buckets)), "bucket long, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    met = met.mapInArrow(lean(_counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    met = scratch.write(met, "continuations")
    scratch.free_shuffles()
    whole = met.agg(F.coalesce(F.sum("n"), F.lit(0)) + F.count(F.lit(1))).first()[0]
    known = training_labels(labels, label, labelled)
    known = scratch.write(known.withColumn("curve", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0), "labels")
    train = docs.join(F.broadcast(known), "doc_id")  # at most `labelled` rows
    train = scratch.write(train.select("text", "label", "curve"), "train")
    counts = train.where("not curve").select("text", "label").mapInArrow(lean(_counts), "pair long, before long, word long, toxic long, n long")
    side = lambda c, x: F.sum(F.when(F.col("toxic") == c, x).otherwise(0))
    counts = counts.groupBy("pair", "before", "word").agg(side(1, F.col("n")).alias("t"), side(0, F.col("n")).alias("o"))
    counts = scratch.write(counts, "counts")
    scratch.free_shuffles()

    # p_t and p_o: the words' probabilities; mass: what pairs leave to them; k_t and k_o: the pairs' own
    ends = counts.groupBy("word").agg(F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o"))
    words = ends.join(met.withColumnRenamed("word", "short"), F.shiftrightunsigned("word", 16) == F.col("short"))
    words = scratch.write(words.select("word", "t", "o", ((F.col("n") + 1.0) / max(whole, 1)).alias("shared")), "ends")
    taken = lambda c: F.coalesce(F.sum(F.least(F.col(c), F.lit(DISCOUNT))) / F.sum(c), F.lit(1.0))
    total = words.select(*(F.coalesce(F.greatest(F.sum(c), F.lit(1)), F.lit(1)).alias(c) for c in "to"), taken("t").alias("l_t"), taken("o").alias("l_o")).first()
    p = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / float(total[c]) + F.lit(total[f"l_{c}"]) * F.col("shared")
    words = scratch.write(words.select("word", p("t").alias("p_t"), p("o").alias("p_o")), "words")
    scratch.free_shuffles()
    pairs = counts.where("before <> 0")  # a text's first word has no word before it
    kept = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    after = pairs.groupBy(F.col("before").alias("context")).agg(F.sum("t").alias("n_t"), F.sum("o").alias("n_o"), F.sum(kept("t")).alias("a_t"), F.sum(kept("o")).alias("a_o"))
    mass = lambda c: F.when(F.col(f"n_{c}") > 0, 1.0 - F.col(f"a_{c}") / F.col(f"n_{c}")).otherwise(1.0)
    after = scratch.write(after.select("context", "n_t", "n_o", mass("t").alias("m_t"), mass("o").alias("m_o")), "contexts")
    both = lambda c: F.coalesce(kept(c) / F.nullif(F.col(f"n_{c}"), F.lit(0)), F.lit(0.0)) + F.col(f"m_{c}") * F.col(f"p_{c}")
    # the sample's words, with no more rows than the model that is broadcast below; its pairs are many more and stay where they are
    pairs = pairs.join(F.broadcast(words), "word").join(F.broadcast(after), F.col("before") == F.col("context")).select("pair", _ratio(both("t"), both("o")).cast("float").alias("ratio"))
    pairs = scratch.write(pairs, "pairs")
    words = words.join(after, F.col("word") == F.col("context"), "left").select("word", _ratio(F.col("p_t"), F.col("p_o")).alias("ratio"), F.coalesce(_ratio(F.col("m_t"), F.col("m_o")), F.lit(0.0)).alias("mass"))
    scratch.free_shuffles()

    model = Model(*_collected(words, "word", "ratio", "mass"), float(np.log(total["l_t"] / total["l_o"])), *_collected(pairs, "pair", "ratio"))
    scratch.drop("labels", "counts", "continuations", "ends", "words", "contexts", "pairs")
    return model, train.where("curve").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED):
    """The broadcast Model and its curve, from docs (doc_id, text) and labels (doc_id, label)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    model, left = models(docs, labels, label, labelled, scratch)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's words and pairs
    seen = left.mapInArrow(lean(_evidence(shared)), "label int, " + ", ".join(f"{e} double" for e in _EVIDENCE)).toPandas()
    seen = seen.sort_values(list(seen.columns))
    curve = choose(seen[_EVIDENCE].to_numpy(float), seen["label"].to_numpy(float))
    scratch.drop("train")
    if curve[1] == 0:  # pairs do not count: send the words alone
        shared.unpersist()
        none = np.zeros(0)
        shared = spark.sparkContext.broadcast(Model(model.words, model.ratio, model.mass, model.unknown, none.astype(np.uint64), none))
    return shared, curve


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score in (0, 1), higher: label 1 likelier.

    One row for each row of docs. Null and empty texts get the score that no evidence gives.
    Without labels, or with one class only, every score is one constant. Labels that are null or not 0 or 1 are ignored,
    and so are other columns. Held-out ids are never learned from.
    """
    shared, curve = fit(docs, labels, label, labelled)
    key = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_score(shared, curve, "text", False)), f"doc_id {key}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """The rows of docs whose score is below 0.5, all columns kept."""
    shared, curve = fit(docs, labels, label, labelled)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")]
    rows = docs.toDF(*names)
    return rows.mapInArrow(lean(_score(shared, curve, text, True)), rows.schema).toDF(*docs.columns)
