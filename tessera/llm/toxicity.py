"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams, skip-grams and stems."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORDS, append_columns, crc_mod, hash_words, least_hashed, mix, odd_constants, split_words, staged, translated

BITS = 20
#: Labelled rows that a model is fitted on at most, those whose hash is least: a documented bound.
FIT_ROWS = 8192
#: Distinct features of those rows that the driver takes at most (4 bytes each): very long texts make the sample smaller.
FIT_FEATURES = 1 << 24
THRESHOLD = 0.7
#: Letters of the stems that longer words are known by as well, and how often a step is taken for each toxic row, as they
#: are few.
STEMS, WEIGHT = (4, 6, 8), 3
_MUL = odd_constants(4, 11)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hashed feature of each word, pair of neighbours and pair with one word between; a word of
    more letters than a length of STEMS has a feature for its first so many, which its inflected forms share."""
    first, codes, words = split_words(translated(texts, WORDS))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = hash_words(words)[codes] if len(words) else np.empty(0, dtype=np.uint64)
    parts = [(doc, mix(h * _MUL[0]))]
    for gap, m in ((1, _MUL[1]), (2, _MUL[2])):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append((doc[gap:][same], mix(h[:-gap] * m + h[gap:] * _MUL[3] + np.uint64(gap))[same]))
    letters = pc.utf8_length(words).to_numpy(zero_copy_only=False) if len(words) else np.empty(0)
    for n in STEMS:
        longer = letters > n
        if longer.any():
            stem = mix(hash_words(pc.utf8_slice_codeunits(words, 0, n), seed=n) * _MUL[0])
            has = longer[codes]
            parts.append((doc[has], stem[codes[has]]))
    return np.concatenate([p[0] for p in parts]), (np.concatenate([p[1] for p in parts]) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_features(texts: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    doc, f = features(texts, bits)
    pairs = np.unique((doc << bits) | f)
    cut = np.searchsorted(pairs, np.arange(len(texts) + 1) << bits)
    f = (pairs & ((1 << bits) - 1)).astype("<u4")
    return [f[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@dataclass
class Sparse:
    """Weights that L1 left: what is broadcast. Index 2^bits is the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = self.__dict__.get("_dense")
        if dense is None:
            dense = self.__dict__["_dense"] = np.zeros(1 << self.bits, dtype=np.float32)
            dense[self.index] = self.weight
        doc, f = features(texts, self.bits)
        hit = np.flatnonzero(dense[f])  # few features have a weight, so only these are made distinct
        pairs = np.unique((doc[hit] << self.bits) | f[hit])
        z = np.bincount(pairs >> self.bits, weights=dense[pairs & ((1 << self.bits) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -35, 35)))


class Ftrl:
    """FTRL-proximal for 0/1 features: each coordinate has its own rate, and L1 keeps most weights at zero."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.01):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)  # the bias isn't shrunk
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at.astype(np.int64), 1 << self.bits)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> Sparse:
        every = np.arange(1 << self.bits)
        w = self.weights(every)
        keep = np.flatnonzero(w)
        return Sparse(keep, w[keep].astype(np.float32), float(self.weights(np.array([1 << self.bits]))[0]), self.bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents outside the held-out fold, those with the least hashes.

    Null labels and ids are left out; where an id has several labels, the largest counts; null texts are as they are.
    The sample is of labels that have a document. Where several documents have an id, each is a row, and rows are then
    drawn by a hash of id and text, equal ones once; so the bound holds for rows, whatever repeats.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(crc_mod("id", folds) != held).groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = known.join(texts.select("id"), "id", "left_semi")
    known = staged(least_hashed(known, ["id"], rows), "labelled")  # the bound
    sample = texts.join(F.broadcast(known), "id").select("id", "text", "label")
    if texts.select("id").join(F.broadcast(known), "id").count() <= rows:
        return sample
    keyed = sample.withColumn("th", F.xxhash64("text"))
    drawn = staged(least_hashed(keyed.select("id", "th").distinct(), ["id", "th"], rows), "drawn")
    return keyed.join(F.broadcast(drawn), ["id", "th"], "left_semi").groupBy("id", "th", "label").agg(F.min("text").alias("text")).select("id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, epochs: int = 12, bits: int = BITS, most: int = FIT_FEATURES, **names) -> Sparse:
    """A model of the labelled documents outside the held-out fold; the fit is on the driver, on `rows` rows at most, of
    `most` distinct features in all.

    Null and empty texts are rows without features; whole texts are read; repeated rows count as labelled_sample says;
    without labelled rows all scores are one half; other columns are ignored.
    """
    sample = labelled_sample(docs, labels, label, rows, **names)
    held = append_columns(sample, ["text"], [T.StructField("f", T.BinaryType())], lambda: lambda t: [[x.tobytes() for x in distinct_features(t, bits)]])
    held = staged(held.select("id", "label", "f", F.octet_length("f").alias("n"), F.xxhash64("id", "f").alias("h")), "features")
    sizes = sorted((r["h"], r["id"], r["n"]) for r in held.select("h", "id", "n").collect())  # `rows` rows
    total, past = 0, None
    for h, _, n in sizes:
        total += n
        if total > 4 * most:
            past = h
            break
    if past is not None:
        held = held.where(F.col("h") < past)
    got = sorted((r["id"], r["label"], bytes(r["f"])) for r in held.select("id", "label", "f").collect())
    made = Ftrl(bits)
    rng = np.random.default_rng(17)
    seen = np.zeros(1 << bits, dtype=np.int32)
    for _, _, f in got:
        seen[np.frombuffer(f, dtype="<u4")] += 1
    # a feature of one row says nothing of other rows
    each = [(f[seen[f] > 1], label) for f, label in ((np.frombuffer(f, dtype="<u4"), label) for _, label, f in got)]
    for _ in range(epochs):
        for i in rng.permutation(len(each)):
            for _ in range(WEIGHT if each[i][1] else 1):
                made.learn(*each[i])
    return made.sparse()


def score(docs: DataFrame, model: Sparse, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs (all rows and columns) with score (double, 0 to 1) and predicted (int, 1 from the threshold on).

    Whole texts are read; null and empty ones get the score of the bias alone; repeated rows get equal scores; columns
    of docs named score or predicted are replaced. A score depends on the text alone, and nothing is shuffled: the
    broadcast model has the weights that L1 left.
    """
    known = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias, model.bits))

    def make():
        m = Sparse(*known.value)

        def work(texts):
            s = m.scores(texts)
            return [s, (s >= threshold).astype(np.int32)]

        return work

    return append_columns(docs, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
