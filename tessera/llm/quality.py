"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import append_columns, hash_words, mix, partitions, pieces_of, split_words, sum_blocks, tidy
from tessera.llm.toxicity import FIT_ROWS, labelled_sample

#: Rows of word vectors (tokens are hashed to them), their width, and the non-zeros of an index vector.
ROWS, DIM, NONZERO = 1 << 13, 64, 4
WINDOW = 2
BLOCKS = 32
#: Bytes of text that are pooled at a time.
SLICE = 1 << 20
_PIECES = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff]+")
#: Tokens beside words and signs: before a word in capitals, after a word that says the one before again.
CAPITALS, AGAIN = "\x01capitals", "\x01again"


def index_vectors(rows: int = ROWS, dim: int = DIM, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's random index vector isn't zero, and the signs there; both follow from the row's number."""
    x = mix(np.arange(rows * nonzero, dtype=np.uint64) + np.uint64(0x51ED27))
    return (x % np.uint64(dim)).astype(np.int64).reshape(rows, nonzero), np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(rows, nonzero)


def _row(h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(ROWS)).astype(np.int64)


def _rows_of(words: list[str]) -> np.ndarray:
    return _row(hash_words(pa.array(words, pa.string())))


def token_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First token of each text (and the end), and the row of each token.

    Texts are cut at white space, and then into runs of letters and digits, in lower case, and runs of signs; a token of
    its own says that a word has two capitals or more and no small letter, another that a word is said again. So case,
    signs and repetition have vectors like any word, and count by these alone.
    """
    first, codes, words = split_words(pc.fill_null(texts, ""))
    if not len(words):
        return first, np.empty(0, dtype=np.int64)
    tokens, sizes = [], []
    for w in words.to_pylist():
        at = len(tokens)
        for piece in _PIECES.findall(w.encode()):
            said = piece.decode("utf-8", "replace")
            if len(said) > 1 and said.isupper():
                tokens.append(CAPITALS)
            tokens.append(said.lower())
        sizes.append(len(tokens) - at)
    of_word, size = _rows_of(tokens), np.array(sizes)
    start = np.cumsum(size) - size
    folded = pa.array([w.lower() for w in words.to_pylist()], pa.string()).dictionary_encode().indices.to_numpy()[codes]
    again = np.zeros(len(codes), dtype=np.int64)
    again[1:] = folded[1:] == folded[:-1]
    again[first[:-1][first[:-1] < len(codes)]] = 0
    many = size[codes] + again
    ends = np.concatenate([[0], np.cumsum(many)])
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], many)
    rows = of_word[np.minimum(np.repeat(start[codes], many) + inside, len(of_word) - 1)]
    rows[(ends[1:] - 1)[again == 1]] = int(_rows_of([AGAIN])[0])
    return ends[first], rows


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(ROWS, DIM): for each row the sum of the index vectors of its tokens' neighbours, over all documents, at unit length.

    Each task sums its own, in whole numbers; the sums (of a fixed size) are added in levels. Null and empty texts add
    nothing; without documents all vectors are zero.
    """
    per = ROWS // BLOCKS

    @tidy
    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, sign = index_vectors()
        total = np.zeros(ROWS * DIM)
        for batch in batches:
            for b in pieces_of(batch, size=SLICE):
                first, rows = token_rows(b.column(0))
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for gap in range(1, WINDOW + 1):
                    if len(rows) <= gap:
                        continue
                    same = doc[gap:] == doc[:-gap]
                    left, right = rows[:-gap][same], rows[gap:][same]
                    pair, n = np.unique(left * ROWS + right, return_counts=True)
                    left, right = pair // ROWS, pair % ROWS
                    for a, c in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(a * DIM + where[c, k], weights=sign[c, k] * n, minlength=ROWS * DIM)
        total, part = total.reshape(ROWS, DIM), TaskContext.get().partitionId()
        for k in range(BLOCKS):
            met = np.flatnonzero(total[k * per : (k + 1) * per].any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([met.tobytes()], pa.binary()), pa.array([total[k * per + met].tobytes()], pa.binary())], names=["block", "part", "at", "data"])

    def read(at, data):
        return np.frombuffer(at, dtype=np.int32), np.frombuffer(data, dtype=np.float64).reshape(-1, DIM)

    texts = docs.select(text_col)
    summed = sum_blocks(texts.mapInArrow(gather, "block int, part int, at binary, data binary"), read, (per, DIM), partitions(texts))
    full = np.zeros((ROWS, DIM))
    for r in summed.collect():  # BLOCKS rows of a fixed size
        full[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(bytes(r["data"])).reshape(per, DIM)
    return (full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The vectors of the texts, a slice at a time, as each distinct token of a text takes a row of floats on the way."""
    parts = [_pooled(b.column(0), vectors) for b in pieces_of(pa.RecordBatch.from_arrays([texts], names=["t"]), size=SLICE)]
    return np.concatenate(parts)


def _pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A vector for each text: the means of its tokens' context vectors and of its tokens' index vectors."""
    first, rows = token_rows(texts)
    n, width = len(first) - 1, vectors.shape[1]
    size = np.diff(first)
    pair, count = np.unique(np.repeat(np.arange(n), size) * ROWS + rows, return_counts=True)
    d, r = pair // ROWS, pair % ROWS
    out = np.zeros((n, 2 * width))
    full = np.flatnonzero(size)
    if len(full):
        where, sign = index_vectors()
        out[full, :width] = np.add.reduceat(vectors[r] * count[:, None], np.searchsorted(d, full), axis=0)
        for k in range(NONZERO):
            out[:, width:] += np.bincount(d * width + where[r, k], weights=sign[r, k] * count, minlength=n * width).reshape(n, width)
        out[full] /= size[full, None]
    return out.astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, one hidden layer, and a temperature for the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    prior: float | None = field(default=None)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:  # no labels, or labels of one kind
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3, seed: int = 23) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature is the one that suits the other fifth."""
    if not len(y) or y.min() == y.max():
        return Network(*(np.zeros(1) for _ in range(5)), 0.0, prior=float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    rest, use = order[: len(y) // 5], order[len(y) // 5 :]
    net = Network(x[use].mean(0), x[use].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - net.mean) / net.scale
    par = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    for _ in range(epochs):
        for i in range(0, len(use), batch):
            at = rng.choice(use, min(batch, len(use)))
            h = np.tanh(z[at] @ par[0] + par[1])
            g = (1 / (1 + np.exp(-np.clip(h @ par[2] + par[3], -35, 35))) - y[at]) / len(at)
            back = g[:, None] * par[2] * (1 - h * h)
            t += 1
            for k, grad in enumerate((z[at].T @ back + decay * par[0], back.sum(0), h.T @ g + decay * par[2], np.array([g.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                par[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = par[0], par[1], par[2], float(par[3][0])
    if len(rest):
        logit, grid = net.logits(x[rest]), np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(y[rest] == 1, -logit, logit) / s).mean() for s in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, text_col: str = "text", **names) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and a network fitted on the driver to `rows` labelled rows at most, none held out.

    Null and empty texts are the zero vector; whole texts are read; repeated rows count as labelled_sample says; where
    labels are of one kind or none, every text gets their smoothed share; other columns are ignored.
    """
    vectors = word_vectors(docs, text_col)
    known = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = labelled_sample(docs, labels, label, rows, text_col=text_col, **names)
    held = append_columns(sample, ["text"], [T.StructField("x", T.BinaryType())], lambda: lambda t: [[r.tobytes() for r in pooled(t, known.value)]])
    got = sorted((r["id"], r["label"], bytes(r["x"])) for r in held.select("id", "label", "x").collect())
    x = np.array([np.frombuffer(g[2], dtype=np.float32) for g in got], dtype=np.float64).reshape(len(got), 2 * DIM)
    return vectors, fit(x, np.array([g[1] for g in got], dtype=np.float64))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs (all rows and columns) with score (double, 0 to 1) and predicted (int, 1 from the threshold on).

    Whole texts are read; null and empty ones get the score of the zero vector; equal texts get equal scores; columns
    of docs named score or predicted are replaced. Nothing is shuffled; the broadcast vectors have a fixed size.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        vectors, net = known.value

        def work(texts):
            # a text's score must not depend on what stands beside it in a batch
            s = np.round(net.probabilities(pooled(texts, vectors)).astype(np.float64), 9)
            return [s, (s >= threshold).astype(np.int32)]

        return work

    return append_columns(docs, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
