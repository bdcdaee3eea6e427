"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, crc_mod, hash_words, mix, odd_constants, partitions, pieces_of, split_words, staged, sum_blocks, tidy, translated

#: Branches of each softmax: the root's are the classes, theirs are classes again, and so on down to the words.
WIDTH = 16
#: Words that have places of their own and whose counts every task holds (20 bytes each); counts of other words are joined.
LOOKUP = 1 << 19
#: Weight rows at least (features are hashed to them), tokens of a gradient step, rounds of distributed training, the rate.
ROWS, STEP, ROUNDS, RATE = 1 << 16, 1 << 15, 2, 0.13
#: A weight row for so many distinct words, up to the most that the tasks' memory and the exchange of a round allow.
WORDS_A_ROW, MOST_ROWS = 2, 1 << 18
BLOCKS = 32
#: Tokens that a task of a round learns from at least, about, and tasks below which there may be fewer each: what the
#: tasks send is a model each at most, and so stays in proportion to the text.
TOKENS_A_TASK, LEAST_TASKS = 4 << 20, 8
#: Tasks tell what they changed in whole numbers of these parts, so that sums don't depend on the order of tasks.
PARTS = 1 << 12
#: Bytes of text whose features are in memory at a time (32 bytes a token, and as much for the way there).
SLICE = 2 << 20
#: Words beyond the lookup are told apart by their context by hash buckets: one for so many of them, and the most.
WORDS_A_BUCKET, MOST_BUCKETS = 32, 1 << 10
#: Decisions whose logits, and weight rows whose changes, are worked out at a time (64 bytes each).
CACHED = 4096
END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
FEATURES = 3
_MUL = odd_constants(8, 29)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token of each text (and the end), each token's code and the hash of each code; an end token closes a text."""
    first, codes, words = split_words(translated(texts, LOWER))
    n = len(first) - 1
    h = np.append(hash_words(words), END)
    out = np.full(len(codes) + n, len(h) - 1, dtype=np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(first))] = codes
    return first + np.arange(n + 1), out, h


def count_tokens(docs: DataFrame, text_col: str = "text", flush: int = 1 << 21) -> DataFrame:
    """(h, c): how often each token occurs, by its hash; each task adds up before the shuffle."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, more = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), []

        def merge():
            nonlocal keys, sums
            keys, back = np.unique(np.concatenate([keys, *(h for h, _ in more)]), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([sums, *(n for _, n in more)]), minlength=len(keys)).astype(np.int64)
            more.clear()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], names=["h", "c"])

        for batch in batches:
            for b in pieces_of(batch, size=SLICE):
                _, codes, h = token_hashes(b.column(0))
                n = np.bincount(codes, minlength=len(h))
                more.append((h[n > 0], n[n > 0]))
                if sum(len(h) for h, _ in more) > max(1 << 18, len(keys)):
                    merge()
                if len(keys) >= flush:
                    yield rows()
                    keys, sums = keys[:0], sums[:0]
        merge()
        if len(keys):
            yield rows()

    return docs.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, `most` at most: the bound of what is sent to the driver and to every task.

    The least count is found from a histogram of a few thousand rows, so nothing is sorted. Of the words of the last
    bucket of the histogram, which has more of them than there is room for, those of the least hashes are taken.
    """
    bucket, share = F.floor(F.log2("c") * 64).cast("int"), F.pmod(F.xxhash64("h"), F.lit(4096))
    total, least = 0, None
    for b, n in sorted(map(tuple, counts.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        if total + n > most:
            past = 0
            for s, n in sorted(map(tuple, counts.where(bucket == b).groupBy(share.alias("s")).count().collect())):
                total += n
                if total > most:
                    break
                past = s + 1
            return counts.where((bucket > b) | ((bucket == b) & (share < past)))
        total, least = total + n, b
    return counts.where(bucket >= least) if least is not None else counts.limit(0)


def power_of_two(n: float, least: int, most: int) -> int:
    """The power of two from n on, between two others."""
    return min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))))


def tree_of(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree of WIDTH branches: node and branch of each leaf, parent and branch of each node, masses (nodes, WIDTH).

    The root is the last node and has parent -1; a single leaf has no node (-1).
    """
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    made = -(-max(0, n - 1) // (WIDTH - 1))
    up, branch = np.full(n + made, -1, dtype=np.int32), np.zeros(n + made, dtype=np.int8)
    mass, value = np.zeros((made, WIDTH)), [*weights[order].tolist(), *[0.0] * made]
    leaf, node = 0, n  # the least leaf and the least node that have no parent
    for k in range(made):
        for j in range(2 + (n - 2) % (WIDTH - 1) if k == 0 else WIDTH):
            if leaf < n and (node >= n + k or value[leaf] <= value[node]):
                at, leaf = leaf, leaf + 1
            else:
                at, node = node, node + 1
            up[at], branch[at], mass[k, j] = k, j, value[at]
        value[n + k] = float(mass[k].sum())
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return up[:n][back], branch[:n][back], up[n:], branch[n:], mass


@dataclass
class Vocabulary:
    """The LOOKUP most frequent tokens: sorted hashes, counts and ranks; totals N and V of all training tokens.

    `tail` has the slots of each hash bucket of the words beyond: their counts, one more for each, and one for the unknown.
    Words and buckets are the leaves of one tree, whose nodes are classes of classes with a softmax each.
    """

    hashes: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    total: int
    distinct: int
    tail: np.ndarray | None = None

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, tail: np.ndarray | None = None) -> Vocabulary:
        """From hashes in falling order of counts."""
        order = np.argsort(hashes)
        return Vocabulary(hashes[order], counts[order].astype(np.int64), np.arange(len(hashes), dtype=np.int32)[order], total, distinct, tail)

    def __post_init__(self):
        by_rank = np.empty(len(self.counts), dtype=np.int64)
        by_rank[self.ranks] = self.counts
        if self.tail is None:
            self.tail = np.array([self.total - int(by_rank.sum()) + self.distinct - len(by_rank) + 1], dtype=np.float64)
        self.leaf_node, self.leaf_branch, self.parent, self.parent_branch, mass = tree_of(np.concatenate([by_rank, self.tail]))
        with np.errstate(divide="ignore"):
            self.node_bias = np.maximum(np.log(mass / mass.max(axis=1, keepdims=True)), -60).astype(np.float32) if len(mass) else np.zeros((0, WIDTH), dtype=np.float32)

    def leaves(self, h: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The leaf of each token: words by rank, then the buckets of the tail."""
        bucket = (h & np.uint64(len(self.tail) - 1)).astype(np.int64)
        return np.where(rank < 0, len(self.hashes) + bucket, rank)

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `leaf`, node, branch) of each decision from the leaves up to the root."""
        at, node, branch = np.arange(len(leaf)), self.leaf_node[leaf], self.leaf_branch[leaf]
        out = []
        while True:
            inner = node >= 0
            at, node, branch = at[inner], node[inner], branch[inner]
            out.append((at, node, branch))
            if not len(at):
                return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
            node, branch = self.parent[node], self.parent_branch[node]

    def decisions(self, f: np.ndarray, leaf: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What picks the classes and the words in them: token, weight rows, biases and branch of each softmax."""
        at, node, branch = self.paths(leaf)
        return at, _rows(f[at], node, rows), self.node_bias[node], branch

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, count) of each hash; rank -1 and count 0 beyond the lookup."""
        if not len(self.hashes):
            return np.full(len(h), -1), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[at] == h
        return np.where(same, self.ranks[at], -1), np.where(same, self.counts[at], 0)


def contexts(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """(tokens, FEATURES): hashed features of the tokens before each: the last, the last two, and the last but one (a skip)."""
    n = len(ids)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    before = []
    for gap in (1, 2):
        w = np.full(n, 1, dtype=np.uint64)  # before the text
        w[gap:] = ids[: n - gap].astype(np.uint64) + np.uint64(2)
        w[place < gap] = 1
        before.append(w)
    a, b = before
    return np.stack([mix(a * _MUL[0]), mix(a * _MUL[1] + b * _MUL[2]), mix(b * _MUL[3])], axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place. Biases are at most 0, so bounded logits take the place of a shift by each row's largest."""
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    z *= (1 / np.einsum("ij->i", z))[:, None]
    return z


def _rows(f: np.ndarray, node: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The weight row of each feature at a node."""
    at = mix(f + (node + 1).astype(np.uint64)[:, None] * _MUL[5])
    at &= np.uint64(rows - 1)
    return at.view(np.int64)


def _logits(w: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """bias with the weights added in place, so many rows at a time that they stay in a processor's cache."""
    for i in range(0, len(rows), CACHED):
        z = bias[i : i + CACHED]
        for k in range(FEATURES):
            z += np.take(w, rows[i : i + CACHED, k], axis=0, mode="clip")
        yield slice(i, i + CACHED), z


def _probability(w: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The softmax of each decision, in place of its bias."""
    for _, z in _logits(w, rows, bias):
        _softmax(z)
    return bias


def _log_chosen(w: np.ndarray, rows: np.ndarray, bias: np.ndarray, branch: np.ndarray) -> np.ndarray:
    """The log probability of the branch taken at each decision; bias is overwritten."""
    out = np.empty(len(rows))
    for part, z in _logits(w, rows, bias):
        np.clip(z, -80, 80, out=z)
        out[part] = z[np.arange(len(z)), branch[part]]
        np.exp(z, out=z)
        out[part] -= np.log(np.einsum("ij->i", z))
    return out


class Learner:
    """Gradient steps with a rate for each weight row, from shared weights on; keeps how often each row was touched."""

    def __init__(self, w: np.ndarray):
        self.start, self.w = w, w.copy()
        self.squares = np.full(len(w), 0.5 * WIDTH, dtype=np.float32)
        self.seen = np.zeros(len(w), dtype=np.int64)

    def step(self, rows: np.ndarray, p: np.ndarray) -> None:
        """One update from weight rows and the gradient of the logits; sums by row are taken a column at a time, into all
        rows, as a step meets most of them."""
        places = np.ascontiguousarray(rows.T)
        n = np.bincount(places.ravel(), minlength=len(self.w))
        g, total = np.empty((WIDTH, len(self.w)), dtype=np.float32), np.empty(len(self.w))
        for j, c in enumerate(np.ascontiguousarray(p.T, dtype=np.float64)):
            total[:] = 0
            for at in places:
                np.add.at(total, at, c)
            g[j] = total
        self.seen += n
        n = np.maximum(n, 1).astype(np.float32)
        for i in range(0, len(self.w), CACHED):
            part = slice(i, i + CACHED)
            self.squares[part] += np.einsum("ji,ji->i", g[:, part], g[:, part]) / n[part]
            self.w[part] -= (g[:, part] * (RATE * np.sqrt(WIDTH / (n[part] * self.squares[part])))).T

    def learn(self, voc: Vocabulary, f: np.ndarray, leaf: np.ndarray) -> None:
        for i in range(0, len(leaf), STEP):
            _, rows, bias, branch = voc.decisions(f[i : i + STEP], leaf[i : i + STEP], len(self.w))
            p = _probability(self.w, rows, bias)
            p[np.arange(len(branch)), branch] -= 1
            self.step(rows, p)

    def changes(self, blocks: int = BLOCKS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, rows in it, how often met, change in PARTS) of what was touched."""
        per = len(self.w) // blocks
        for k in range(blocks):
            met = k * per + np.flatnonzero(self.seen[k * per : (k + 1) * per])
            change = np.clip(np.rint((self.w[met] - self.start[met]) * PARTS), -(1 << 15) + 1, (1 << 15) - 1)
            yield k, (met - k * per).astype(np.int32), self.seen[met], change.astype(np.int16)


def encoded(voc: Vocabulary, texts: pa.Array) -> tuple:
    first, codes, h = token_hashes(texts)
    rank, count = voc.look(h)
    return first, codes, h, rank, count, voc.leaves(h, rank), contexts(first, h[codes])


def train_weights(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights learned from all of docs, a part in each round.

    In a round each task takes gradient steps over its rows from the shared weights; what it changed is averaged over
    tasks, row by row, weighted by how often the task met the row, and shared for the next round. A task sends the rows
    that it met only. Null and empty texts are an end token each; rows that repeat count as often as they stand there.
    """
    sc = docs.sparkSession.sparkContext
    size = power_of_two(voc.distinct / WORDS_A_ROW, ROWS, MOST_ROWS)
    known, w = sc.broadcast(voc), np.zeros((size, WIDTH), dtype=np.float32)
    per = size // BLOCKS

    def read(at, data):
        at = np.frombuffer(at, dtype=np.int32)
        seen = np.frombuffer(data, dtype=np.int64, count=len(at))
        change = np.frombuffer(data, dtype=np.int16, offset=8 * len(at)).reshape(len(at), WIDTH)
        return at, np.concatenate([change * seen[:, None].astype(np.float64), seen[:, None]], axis=1)

    for k in range(rounds):
        shared = sc.broadcast(w)

        @tidy
        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            made = None
            for batch in batches:
                for b in pieces_of(batch, size=SLICE):
                    made = made or Learner(shared.value)
                    _, codes, _, _, _, leaf, f = encoded(known.value, b.column(0))
                    made.learn(known.value, f, leaf[codes])
            part = TaskContext.get().partitionId()
            for block, at, seen, change in made.changes() if made else ():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([seen.tobytes() + change.tobytes()], pa.binary())], names=["block", "part", "at", "data"])

        part = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), F.lit(rounds)) == k).select(text_col)
        tasks = min(partitions(part), max(LEAST_TASKS, voc.total // (rounds * TOKENS_A_TASK)))
        part = part.coalesce(tasks)
        summed = sum_blocks(part.mapInArrow(run, "block int, part int, at binary, data binary"), read, (per, WIDTH + 1), tasks)
        w = w.copy()
        for r in summed.collect():  # BLOCKS rows of a fixed size
            change = np.frombuffer(bytes(r["data"])).reshape(per, WIDTH + 1)
            w[r["block"] * per : (r["block"] + 1) * per] += change[:, :WIDTH] / (PARTS * np.maximum(change[:, WIDTH:], 1))
        shared.destroy()  # each executor has a copy on disk
    known.destroy()
    return w


def score_texts(docs: DataFrame, train: str = "crc32 mod 7 is not 2", id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, lookup: int = LOOKUP, rounds: int = ROUNDS) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between ASCII white space in lower case (A-Z only) and an end; null and empty texts have the end
    alone. Learning is from documents whose crc32 of the doc_id as text leaves another remainder than `held`. base_score
    is the add-one unigram log10 probability and score the model's: class given context, times class or word given class
    and context, down the tree of classes. All tokens count: those beyond the lookup are leaves by hash bucket, times the
    word's share of its bucket by counts from a join. Rows that repeat get equal scores; null ids count as remainder 0;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(id_col, folds) == held).alias("held_out"))
    learn = rows.where(~F.col("held_out"))
    counts = staged(count_tokens(learn), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(counts, lookup).toArrow()
    hashes, c = top["h"].to_numpy().view(np.uint64) if len(top) else np.empty(0, np.uint64), top["c"].to_numpy() if len(top) else np.empty(0, np.int64)
    by_count = np.lexsort((hashes.view(np.int64), -c))
    buckets = power_of_two((distinct - len(top)) / WORDS_A_BUCKET, 1, MOST_BUCKETS)
    tail = np.ones(buckets)  # a row a bucket from all words, less the lookup's
    for b, n in counts.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg((F.sum("c") + F.count(F.lit(1))).alias("n")).collect():
        tail[b] += n
    tail -= np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), weights=c + 1.0, minlength=buckets)
    voc = Vocabulary.of(hashes[by_count], c[by_count], int(total), int(distinct), tail)
    w = train_weights(learn, voc, rounds, "doc_id")
    known = spark.sparkContext.broadcast((voc, w))
    names = ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "tail"]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, w = known.value
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in pieces_of(batch, size=SLICE):
                first, codes, h, rank, count, leaf, f = encoded(voc, b.column(1))
                n = len(codes)
                own = np.zeros(len(h))  # a word's share of its bucket of the tail, but for its count
                own[rank < 0] = -np.log(voc.tail[(h[rank < 0] & np.uint64(len(voc.tail) - 1)).astype(np.int64)])
                logp = own[codes]
                for i in range(0, n, STEP):
                    tokens, rows, bias, branch = voc.decisions(f[i : i + STEP], leaf[codes[i : i + STEP]], len(w))
                    logp[i : i + STEP] += np.bincount(tokens, weights=_log_chosen(w, rows, bias, branch), minlength=min(STEP, n - i))
                far = rank[codes] < 0
                base = np.where(far, 0.0, np.log10(count + 1.0)[codes])
                m = len(first) - 1
                sums = [np.add.reduceat(x, first[:-1]) for x in (base, logp, (~far).astype(np.int64), far.astype(np.int64))]
                tail = h[codes[far]].view(np.int64)
                cut = np.concatenate([[0], np.cumsum(sums[3])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(at, at + m)), b.column(0), b.column(2), pa.array(np.diff(first)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1] / np.log(10)),
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(tail)),
                ], names=names)
                at += m

    kind = rows.schema["doc_id"].dataType.simpleString()
    done = staged(rows.select("doc_id", "text", "held_out").mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, tail array<long>"), "scored")
    far = done.select("rid", F.explode("tail").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("n"))
    far = far.join(counts, "h", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"),
    )
    zero = F.lit(0)
    out = done.drop("tail").join(far, "rid", "left").withColumns({c: F.coalesce(c, zero) for c in ("tail_base", "tail_known")})
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_base") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("tail_base")).alias("score"),
    )
