"""Benchmark decontamination: one Aho-Corasick automaton over normalised items scans each text once."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WORDS, append_columns, hash_words, split_words, staged, translated

#: Words are runs of digits, ASCII letters and anything beyond ASCII (fixed by the contract).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10
#: Bytes of benchmark text in one automaton (15 to 20 bytes of memory for each); more text is scanned for in blocks.
BLOCK_BYTES = 16 << 20
#: A word's number is two letters of the automaton, as a node's branches are searched one by one; the first are from BASE
#: on, past the surrogates, the second from LOW on.
BASE, LOW = 0x10000, 0x90000
#: Places of items that are compared with a text at a time.
STEP_PLACES = 1 << 20


def seed_size(window: int) -> tuple[int, int]:
    """(words, stride): every window of an item holds a whole seed, if one begins at each stride-th word of the item."""
    words = (window + 1) // 2
    return words, window - words + 1


@dataclass
class Items:
    """Items as numbers of words, one after another with a -1 behind each, and the automaton's source.

    The automaton has, for each item, a seed of words at every stride (a short item is its own seed), not all windows:
    where a seed is met, the words around are compared with those around it in the item. So it takes memory in
    proportion to the items, not to windows times their length.
    """

    ids: list[str | None]
    known: np.ndarray  # sorted hashes of the items' words; a word's number is its place + 1
    flat: np.ndarray
    begins: np.ndarray
    window: int
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def of(ids: list, texts: pa.Array, window: int) -> Items:
        first, codes, words = split_words(translated(texts, WORDS))
        h = hash_words(words)
        known = np.unique(h)
        n = len(first) - 1
        flat = np.full(len(codes) + n, -1, dtype=np.int32)
        flat[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(first))] = (np.searchsorted(known, h) + 1)[codes]
        return Items([None if i is None else str(i) for i in ids], known, flat, first[:-1] + np.arange(n), window)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word, 0 for those that no item has."""
        if not len(self.known) or not len(words):
            return np.zeros(len(words), dtype=np.int32)
        h = hash_words(words)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at + 1, 0).astype(np.int32)


def _letters(numbers: np.ndarray, branches: int) -> str:
    """Two letters for each number (-1 and 0: such as no item has)."""
    n = np.maximum(numbers, 0)
    return np.stack([BASE + n // branches, LOW + n % branches], axis=1).astype("<u4").tobytes().decode("utf-32-le")


class Scanner:
    def __init__(self, items: Items):
        self.items, size = items, items.window
        self.words, stride = seed_size(size)
        ends = np.append(items.begins, len(items.flat))[1:] - 1
        places: dict[str, list[int]] = {}
        self.branches = int(np.ceil((len(items.known) + 2) ** 0.5))
        every = _letters(items.flat, self.branches)
        for a, b in zip(items.begins.tolist(), ends.tolist(), strict=True):
            if b - a >= size:
                for at in range(a, b - self.words + 1, stride):
                    places.setdefault(every[2 * at : 2 * (at + self.words)], []).append(at)
            elif b > a:
                places.setdefault(every[2 * a : 2 * b], []).append(~a)  # a whole item
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS) if places else None
        self.first, self.places, self.length = np.zeros(len(places) + 1, dtype=np.int64), np.zeros(sum(map(len, places.values())), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for k, (seed, at) in enumerate(places.items()):
            self.found.add_word(seed, k)
            self.length[k] = len(seed) // 2
            self.first[k + 1] = self.first[k] + len(at)
            self.places[self.first[k] : self.first[k + 1]] = at
        if self.found is not None:
            self.found.make_automaton()
        #: with as many words on each side that equal nothing
        self.flat = np.pad(items.flat, size, constant_values=-1)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text: the number of words, the runs [first, past) of words inside a window, the items found, sorted."""
        first, codes, words = split_words(translated(texts, WORDS))
        n, many = len(first) - 1, np.diff(first)
        runs: list[list] = [[] for _ in range(n)]
        items: list[list] = [[] for _ in range(n)]
        if self.found is None or not len(codes):
            return many, runs, items
        flat = np.zeros(len(codes) + n, dtype=np.int32)  # a 0 behind each text
        flat[np.arange(len(codes)) + np.repeat(np.arange(n), many)] = self.items.numbers(words)[codes]
        begin, past, whose = self._occurrences(flat)
        if not len(begin):
            return many, runs, items
        starts = first[:-1] + np.arange(n)
        inside = np.cumsum(np.bincount(begin, minlength=len(flat) + 1) - np.bincount(past, minlength=len(flat) + 1)) > 0
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        for a, b in edges.reshape(-1, 2).tolist():
            doc = int(np.searchsorted(starts, a, side="right")) - 1
            runs[doc].append((a - int(starts[doc]), b - int(starts[doc])))
        doc = np.searchsorted(starts, begin, side="right") - 1
        for pair in np.unique(doc * len(self.items.ids) + whose).tolist():
            if (item := self.items.ids[pair % len(self.items.ids)]) is not None:
                items[pair // len(self.items.ids)].append(item)
        return many, runs, [sorted(set(x)) for x in items]

    def _occurrences(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, past, item) of stretches of flat that lie in an item and hold a window of it; each occurrence is in one."""
        # stretches of the items' words that are shorter than any seed aren't looked at
        edges = np.flatnonzero(np.diff(flat > 0, prepend=False)).reshape(-1, 2)
        edges = edges[edges[:, 1] - edges[:, 0] >= self.length.min()]
        size = edges[:, 1] - edges[:, 0] + 1  # with what parts it from the next
        at = np.repeat(edges[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())
        hits = list(self.found.iter(_letters(flat[at], self.branches))) if len(at) else []
        if not hits:
            return (np.empty(0, dtype=np.int64),) * 3
        end, seed = np.array(hits, dtype=np.int64).T
        end = at[end // 2]
        number = self.first[seed + 1] - self.first[seed]
        padded, size, out = np.pad(flat, self.items.window), self.items.window, []
        cut = [0, *np.flatnonzero(np.diff(np.cumsum(number) // STEP_PLACES)).tolist(), len(seed)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            k = number[a:b]
            at = np.repeat(self.first[seed[a:b]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            place = self.places[at]
            whole, length = place < 0, np.repeat(self.length[seed[a:b]], k)
            place = np.where(whole, ~place, place)
            begin = np.repeat(end[a:b] - self.length[seed[a:b]] + 1, k)
            left, right = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
            on, off = ~whole, ~whole
            for j in range(1, size - self.words + 1):
                on &= padded[begin - j + size] == self.flat[place - j + size]
                left += on
                off &= padded[begin + length - 1 + j + size] == self.flat[place + length - 1 + j + size]
                right += off
            good = whole | (left + length + right >= size)
            item = np.searchsorted(self.items.begins, place[good], side="right") - 1
            out.append((begin[good] - left[good], begin[good] + length[good] + right[good], item))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as offsets of chars in the text as it was."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [{"begin": at[a][0], "end": at[b - 1][1]} for a, b in runs]


#: The scanner of the last items that this Python worker met: built once a worker, not once a task.
_LAST: list[tuple[str, Scanner]] = []


def _scanner(items: Items) -> Scanner:
    if not _LAST or _LAST[0][0] != items.key:
        _LAST.clear()
        _LAST.append((items.key, Scanner(items)))
    return _LAST[0][1]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (all columns and rows) with n_words, n_hit (longs), items (sorted strings), spans (of char offsets) and contaminated.

    A window is `window` consecutive words of an item (a shorter item is one window); a word inside an occurrence is a
    hit. Ties don't arise: all windows and items count. Null and empty texts have no words, texts of any length are read
    whole; items without words find nothing, those without id make hits but aren't among the items; repeated items count
    once; without documents there are no rows; columns of docs named like a new one are replaced. No shuffle: the
    automaton's source goes to each task, and each text is scanned once. A benchmark of more than block_bytes, which one
    automaton is not to hold, is scanned for in blocks, and what they find is written to the shared folder in between.
    """
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    runs_type, items_type = T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType())
    last = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", items_type),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("contaminated", T.BooleanType()),
    ]
    df = docs
    for k in range(blocks):
        # a block's items: bounded by block_bytes, as the hash deals them out evenly
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        held = block.toArrow().combine_chunks()
        texts = held["text"].cast(pa.string()).combine_chunks()
        known = docs.sparkSession.sparkContext.broadcast(Items.of(held["id"].to_pylist(), texts if isinstance(texts, pa.Array) else pa.array([], pa.string()), window))

        def make(known=known, done=k + 1 == blocks):
            scanner = _scanner(known.value)

            def work(texts, runs=None, items=None):
                many, own, found = scanner.scan(texts)
                if runs is not None:
                    own = [merged([*map(tuple, r or []), *o]) for r, o in zip(runs.to_pylist(), own, strict=True)]
                    found = [sorted({*(i or []), *o}) for i, o in zip(items.to_pylist(), found, strict=True)]
                if not done:
                    return [own, found]
                hit = [sum(b - a for a, b in r) for r in own]
                return [many, hit, found, [spans(texts[i].as_py(), r) if r else [] for i, r in enumerate(own)], [n > 0 for n in hit]]

            return work

        before = [text_col, "__runs", "__items"] if k else [text_col]
        after = last if k + 1 == blocks else [T.StructField("__runs", runs_type), T.StructField("__items", items_type)]
        df = append_columns(df, before, after, make)
        if k + 1 < blocks:
            df = staged(df, "contamination")
    return df.drop("__runs", "__items")
