"""Best-fit packing of token pieces into sequences, improved by swap-based local search."""

from __future__ import annotations

import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import pieces_of, split_words, tidy

CAPACITY = 2048
#: Pieces packed together by one task, about; a group wastes half a sequence at most on the whole.
GROUP = 16_384
#: Room that an exchange may leave over.
SLACK = 8


# -- tokens -----------------------------------------------------------------------------------------------------------


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts by a `tokenizers` file whose pre-tokenizer drops white space.

    Such a tokenizer treats what stands between white space alone, so each distinct word is looked up once a call. Texts
    are cut at ASCII white space only, which is safe as any other stays inside a word. Plain words, of letters whose normal
    form is themselves and perhaps signs after them, are cut into these two; letters and signs go to the tokenizer's model
    directly, anything else goes through the whole tokenizer. The ids of up to `most` such parts are kept from call to
    call, and then the store starts anew: it has to hold a few times the parts of a batch of texts, or all are encoded
    again in each.
    """

    #: ASCII and precomposed Latin letters, then ASCII signs: lower-casing and NFC leave no doubt about them.
    PARTS = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:;=?@\[-`{-~]*)$"

    def __init__(self, path: str, most: int = 1 << 19):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.split = self._is_word_level(path)
        self.bytes = self._byte_letters() if self.split else {}
        self._forget()

    def _is_word_level(self, path: str) -> bool:
        """Whether words can be looked up one by one: tried on a text with all the cases that matter."""
        text = "It's  the\tÉtat's\n'Tis 12 a1b, naïve?! <x>　é Straße…"
        whole = self.tok.encode(text, add_special_tokens=False).ids
        return whole == [i for w in text.split() for i in self.tok.encode(w, add_special_tokens=False).ids]

    def _byte_letters(self) -> dict[int, str]:
        """The model's letter for each Latin letter that isn't ASCII, from the pre-tokenizer itself."""
        out = {}
        for c in range(0xC0, 0x100):
            if c not in (0xD7, 0xF7):
                got = self.tok.pre_tokenizer.pre_tokenize_str(chr(c))
                if len(got) == 1:
                    out[c] = got[0][0]
        return out

    def _forget(self) -> None:
        """An empty store: part -> its number, where the ids of each number end, ids. Number 0 has none."""
        self.known, self.ends, self.kept = {}, array("q", [0]), array("I")

    def _numbers(self, runs: list[str], words: list[str]) -> np.ndarray:
        """The store's numbers of runs (of letters or of signs, for the model) and then of words (for the whole tokenizer)."""
        parts = [*runs, *words]
        at = [self.known.get(s) for s in parts]
        if len(self.known) + at.count(None) > self.most:
            self._forget()
            at = [None] * len(parts)
        for i in [i for i, k in enumerate(at) if k is None]:
            s = parts[i]
            if i < len(runs):
                self.kept.extend([t.id for t in self.tok.model.tokenize(s if s.isascii() else s.translate(self.bytes))])
            else:
                self.kept.extend(self.tok.encode(s, add_special_tokens=False).ids)
            at[i] = self.known[s] = len(self.ends)
            self.ends.append(len(self.kept))
        return np.array(at, dtype=np.int64)

    def _word_numbers(self, words: pa.Array) -> np.ndarray:
        """The store's numbers of what each distinct word consists of: two a word."""
        cut = pc.extract_regex(words, self.PARTS)
        plain = pc.and_(cut.is_valid(), pc.less(pc.binary_length(words), 200))  # letters, then perhaps a run of signs
        where = plain.to_numpy(zero_copy_only=False)
        letters, signs = (pc.struct_field(cut, i).filter(plain) for i in range(2))
        letters, signs = pc.utf8_lower(letters).dictionary_encode(), signs.dictionary_encode()
        runs, others = [*letters.dictionary.to_pylist(), *signs.dictionary.to_pylist()], words.filter(pc.invert(plain)).to_pylist()
        number = self._numbers(runs, others)
        n = len(letters.dictionary)
        out = np.zeros((len(words), 2), dtype=np.int64)
        out[where, 0] = number[:n][letters.indices.to_numpy()]
        out[where, 1] = number[n : len(runs)][signs.indices.to_numpy()]
        out[~where, 0] = number[len(runs) :]
        return out

    @staticmethod
    def _joined(ends: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the entries `at` of flat, which end at ends[1:], begins when joined (and the end); these joined."""
        size = np.diff(ends)[at]
        past = np.concatenate([[0], np.cumsum(size)])
        return past, flat[np.repeat(ends[at] - past[:-1], size) + np.arange(past[-1])]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (and the end), and the ids of the whole texts as uint32."""
        texts = pc.fill_null(texts, "")
        if not self.split:
            each = [e.ids for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.cumsum([0, *map(len, each)]), np.array([i for e in each for i in e], dtype=np.uint32)
        first, codes, words = split_words(texts)
        numbers = self._word_numbers(words).ravel()
        ends, kept = np.array(self.ends, dtype=np.int64), np.array(self.kept, dtype=np.uint32)
        past, flat = self._joined(np.concatenate([[0], ends]), kept, numbers)
        past, flat = self._joined(past[::2], flat, codes)
        return past[first], flat


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One a Python worker."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit, as binary).

    Texts of any length are read whole, a few MB of shorter ones at a time.

    A document's ids are its text's (null: none) and end_id; only those longer than capacity are cut, and just the last
    piece may be shorter. Repeated rows each give pieces; other columns are ignored.
    """
    path = path or _default_tokenizer()

    @tidy
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([end_id], dtype="<u4")
        for batch in batches:
            for b in pieces_of(batch):
                rows = []
                first, flat = tok.ids(b.column(1))
                flat = flat.astype("<u4")
                for i in range(b.num_rows):
                    ids = np.concatenate([flat[first[i] : first[i + 1]], end])
                    rows += [(i, k, a, min(capacity, len(ids) - a), ids[a : a + capacity].tobytes()) for k, a in enumerate(range(0, len(ids), capacity))]
                at, k, start, length, ids = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


# -- one group --------------------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in falling order: each item goes where the least room is left over. Bins of item numbers."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    mask = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, rounds: int | None = None) -> list[list[int]]:
    """Local search between underfull bins, until the bins are as few as the total allows or nothing improves.

    The emptiest bins give: an item moves to another bin, or it (or two items together) is exchanged for a smaller
    one there. Each step fills a fuller bin from an emptier one, so the sum of squared fills grows and the emptiest
    bins run out. What would fill a bin is looked up by length, so a step doesn't scan the bins.
    """
    least = -(-sum(lengths) // capacity)
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    alive = len(bins)
    version = [0] * alive
    rooms: dict[int, list] = {}  # room -> bins
    wanted: dict[int, list] = {}  # length that would fill a bin in place of one of its items -> bin, item

    def note(b: int) -> None:
        version[b] += 1
        room = capacity - fill[b]
        if room and bins[b]:
            rooms.setdefault(room, []).append((b, -1, version[b]))
            for j in {lengths[j]: j for j in bins[b]}.values():
                wanted.setdefault(lengths[j] + room, []).append((b, j, version[b]))

    def find(table: dict[int, list], n: int, a: int, below: int | None = None) -> tuple[int, int] | None:
        """An entry that still holds, whose bin is at least as full as a and whose item is shorter than `below`."""
        entries = table.get(n, ())
        for k in range(len(entries) - 1, -1, -1):
            b, j, v = entries[k]
            if version[b] != v:
                entries.pop(k)
            elif b != a and fill[b] >= fill[a]:
                if below is None or lengths[j] < below:
                    return b, j
                if not wide:
                    break
        return None

    def shift(a: int, gives: tuple[int, ...], b: int, takes: int) -> None:
        for i in gives:
            bins[a].remove(i)
            bins[b].append(i)
        if takes >= 0:
            bins[b].remove(takes)
            bins[a].append(takes)
        moved = sum(lengths[i] for i in gives) - (lengths[takes] if takes >= 0 else 0)
        fill[a] -= moved
        fill[b] += moved
        note(a)
        note(b)

    def pair(a: int, slack: int) -> bool:
        for i, k in itertools.combinations(bins[a], 2):
            n = lengths[i] + lengths[k]
            if (got := find(rooms, n + slack, a)) or (got := find(wanted, n + slack, a, n)):
                shift(a, (i, k), *got)
                return True
        return False

    def step(a: int) -> bool:
        mine = sorted({lengths[i]: i for i in bins[a]}.items(), reverse=True)
        for slack in range(SLACK + 1):  # the room left over
            for n, i in mine:
                if (got := find(rooms, n + slack, a)) or (got := find(wanted, n + slack, a, n)):
                    shift(a, (i,), *got)
                    return True
            if slack == 0 and pair(a, 0):
                return True
        if wide and any(pair(a, slack) for slack in range(1, SLACK + 1)):
            return True
        for n, i in reversed(mine):  # any bin with room
            if fits := [r for r, entries in rooms.items() if r >= n and entries]:
                for r in sorted(fits):
                    if got := find(rooms, r, a):
                        shift(a, (i,), *got)
                        return True
        return False

    wide = False  # then also the exchanges that take a longer search
    for b in range(alive):
        note(b)
    for _ in itertools.count() if rounds is None else range(rounds):  # ends, as the sum of squared fills grows
        changed = False
        for a in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            if alive <= least:
                return [b for b in bins if b]
            while bins[a] and step(a):
                changed = True
            alive -= not bins[a]
        if not changed:
            if wide:
                break
            wide = True
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, rounds: int | None = None) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity, rounds)


# -- tables -----------------------------------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (doc_id, piece, start, length and what else there is) with sequence_id and offset (longs).

    Pieces are dealt by a hash of doc_id, piece, start and the row's number to groups of about `group`, each packed by
    one task, so tasks are bounded and neither a repeated nor a null id is hot. pieces should be a stored table, as row
    numbers follow its files. A length of 1..capacity is asked for; more fails. Columns of pieces named like a new one
    are replaced; pieces of equal length may take each other's places; an empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    total = pieces.count()
    groups = max(1, -(-total // group))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.lit(groups)))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start"], kind="stable", ignore_index=True)
        lengths = pdf["length"].astype(int).tolist()
        if lengths and (max(lengths) > capacity or min(lengths) < 1):
            raise ValueError(f"a length isn't in 1..{capacity}")
        seq, off = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for s, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = (int(key[0]) << 32) + s, at
                at += lengths[i]
        return pdf.drop(columns="__group").assign(sequence_id=seq, offset=off)

    return dealt.groupBy("__group").applyInPandas(place, out)
