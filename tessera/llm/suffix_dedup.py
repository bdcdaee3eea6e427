"""Removal of long passages that occur more than once, by suffix arrays over groups of passages that can be equal.

No suffix array of a corpus fits a task. So passages are brought together first: of all strings of K bytes inside a
passage of `length` bytes, the one of least hash is its anchor, which depends on nothing but the passage, so equal
passages have equal anchors. Neighbouring passages with one anchor are one string (a run); runs whose anchor occurs
once can't repeat and stay behind. All runs of an anchor meet in one task, which sorts their suffixes in two stages and
compares neighbours. (A run whose anchor stands in it twice may repeat by itself, as periodic text does, and goes along.)
Equal runs are one with a number of copies, of which every start repeats; where all runs of an anchor have copies there is
nothing left to find, and they are not sorted.
An anchor with more different runs than a task shall hold is cut up by a longer anchor, and at last
by the whole passage, so no group is unbounded and none is cut off.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, parallelism, release, settle, staged, tidy
from tessera.llm.suffix_array import repeated_starts

LENGTH = 200
#: Bytes of an anchor, and of those that cut up what is too large for a task.
ANCHORS = (64, 128)
#: Passages in a run at most, different runs of an anchor in one group at most, and bytes of a piece that is sorted.
RUN, MOST_RUNS, PIECE = 1024, 4096, 1 << 20
#: Rows of a broadcast set of keys at most (16 bytes each).
BROADCAST_ROWS = 200_000
#: Starts that are hashed in one step.
_STEP = 1 << 17
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_BASE = 0x9E3779B97F4A7C15


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` bytes in a row, by joining hashes of shorter strings."""
    part, power, have, out = _BYTE[data], _BASE, 1, None
    done = 0
    while True:
        if size & have:
            if out is None:
                out = part
            else:
                n = len(data) - done - have + 1
                out = out[:n] * np.uint64(power) + part[done : done + n]
            done += have
            if done == size:
                return mix(out)
        n = len(part) - have
        part = part[:n] * np.uint64(power) + part[have : have + n]
        power, have = power * power % (1 << 64), 2 * have


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    n = len(values) - width + 1
    return out[:n] if have == width else np.minimum(out[:n], out[width - have : width - have + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of passages that share an anchor: string's number, first start in it, starts in the run, anchor's hash, how
    often the anchor stands in the run.

    data holds strings one after another, string i from offsets[i] to offsets[i + 1]; each start of `length` bytes that
    lie in one string is in exactly one run.
    """
    firsts, anchors, counts, stand = [], [], [], []
    width = length - anchor + 1
    total = int(offsets[-1])
    begins, ends = offsets[:-1], offsets[1:]
    stops = np.maximum(begins, ends - length + 1)  # starts from here on don't have all their bytes
    for low in range(0, total - length + 1, _STEP):
        high = min(low + _STEP, total - length + 1)
        hashes = string_hashes(data[low : high + length - 1], anchor)
        least = least_of(hashes, width)
        near = slice(np.searchsorted(ends, low, "right"), np.searchsorted(begins, high, "left"))
        marks = np.concatenate([[low], np.flatnonzero(least[1:] != least[:-1]) + low + 1, begins[near], stops[near]])
        marks = np.unique(marks[(marks >= low) & (marks < high)])
        size = np.diff(np.append(marks, high))
        string = np.searchsorted(offsets, marks, "right") - 1
        whole = marks < stops[string]
        marks, size = marks[whole], size[whole]
        own = least[marks - low]
        # in the first passage of a run, and at the end of each later one
        later = np.concatenate([[0], np.cumsum(hashes[width - 1 :] == least)])
        often = later[marks - low + size] - later[marks - low + 1]
        places = np.arange(width)
        for a in range(0, len(marks), 1024):
            b = slice(a, a + 1024)
            often[b] += np.count_nonzero(hashes[marks[b, None] - low + places] == own[b, None], axis=1)
        firsts.append(marks)
        counts.append(size)
        anchors.append(own)
        stand.append(often)
    if not firsts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none
    first, count, hashed, often = np.concatenate(firsts), np.concatenate(counts), np.concatenate(anchors).view(np.int64), np.concatenate(stand)
    if len(count) and count.max() > RUN:  # a text of one byte over and over
        times = -(-count // RUN)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, left, hashed = np.repeat(first, times) + place * RUN, np.repeat(count, times) - place * RUN, np.repeat(hashed, times)
        often = np.repeat(often, times)
        count = np.minimum(left, RUN)
    string = np.searchsorted(offsets, first, "right") - 1
    return string, first - offsets[string], count, hashed, often


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings or binaries without nulls, and where each begins (and the last ends)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return flat, at - at[0]


def _digests(strings: list[bytes]) -> tuple[list[int], list[int]]:
    both = [xxhash.xxh3_128_intdigest(s) for s in strings]
    low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in both], dtype=np.uint64).view(np.int64)
    high = np.array([x >> 64 for x in both], dtype=np.uint64).view(np.int64)
    return low, high


def _key(seed: int) -> F.Column:
    """64 bits of the text's identity."""
    return F.xxhash64(F.lit(seed), "text")


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """(key, anchor, start, size, often) of all runs of all texts; often: how often the anchor stands in the run, 2 at most."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy()
            string, start, size, anchor, often = runs(*_flat(b.column(1)), length, ANCHORS[0])
            cols = [pa.array(key[string], pa.int64()), pa.array(anchor, pa.int64()), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.minimum(often, 2).astype(np.int8))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "anchor", "start", "size", "often"])

    return docs.select(_key(1).alias("key"), "text").where(F.octet_length("text") >= length).mapInArrow(run, "key long, anchor long, start int, size int, often byte")


def _with(docs: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Texts joined with what `keyed` (staged, a row a key) has of them.

    Up to BROADCAST_ROWS keys are sent around first, so that only the texts that are wanted are shuffled.
    """
    if keyed.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(keyed.select(*keys)), keys, "left_semi")
    return docs.join(keyed, keys)


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted runs: (key, other, anchor, c1, c2, start, size, bytes); c1 and c2 are a digest of bytes."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = _flat(b.column(2))
            lists = b.column(3)
            fields = lists.flatten()
            anchor, start, size = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            many = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), many)
            inside = start.astype(np.int64) + size + length - 1 <= (offsets[1:] - offsets[:-1])[row]  # else: another text's, by a clash of keys
            row, anchor, start, size = row[inside], anchor[inside], start[inside], size[inside]
            low = offsets[row] + start
            data = flat.tobytes()
            for a in range(0, len(row), 8192):
                part = slice(a, a + 8192)
                strings = [data[x:y] for x, y in zip(low[part].tolist(), (low[part] + size[part] + (length - 1)).tolist(), strict=True)]
                c1, c2 = _digests(strings)
                cols = [b.column(0).to_numpy()[row[part]], b.column(1).to_numpy()[row[part]], anchor[part], c1, c2, start[part], size[part]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(strings, pa.binary())], names=["key", "other", "anchor", "c1", "c2", "start", "size", "bytes"])

    texts = docs.select(_key(1).alias("key"), _key(2).alias("other"), "text")
    return _with(texts, wanted, ["key"]).select("key", "other", "text", "runs").mapInArrow(run, "key long, other long, anchor long, c1 long, c2 long, start int, size int, bytes binary")


_RUN = ["anchor", "c1", "c2"]
_SPANS = "anchor long, c1 long, c2 long, spans array<struct<low:int,high:int>>"


def _spans(mark: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return [{"low": a, "high": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def _sorted_spans(distinct: DataFrame, length: int) -> DataFrame:
    """For each run (anchor, c1, c2, copies, bytes) the starts that repeat, as spans; runs without any are left out.

    All runs of an anchor are in one task, and whole anchors are sorted together up to PIECE bytes. Every start of a run
    with copies repeats as it is; such runs are sorted for what they have in common with others of their anchor, and an
    anchor with no others is settled without.
    """

    def batch(got: list[tuple]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(3)] + [pa.array([g[3] for g in got], kind)], names=[*_RUN, "spans"])

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        marks = repeated_starts([r[4] for r in rows], length)
        for r, m in zip(rows, marks, strict=True):
            m |= r[3] > 1
        return batch([(*r[:3], _spans(m)) for r, m in zip(rows, marks, strict=True) if m.any()])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        held, held_size, settled = [], 0, []
        for _, group in itertools.groupby(rows, key=lambda row: row[0]):
            group = list(group)
            if all(r[3] > 1 for r in group):
                settled += [(*r[:3], [{"low": 0, "high": len(r[4]) - length + 1}]) for r in group]
                if len(settled) >= 8192:
                    yield batch(settled)
                    settled = []
                continue
            held += group
            held_size += sum(len(r[4]) for r in group)
            if held_size >= PIECE:
                yield solved(held)
                held, held_size = [], 0
        if held:
            yield solved(held)
        if settled:
            yield batch(settled)

    rows = distinct.select(*_RUN, "copies", "bytes").repartition(parallelism(distinct.sparkSession), "anchor").sortWithinPartitions(*_RUN)
    return rows.mapInArrow(run, _SPANS)


def _finer(distinct: DataFrame, length: int, anchor: int) -> DataFrame:
    """The runs of (anchor, c1, c2, copies, bytes) cut up by longer anchors, at `length` by whole passages, each with its
    place in the run it is of: (a, p1, p2, copies, anchor, c1, c2, start, bytes). Whole passages go by their digests alone."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = _flat(b.column(4))
            string, start, size, hashed, _ = runs(flat, offsets, length, anchor)
            if anchor == length:
                times = size
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                string, start, size, hashed = np.repeat(string, times), np.repeat(start, times) + place, np.ones(int(times.sum()), dtype=np.int64), np.repeat(hashed, times)
            data = flat.tobytes()
            low = offsets[string] + start
            for a in range(0, len(string), 8192):
                part = slice(a, a + 8192)
                strings = [data[x:y] for x, y in zip(low[part].tolist(), (low[part] + size[part] + (length - 1)).tolist(), strict=True)]
                c1, c2 = _digests(strings)
                cols = [*(b.column(i).to_numpy()[string[part]] for i in range(4)), hashed[part], c1, c2, start[part].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(strings if anchor < length else [b""] * len(strings), pa.binary())], names=["a", "p1", "p2", "copies", *_RUN, "start", "bytes"])

    return distinct.select(*_RUN, "copies", "bytes").mapInArrow(run, "a long, p1 long, p2 long, copies long, anchor long, c1 long, c2 long, start int, bytes binary")


def _repeated(distinct: DataFrame, length: int, finer: tuple[int, ...]) -> DataFrame:
    """(anchor, c1, c2, spans) of each run with starts that repeat. distinct is staged: a row a different run."""
    if not finer:  # whole passages: equal ones have equal digests
        one = F.array(F.struct(F.lit(0).alias("low"), F.lit(1).alias("high")))
        return distinct.where("copies > 1").select(*_RUN, one.alias("spans"))
    large = distinct.groupBy("anchor").count().where(F.col("count") > MOST_RUNS).select("anchor")
    large = staged(large, "large-anchors")
    if large.isEmpty():
        return _sorted_spans(distinct, length)
    parts = staged(_finer(distinct.join(large, "anchor", "left_semi"), length, finer[0]), "finer-runs")
    again = staged(parts.groupBy(*_RUN).agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes")), "finer-distinct")
    found = staged(_repeated(again, length, finer[1:]), "finer-spans")
    span = F.explode("spans").alias("s")
    of = parts.select("a", "p1", "p2", *_RUN, "start").join(found, _RUN).select("a", "p1", "p2", "start", span)
    of = of.groupBy(F.col("a").alias("anchor"), F.col("p1").alias("c1"), F.col("p2").alias("c2"))
    of = of.agg(F.collect_set(F.struct((F.col("start") + F.col("s.low")).alias("low"), (F.col("start") + F.col("s.high")).alias("high"))).alias("spans"))
    return _sorted_spans(distinct.join(large, "anchor", "left_anti"), length).unionByName(of)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, other, spans): where passages of `length` bytes that also start anywhere else lie in each different text of
    docs(text) that has any; key and other together identify the text; spans are [low, high) of starts, in no order.

    Staged tables in the shared folder hold the runs (slim: no bytes), those whose anchor recurs, and their bytes.
    """
    every = staged(_anchored(docs, length), "runs")
    recurs = staged(every.groupBy("anchor").agg(F.sum("often").alias("often")).where("often > 1").select("anchor"), "recurring-anchors")
    wanted = every.join(recurs, "anchor", "left_semi").groupBy("key").agg(F.collect_set(F.struct("anchor", "start", "size")).alias("runs"))
    wanted = staged(wanted, "wanted-runs")
    cut = staged(_cut(docs, wanted, length), "cut-runs")
    for done in (every, recurs, wanted):
        release(done)
    distinct = cut.groupBy(*_RUN).agg(F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"))
    distinct = staged(distinct, "distinct-runs")
    found = staged(_repeated(distinct, length, (*ANCHORS[1:], length)), "repeated-spans")
    places = cut.select("key", "other", *_RUN, "start").join(found, _RUN).select("key", "other", "start", F.explode("spans").alias("s"))
    spans = places.groupBy("key", "other").agg(F.collect_set(F.struct((F.col("start") + F.col("s.low")).alias("low"), (F.col("start") + F.col("s.high")).alias("high"))).alias("spans"))
    spans = staged(spans, "text-spans")
    for done in (cut, distinct, found):
        release(done)
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row a document: doc_id, n_bytes, removed (array of [low, high) of the runs of removed bytes, in order), kept
    (binary, the remaining bytes).

    A byte is removed if it lies in a string of `length` bytes that also starts anywhere else, in this document or
    another, as the input has them. Null texts are empty; texts shorter than `length` are kept whole; rows with equal
    texts of at least `length` bytes lose all; an id may be null or stand on several rows, each a document of its own;
    no documents give none; other columns are ignored. A text may be cut between bytes of a character, so `kept` is
    binary.
    """
    settle(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    spans = repeated_spans(docs, length)
    keyed = docs.withColumns({"key": _key(1), "other": _key(2)})
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = _flat(b.column(1))
            data = flat.tobytes()
            lists = b.column(2)
            fields = lists.flatten()
            low, high = (fields.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            at = lists.offsets.to_numpy()
            at = at - at[0]
            removed, kept = [], []
            for i in range(b.num_rows):
                own = slice(at[i], at[i + 1])
                by = np.argsort(low[own])
                begin, end = low[own][by], np.maximum.accumulate(high[own][by]) + (length - 1)
                first = np.append(True, begin[1:] > end[:-1])  # what touches the span before goes on with it
                begin, end = begin[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]
                text = data[offsets[i] : offsets[i + 1]]
                removed.append([{"low": x, "high": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
                kept.append(b"".join([text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)]))
            n_bytes = pa.array(offsets[1:] - offsets[:-1], pa.int64())
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(removed, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    kind = f"doc_id {id_type}, n_bytes long, removed array<struct<low:int,high:int>>, kept binary"
    touched = _with(keyed, spans, ["key", "other"]).select("doc_id", "text", "spans").mapInArrow(run, kind)
    none = F.array().cast("array<struct<low:int,high:int>>")
    whole = keyed.join(F.broadcast(spans.select("key", "other")) if spans.count() <= BROADCAST_ROWS else spans.select("key", "other"), ["key", "other"], "left_anti")
    return touched.unionByName(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("removed"), F.encode("text", "UTF-8").alias("kept")))
