"""What filters do to each other in every order: counts of failure masks by part, and a walk over all orders by swaps.

One pass gives every row the set of filters that it fails, as bits; rows are counted by part and mask, at most two to the
power of the filters a part. The walk then visits all orders of the filters, each by a swap of two neighbours of the one
before, and computes anew the two steps that the swap touches; the Shapley sums grow along the walk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, tidy

FEW_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SIGNS = "#$%&*|"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Filters in the bits of a mask, from the least.
FILTERS = "ABCDE"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def swaps(n: int) -> Iterator[int]:
    """The places k at which neighbours k and k + 1 change, one after another, until all orders of n have been visited."""
    order, way = list(range(n)), [-1] * n
    while True:
        # the largest that can still go its way
        for x in reversed(range(n)):
            at = order.index(x)
            to = at + way[x]
            if 0 <= to < n and order[to] < x:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(at, to)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = n < FEW_WORDS
    b = 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n
    capitals = F.char_length(text) - F.char_length(F.translate(text, _CAPITALS, ""))
    c = 100 * capitals > MOST_CAPITALS * F.char_length(text)
    d = F.char_length(F.translate(text, SIGNS, "")) < F.char_length(text)
    return sum((f.cast("int") * (1 << i) for i, f in enumerate((a, b, c, d))), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled so, by part and the set of filters that they fail.

    A document fails E if an equal text has a smaller id: for this, rows are counted by text, id and part, the least id
    of each text is found, and the rows that have it are subtracted from all; no group of equal texts comes together.
    Texts are equal if their SHA-256 are. Null texts are empty; a null id is neither smaller nor larger than another; a
    null part is the empty string; rows that repeat count each; a document is good or toxic if any of its labels is.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"),
    )
    rows = rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = staged(rows.join(staged(known.where("id is not null"), "audit-labels"), "id", "left"), "audit-rows")
    least = staged(rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")), "audit-least")
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")]
    every = rows.groupBy("part", "mask").agg(*sums)
    first = rows.join(least, ["digest", "id"], "left_semi").unionByName(rows.where("id is null")).groupBy("part", "mask").agg(*sums)
    later = F.lit(1 << 4)
    both = every.withColumn("mask", F.col("mask") + later).unionByName(first)
    both = both.unionByName(first.select("part", (F.col("mask") + later).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")]))
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def walk(counts: np.ndarray, names: str = FILTERS) -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and (orders, steps, parts, 7) counts as in _COUNTS, of counts (parts, masks, 3).

    Steps that a swap leaves alone are taken over; the two it touches are summed anew over the mask cells.
    """
    n = len(names)
    masks = np.arange(1 << n)
    unique = [counts[:, 1 << f, 0] for f in range(n)]

    def step(before: int, f: int) -> np.ndarray:
        fails = masks >> f & 1 == 1
        free = masks & before == 0
        gone = counts[:, fails & free].sum(axis=1)
        kept = counts[:, free & ~fails, 0].sum(axis=1)
        again = counts[:, fails & ~free, 0].sum(axis=1)
        return np.stack([kept, gone[:, 0], again, unique[f], gone[:, 1], gone[:, 2], np.zeros_like(kept)], axis=-1)

    def before(k: int) -> int:
        return sum(1 << f for f in order[:k])

    order = list(range(n))
    now = np.stack([step(before(k), order[k]) for k in range(n)])
    shapley = np.zeros((n, len(counts)), dtype=np.int64)
    orders, found = [], []

    def visit() -> None:
        orders.append("".join(names[f] for f in order))
        found.append(now.copy())
        for k, f in enumerate(order):
            shapley[f] += now[k, :, 1]

    visit()
    for k in swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        now[k], now[k + 1] = step(before(k), order[k]), step(before(k + 1), order[k + 1])
        visit()
    out = np.stack(found)
    for o, name in enumerate(orders):
        for k, f in enumerate(name):
            out[o, k, :, 6] = shapley[names.index(f)]
    return orders, out


def audit(docs: DataFrame, labels: DataFrame, **cols: str) -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, and the counts of the walk.

    See `cells` for nulls and repeats; no documents give no rows; other columns are ignored. A task holds some parts'
    cells at a time: 32 a part.
    """
    parts = cells(docs, labels, **cols).groupBy("part").agg(*[F.sum(F.when(F.col("mask") == m, F.col(c))).alias(f"{c}{m}") for m in range(1 << len(FILTERS)) for c in ("n", "good", "toxic")])
    held = F.array(*[F.coalesce(f"{c}{m}", F.lit(0)).cast("long") for m in range(1 << len(FILTERS)) for c in ("n", "good", "toxic")])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                orders, got = walk(b.column(1).flatten().to_numpy().reshape(b.num_rows, 1 << len(FILTERS), 3))
                n = b.num_rows
                name = pa.array(orders).take(pa.array(np.repeat(np.arange(len(orders)), len(FILTERS) * n)))
                step = np.tile(np.repeat(np.arange(1, len(FILTERS) + 1), n), len(orders))
                part = b.column(0).take(pa.array(np.tile(np.arange(n), len(orders) * len(FILTERS))))
                flat = got.reshape(-1, len(_COUNTS))
                yield pa.RecordBatch.from_arrays([part, name, pa.array(step.astype(np.int32)), *[pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(_COUNTS))]], names=["part", "filter_order", "step", *_COUNTS])

    return parts.select("part", held.alias("cells")).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))
