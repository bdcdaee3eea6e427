"""N-gram Jaccard self-join: MinHash banding, a shuffle on band hashes, verification on whole n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import append_columns, mix, odd_constants, pieces_of, staged, tidy, word_hashes
from tessera.llm.components import components

WORDS_A_GRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 256
#: Members of a block and grams in it, about; a task verifies the pairs of two blocks at most.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Members of a band that are compared by their sketches in one piece; larger bands are cut into such blocks.
BAND_BLOCK = 1024
#: Rows of a broadcast table at most (about 40 bytes each).
BROADCAST_ROWS = 200_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which pairs at the threshold share a band with probability `recall`."""
    for rows in range(most, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall with so few hashes")


def gram_sets(texts: pa.Array, size: int = WORDS_A_GRAM) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-grams; a shorter text that has words is one gram."""
    first, h = word_hashes(texts)
    mul = odd_constants(size, 97)
    out = []
    if len(h) >= size:
        grams = h[: len(h) - size + 1] * mul[0]
        for k in range(1, size):
            grams = grams + h[k : len(h) - size + 1 + k] * mul[k]
        grams = mix(grams)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * mul[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


class Bander:
    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        self.mul = odd_constants(bands * rows, 3, 32)
        self.flip = odd_constants(bands * rows, 5, 32)
        self.fold = odd_constants(rows, 7)
        self.own = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def keys(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        """A 64-bit key for each band, which also tells bands apart; and the sketch: eight bits of each MinHash."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        low = np.empty(self.bands * self.rows, dtype=np.uint32)
        step = max(1, min(len(low), (1 << 17) // max(1, len(x))))
        for i in range(0, len(low), step):
            low[i : i + step] = ((x[None, :] ^ self.flip[i : i + step, None]) * self.mul[i : i + step, None]).min(axis=1)
        sketch = (low & np.uint32(255)).astype(np.uint8).tobytes()
        return mix((low.astype(np.uint64).reshape(self.bands, self.rows) * self.fold).sum(axis=1) + self.own).view(np.int64), sketch


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, size: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, key, n_grams, bands, sketch): a hash of each document's text; the key and size of its set of grams,
    its band keys and sketch (null without words)."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Bander(bands, rows)
        for batch in batches:
            for b in pieces_of(batch):
                sets = gram_sets(b.column(2), size)
                got = [(set_key(s), len(s), *made.keys(s)) if len(s) else (None,) * 4 for s in sets]
                key, n, keys, sketch = zip(*got, strict=True) if got else ((),) * 4
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "th", "key", "n_grams", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, th long, key binary, n_grams int, bands array<long>, sketch binary")


def likely(threshold: float, hashes: int) -> float:
    """The share of equal MinHashes below which a pair at the threshold falls in about one of 300,000 cases."""
    return threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / hashes)


def leaders(sketches: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges (member, other) of a forest that connects all whose sketches are alike, so there are fewer than members.

    A member is compared with the leaders, and one that is like none of them leads; then members of groups that nothing
    connects so far are compared with each other. Copies of one text are one group, so they make no pairs.
    """
    n = len(sketches)
    group, every, out = np.full(n, -1), np.arange(n), []  # group: the leader of the connected groups
    need = least * sketches.shape[1]

    def like(i: int, at: np.ndarray) -> np.ndarray:
        return at[(sketches[at] == sketches[i]).sum(axis=1) >= need]

    def connect(i: int, hit: np.ndarray) -> None:
        """One edge from i to each group among the hits, which become one with its own."""
        for g in np.unique(group[hit]).tolist():
            if g != group[i]:
                out.append((int(hit[group[hit] == g][0]), i))
                group[group == g] = group[i]

    led = np.zeros(n, dtype=bool)
    for i in range(n):
        if group[i] < 0:
            group[i] = i
            hit = like(i, every)
            fresh = hit[group[hit] < 0]
            out += [(j, i) for j in fresh.tolist()]
            group[fresh], led[fresh] = i, True
            connect(i, hit)
    for i in np.flatnonzero(led).tolist():
        if len(np.unique(group)) == 1:
            break
        rest = np.flatnonzero(led & (group != group[i]))
        if len(rest):
            connect(i, like(i, rest))
    return out


def _connect(least: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["band", "key"], ignore_index=True)
        keys, band = pdf["key"].to_numpy(), pdf["band"].to_numpy()
        sketches = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(len(pdf), -1)
        first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        size = np.diff(first, append=len(band))
        edges = []
        few = size[np.searchsorted(first, np.arange(len(band)), side="right") - 1] <= 16
        for gap in range(1, 16):  # pairs of small bands, all bands at a time
            i = np.flatnonzero(few[: len(band) - gap] & (band[gap:] == band[: len(band) - gap]))
            if not len(i):
                break
            i = i[(sketches[i] == sketches[i + gap]).mean(axis=1) >= least]
            edges += zip((i + gap).tolist(), i.tolist(), strict=True)
        for a, n in zip(first.tolist(), size.tolist(), strict=True):
            if n > 16:
                edges += [(a + j, a + i) for j, i in leaders(sketches[a : a + n], least)]
        # of the edges of all bands, a forest leaves the task
        number, _ = pd.factorize(keys)
        root, forest = list(range(len(keys))), []

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in edges:
            x, y = top(int(number[a])), top(int(number[b]))
            if x != y:
                root[max(x, y)] = min(x, y)
                forest.append((a, b))
        a, b = np.array(forest, dtype=np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": keys[a], "b": keys[b]})

    return run


def alike_in_bands(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): edges between keys of nodes that share a band and whose sketches are alike, enough to connect all such pairs.

    Bands of one node are dropped. Small bands share tasks; a band of more than BAND_BLOCK nodes is cut into blocks, of
    which a task gets two, so no band meets in one task. Only keys and sketches are sent.
    """
    posted = nodes.select("key", "sketch", F.explode("bands").alias("band"))
    shared = staged(posted.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    count, rows = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= BROADCAST_ROWS:
        near = posted.join(F.broadcast(shared), "band")
    else:  # bands of so many nodes are few, and their rows aren't dealt by band
        hot = shared.where(F.col("n") > max(BAND_BLOCK, rows // BROADCAST_ROWS))
        near = posted.join(F.broadcast(hot), "band")
        near = near.unionByName(posted.join(F.broadcast(hot.select("band")), "band", "left_anti").join(shared, "band"))
    groups = max(1, rows // (4 * BAND_BLOCK))
    near = near.withColumn("k", F.ceil(F.col("n") / BAND_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    near = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    task = F.when(F.col("k") == 1, F.pmod(F.xxhash64("band"), F.lit(groups))).otherwise(F.xxhash64("band"))
    near = near.withColumns({"task": task, "wide": F.col("k") > 1, "low": F.least("block", "other"), "high": F.greatest("block", "other")})
    near = near.select("task", "wide", "low", "high", "band", "key", "sketch")
    return near.groupBy("task", "wide", "low", "high").applyInPandas(_connect(least), "a binary, b binary")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, cluster: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The pairs (i, j), i of left, j of right, of one cluster and of Jaccard similarity `threshold` or more.

    Shared grams are counted through an inverted index, so sets that share nothing cost nothing.
    """
    size = np.array([len(s) for s in sets])
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.repeat(np.arange(len(sets)), size)
    into = np.isin(own, right)
    order = np.argsort(gram[into], kind="stable")
    holders, held = own[into][order], gram[into][order]
    begin = np.searchsorted(held, np.arange(gram.max() + 2))
    at = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i in left:
        g = gram[at[i] : at[i + 1]]
        n = begin[g + 1] - begin[g]
        total = int(n.sum())
        if not total:
            continue
        spots = np.repeat(begin[g] - np.cumsum(n) + n, n) + np.arange(total)
        both = np.bincount(holders[spots], minlength=len(sets))
        # in whole numbers, so that a similarity of exactly the threshold counts
        hit = np.flatnonzero((both > 0) & (cluster == cluster[i]) & (both + 1e-9 >= threshold * (size + size[i] - both)))
        out += [(int(i), int(j)) for j in hit if j != i]
    return out


def _verify(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").reset_index(drop=True)
        low, high = int(key[1]), int(key[2])
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["grams"]]
        block, many = pdf["block"].to_numpy(), pdf["many"].to_numpy()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        pairs = overlaps(sets, left, right, pd.factorize(pdf["cluster"])[0], threshold) if len(left) and len(right) else []
        links = np.zeros(len(pdf), dtype=np.int64)
        root = list(range(len(pdf)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in pairs:
            links[i] += many[j]
            if low != high:
                links[j] += many[i]
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        hub = pdf["key"].to_numpy()[[top(i) for i in range(len(pdf))]] if len(pdf) else []
        return pd.DataFrame({"key": pdf["key"], "hub": hub, "links": links})[links > 0]

    return run


def jaccard_classes(docs: DataFrame, size: int = WORDS_A_GRAM, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, class_id, n_links, set_key (hex).

    n_links is the number of other documents whose n-gram sets have a Jaccard similarity of `threshold` or more, equal
    ones included; class_id is the least doc_id among all that such links connect (its own for a document without).

    Documents with equal sets are one node with a count, so copies aren't compared. Nodes that share a band are compared
    by their sketches (eight bits of each MinHash), and those alike enough to reach the threshold are joined to clusters,
    so what merely shares a band links nothing; within a cluster all pairs are verified on whole sets, in blocks of
    bounded size, of which only counts and a spanning forest leave the task. Null and empty texts, and texts without words, have no links and
    are classes of their own; where doc_ids repeat, each row counts as a document (rows without links and with an equal
    doc_id then show one class_id); null ids come out as they are. An empty table gives none; other columns are ignored.
    """
    return _classed(docs, size, threshold, recall, most_hashes, id_col, text_col).drop("label")


def _classed(docs: DataFrame, size: int, threshold: float, recall: float, most_hashes: int, id_col: str, text_col: str) -> DataFrame:
    """jaccard_classes with `label`, the least key of the class (null without words): doc_ids that repeat don't name a class."""
    bands, rows = banding(threshold, recall, most_hashes)
    marked = staged(signed(docs, size, bands, rows, id_col, text_col), "signed")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")  # the row whose text is read again
    nodes = marked.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("many"), rep, F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes.select("key", "many", F.col("rep.doc_id").alias("first"), F.col("rep.th").alias("th"), "n_grams", "bands", "sketch"), "nodes")

    near = staged(alike_in_bands(nodes, likely(threshold, bands * rows)), "near")
    cluster = staged(components(near), "clusters").withColumnsRenamed({"node": "key", "label": "cluster"})

    # members of a cluster in blocks by hash; each pair of blocks is a tile, and small clusters share tiles
    members = cluster.join(nodes.select("key", "many", "first", "th", "n_grams"), "key")
    members = staged(members, "cluster-members")
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("k"))
    members = members.join(staged(blocks, "cluster-blocks"), "cluster")
    members = staged(members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("k")).cast("int")), "members")
    total, n_grams = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_grams"), F.lit(0))).first()
    text = docs.select(F.col(id_col).alias("first"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    side = F.broadcast(members) if total <= BROADCAST_ROWS else members
    same_row = F.col("t.first").eqNullSafe(F.col("m.first")) & (F.col("t.th") == F.col("m.th"))
    found = text.alias("t").join(side.alias("m"), same_row).select("m.key", "m.cluster", "m.k", "m.block", "m.many", "t.text")

    @tidy
    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_of(batch):
                sets = gram_sets(b.column(5), size)
                # documents may share an id: those with another set are dropped here
                same = pa.array([len(s) > 0 and set_key(s) == k for s, k in zip(sets, b.column(0).to_pylist(), strict=True)], pa.bool_())
                cols = [*b.columns[:5], pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "cluster", "k", "block", "many", "grams"]).filter(same)

    found = found.mapInArrow(grams, "key binary, cluster binary, k int, block int, many long, grams binary")
    shared = max(1, total // BLOCK, n_grams // BLOCK_GRAMS)
    tile = F.when(F.col("k") == 1, F.pmod(F.xxhash64("cluster"), F.lit(shared)).cast("string")).otherwise(F.hex("cluster"))
    tiles = found.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tiles = tiles.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    linked = staged(tiles.select("tile", "low", "high", "key", "cluster", "block", "many", "grams").groupBy("tile", "low", "high").applyInPandas(_verify(threshold), "key binary, hub binary, links long"), "links")

    label = components(linked.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    each = nodes.select("key", "many", "first").join(label.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    each = staged(each.select("key", "many", "first", F.coalesce("label", "key").alias("label"), F.coalesce("links", F.lit(0)).alias("links")), "each")
    least = staged(each.where("label <> key or links > 0").groupBy("label").agg(F.min("first").alias("class_id")), "least")
    each = each.join(least, "label", "left").select("key", "label", F.coalesce("class_id", "first").alias("class_id"), (F.col("many") - 1 + F.col("links")).alias("n_links"))
    out = marked.select("doc_id", "key").join(each, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.lower(F.hex("key")).alias("set_key"), "label")


def drop_near_duplicates(docs: DataFrame, size: int = WORDS_A_GRAM, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class: that with the least doc_id. All columns stay.

    Where doc_ids repeat, a class is its texts' (of its rows with the least doc_id one stays), so no text goes without
    one like it that stays; rows without words stay, and so do rows with a null doc_id, as nothing tells them apart.
    """
    found = staged(_classed(docs, size, threshold, recall, most_hashes, id_col, text_col), "classes")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if again:  # a doc_id on several rows: they are told apart by their sets
        from pyspark.sql import Window

        least = found.where("doc_id is not null and label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "set_key")).alias("r"))
        keep = least.select(F.col("r.doc_id").alias("__id"), F.col("r.set_key").alias("__set"))
        key = T.StructField("__key", T.StringType())
        keyed = append_columns(docs, [text_col], [key], lambda: lambda texts: [[set_key(s).hex() if len(s) else None for s in gram_sets(texts, size)]])
        free = keyed.where(F.col(id_col).isNull() | F.col("__key").isNull()).drop("__key")
        kept = keyed.where("__key is not null").join(keep, (keyed[id_col] == F.col("__id")) & (F.col("__key") == F.col("__set")), "left_semi")
        plain = [c for c in docs.columns if c != id_col]
        kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "__key").orderBy(*[F.col(f"`{c}`").cast("string") for c in plain])))
        return kept.where("__n = 1").drop("__n", "__key").unionByName(free)
    drop = found.where("doc_id is not null and doc_id <> class_id").select(F.col("doc_id").alias("__drop")).distinct()
    drop = staged(drop, "dropped")
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, docs[id_col] == F.col("__drop"), "left_anti")
