"""Vector, full-text and hybrid retrieval, deduplication and near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.english import cover_density
from tessera.functions.vectors import cosine_to
from tessera.operators.filters import at, comparable, searchable
from tessera.plans.lineage import stored

# fixed values
DUPLICATE, CONTRADICTION, CLUSTER, LINK = 0.95, 0.80, 0.88, 0.80
RRF_K, OVERFETCH, MMR_OVERFETCH = 60, 3, 4
WEIGHT = {"vector": 0.35, "text": 0.25, "category": 0.20, "age": 0.10, "hits": 0.10}
CATEGORY = {"constraint": 1.0, "instruction": 0.80, "lesson": 0.75, "fact": 0.50, "preference": 0.25}
DECAY = {"constraint": 0.0, "instruction": 0.005, "lesson": 0.01, "fact": 0.005, "preference": 0.02}
BOOST = 2.0
#: Components of the vectors of a block at most; blocks a group at least, so far as each has TILE rows; rows and columns of a
#: product at a time, and pairs worked out at a time.
HELD, SOME, TILE, CHUNK = 1 << 22, 8, 2048, 1 << 15
#: Groups of several blocks whose numbers of blocks are sent to all tasks at most.
BROADCAST_ROWS = 100_000
#: Copies of a vector that are one list at most, ids of a list that is turned into pairs, pairs a task makes of lists, such tasks.
COPIES, LISTED, MADE, MAKERS = 1 << 20, 512, 1 << 20, 2000


def vector_top_k(df: DataFrame, vector: Sequence[float], k: int, project: int | None = None, col: str = "embedding") -> DataFrame:
    """The k nearest rows with score = cosine, doubled for rows of `project`.

    The order is by distance, halved for that project: not the same as by score. The id breaks ties.
    """
    sim = cosine_to(col, vector)
    boost = F.lit(1.0) if project is None else F.when(F.col("project_id") == project, BOOST).otherwise(1.0)
    found = df.where(F.col(col).isNotNull()).withColumn("__sim", sim).withColumn("__boost", boost)
    found = found.withColumn("score", F.col("__sim") * F.col("__boost")).orderBy((1 - F.col("__sim")) / F.col("__boost"), "id").limit(k)
    return found.drop("__sim", "__boost")


def similar_rules(rules: DataFrame, vector: Sequence[float], project: int, low: float, high: float | None = None, k: int = 5) -> DataFrame:
    """Rules of a project with low <= similarity (< high), the nearest first: duplicates, or the contradiction band."""
    found = rules.where(comparable() & (F.col("project_id") == project)).withColumn("similarity", cosine_to("embedding", vector)).where(F.col("similarity") >= low)
    found = found if high is None else found.where(F.col("similarity") < high)
    return found.orderBy(F.desc("similarity"), "id").limit(k)


def _blocks(block: int | None) -> Column:
    """Into how many blocks a group of rows (v) is cut: of `block` rows, or as few as HELD allows, yet enough for SOME."""
    n = F.count(F.lit(1))
    return F.ceil(n / block if block else F.greatest(n * F.max(F.size("v")) / HELD, F.least(n / TILE, F.lit(SOME)))).cast("int")


def _unit(vectors: Sequence) -> np.ndarray:
    """Rows at unit length, each worked out by itself, so equal vectors give equal rows anywhere; zero vectors stay."""
    m = np.array(list(vectors), dtype=np.float64)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] . b[j] for each place, the same wherever a pair stands (a matrix product's last digits depend on that)."""
    out = np.empty(len(i))
    for x in range(0, len(i), CHUNK):
        out[x : x + CHUNK] = (a[i[x : x + CHUNK]] * b[j[x : x + CHUNK]]).sum(axis=1)
    return out


def _slack(width: int) -> float:
    """How far a single-precision product of unit vectors may be off."""
    return 1e-6 + width * 1.2e-7


def _block_pairs(low: float, k: int | None = None, digits: int = 12, copies: bool = False):
    """The pairs of two blocks from `low` on, tile by tile; with k only the k first, so the limit rises with what is found.

    With `copies` an id is a number, each is there once, and one whose `many` is set pairs with itself, too.
    """

    def pairs(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, best = low, pd.DataFrame({"a": [], "b": [], "similarity": []})
        pdf = pd.concat(list(batches), ignore_index=True)
        m, ids = _unit(pdf["v"]), pdf["id"].to_numpy()
        slim, slack = m.astype(np.float32), _slack(m.shape[1])
        left, right = (np.flatnonzero(pdf["block"].to_numpy() == key[i]) for i in (1, 2))
        for x in range(0, len(left), TILE):
            for y in range(x if key[1] == key[2] else 0, len(right), TILE):
                at, to = left[x : x + TILE], right[y : y + TILE]
                i, j = np.nonzero(slim[at] @ slim[to].T >= least - slack)
                if key[1] == key[2] and x == y:
                    i, j = i[i < j], j[i < j]
                i, j = at[i], to[j]
                s = _dots(m, i, m, j)
                near = s >= least - 1e-12
                a, b, s = ids[i[near]], ids[j[near]], s[near]
                swap, once = a > b, a != b
                found = pd.DataFrame({"a": np.where(swap, b, a)[once], "b": np.where(swap, a, b)[once], "similarity": s[once]})
                if k is None:
                    yield found
                elif len(found):
                    best = pd.concat([best, found]) if len(best) else found
                    best = best.assign(by=-best["similarity"].round(digits)).sort_values(["by", "a", "b"]).head(k).drop(columns="by")
                    least = max(low, best["similarity"].min() - 2 * 10.0**-digits) if len(best) == k else low
        if copies and key[1] == key[2]:
            i = left[pdf["many"].to_numpy(dtype=bool)[left]]
            s = _dots(m, i, m, i)
            near = s >= low - 1e-12
            yield pd.DataFrame({"a": ids[i[near]], "b": ids[i[near]], "similarity": s[near]})
        if len(best):
            yield best

    return pairs


def similar_pairs(df: DataFrame, low: float, within: str | None = None, block: int | None = None, col: str = "embedding", fresh: str | None = None, k: int | None = None, digits: int = 12, places: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with cosine >= low, of equal `within` where one is given.

    Rows are cut into blocks of bounded size by a hash; a task compares two blocks of one group tile by tile, so no task
    holds more than two and each pair is met once. A vector is copied once for each block of its group, and a block has
    HELD components. Exact: what a single-precision product finds is worked out in double precision, pair by pair. Null
    and zero vectors pair with nothing. Equal vectors of a group are compared once; the pairs of their ids are made of lists
    afterwards, where most pairs are those of copies. Similarities are rounded to `places`, if given, before that. With
    `fresh`, a boolean column, pairs of which neither is fresh are neither asked for nor made: blocks are of fresh rows or
    of others, and others meet fresh blocks only. With k two blocks make only their k first pairs (ids break ties of
    similarities equal to `digits` places).
    """
    shown = lambda d: d if places is None else d.withColumn("similarity", F.round("similarity", places))
    if fresh:
        return shown(_fresh_pairs(df, low, within, block, col, fresh))
    keys = [F.col(within).alias("g")] if within else [F.lit(0).alias("g")]
    rows = df.where(F.col(col).isNotNull()).select(*keys, F.col("id"), F.col(col).alias("v"))
    if k is None:
        # a list has the ids of one vector, or of a part of its copies if there may be more than COPIES
        parts = F.ceil(F.lit(rows.count() / COPIES)).cast("long")
        lists = rows.groupBy("g", "v", F.pmod(F.xxhash64("id"), F.greatest(parts, F.lit(1))).alias("part")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
        lists = stored(lists.select("g", "v", "ids", (F.size("ids") > 1).alias("many"), F.monotonically_increasing_id().alias("at")), "equal-vectors")
        if not lists.where("many").isEmpty():
            return _listed_pairs(lists, shown(_compared(lists.select("g", F.col("at").alias("id"), "v", "many"), low, block, digits=digits, copies=True)))
        rows = lists.select("g", F.col("ids")[0].alias("id"), "v")
    return shown(_compared(rows, low, block, k, digits))


def _compared(rows: DataFrame, low: float, block: int | None, k: int | None = None, digits: int = 12, copies: bool = False) -> DataFrame:
    """(a, b, similarity) of rows (g, id, v), by _block_pairs on two blocks of a group."""
    # only groups of several blocks are looked up, so that vectors need not be dealt by group for it
    sizes = stored(rows.groupBy(F.col("g").alias("h")).agg(_blocks(block).alias("k")).where("k > 1"), "block-counts")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    rows = rows.join(sizes, F.col("g").eqNullSafe(F.col("h")), "left").drop("h").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "v", *["many"] * copies)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.groupBy("g", "lo", "hi").applyInPandas(_block_pairs(low, k, digits, copies), f"a {kind}, b {kind}, similarity double")


def _listed_pairs(lists: DataFrame, alike: DataFrame) -> DataFrame:
    """(a, b, similarity) of the ids in lists (at, ids) whose numbers are `alike`.

    Lists are cut into pieces of LISTED ids, pairs of pieces are dealt to tasks by a hash, and each makes its pairs as it
    goes, so that neither a long list nor the many pairs are held anywhere.
    """
    alike = stored(alike, "alike-vectors")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / LISTED).cast("int")), lambda i: F.slice("ids", i * LISTED + 1, LISTED))
    piece = lambda n: lists.select(F.col("at").alias(n), F.posexplode(cut).alias(f"{n}_piece", f"{n}_ids"))
    both = alike.join(piece("a"), "a").join(piece("b"), "b").where("a <> b OR a_piece <= b_piece")
    long = lists.select("at", F.size("ids").cast("double").alias("n"))
    made = alike.join(long.withColumnRenamed("at", "a"), "a").join(long.select(F.col("at").alias("b"), F.col("n").alias("m")), "b")
    made = made.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n") * F.col("m") / 2).otherwise(F.col("n") * F.col("m")))).first()[0] or 0
    both = both.repartition(max(1, min(MAKERS, round(made / MADE))), F.xxhash64("a", "b", "a_piece", "b_piece"))
    both = both.withColumn("own", F.expr("a = b AND a_piece = b_piece"))
    each = both.select("similarity", "own", "b_ids", F.explode("a_ids").alias("x")).select("similarity", "own", "x", F.explode("b_ids").alias("y"))
    return each.where("x < y OR (x > y AND NOT own)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def top_pairs(df: DataFrame, low: float = CLUSTER, k: int = 20, within: str | None = None, digits: int = 12) -> DataFrame:
    """The k most similar pairs of similar_pairs(), as a report shows them; ids break ties."""
    return similar_pairs(df, low, within, k=k, digits=digits).orderBy(F.desc(F.round("similarity", digits)), "a", "b").limit(k)


def _fresh_pairs(df: DataFrame, low: float, within: str | None, block: int | None, col: str, fresh: str) -> DataFrame:
    rows = df.where(F.col(col).isNotNull()).select((F.col(within) if within else F.lit(0)).alias("g"), "id", F.col(col).alias("v"), F.col(fresh).alias("fresh"))
    sizes = rows.groupBy(F.col("g").alias("h"), "fresh").agg(_blocks(block).alias("k"))
    most = lambda c, name: F.coalesce(F.max(F.when(c, F.col("k"))), F.lit(0)).alias(name)
    sizes = sizes.groupBy("h").agg(most(F.col("fresh"), "kn"), most(~F.col("fresh"), "ko")).where("kn > 0")
    rows = rows.join(sizes, F.col("g").eqNullSafe(F.col("h"))).drop("h")
    # blocks 0..kn-1 are fresh, kn..kn+ko-1 are not; a fresh block meets all, another the fresh ones
    own = F.when(F.col("fresh"), F.pmod(F.xxhash64("id"), F.col("kn"))).otherwise(F.col("kn") + F.pmod(F.xxhash64("id"), F.col("ko"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("fresh"), F.col("kn") + F.col("ko") - 1).otherwise(F.col("kn") - 1))
    rows = rows.withColumn("block", own).withColumn("other", F.explode(others))
    rows = rows.select("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "v")
    kind = df.schema["id"].dataType.simpleString()
    return rows.groupBy("g", "lo", "hi").applyInPandas(_block_pairs(low), f"a {kind}, b {kind}, similarity double")


def nearest(queries: DataFrame, rows: DataFrame, k: int, others: bool = False, block: int | None = None, col: str = "embedding", within: str | None = None, digits: int = 12) -> DataFrame:
    """(query_id, id, score, rank): for each row of queries the k rows of highest cosine; `others` leaves out its own id.

    Equal vectors of a group are asked for once and of equal rows only the first ids stand, so copies cost no comparisons.
    Both sides are cut into blocks of bounded size by a hash; a task compares two blocks and sends on k rows a vector that
    is asked for. With `within` only rows of the query's own group are looked at, by blocks of the group. Exact; the id
    breaks ties (of cosines equal to `digits` places); null vectors are left out.
    """
    most = k + 1 if others else k
    sides = [df.where(F.col(col).isNotNull()).select((F.col(within) if within else F.lit(0)).alias("g"), "id", F.col(col).alias("v")) for df in (queries, rows)]
    # a vector that is asked for is known by the least id that has it; of equal rows no more than `most` can be among the first
    alike = Window.partitionBy("g", "v").orderBy("id")
    members = sides[0].select("id", F.first("id").over(alike).alias("rep"), F.row_number().over(alike).alias("at"), "g", "v")
    firsts = members.where(F.col("at") == 1).select("g", "id", "v")
    held = sides[1].withColumn("at", F.row_number().over(Window.partitionBy("g", "v").orderBy("id"))).where(F.col("at") <= most).drop("at")
    sizes = [d.groupBy("g").agg(_blocks(block).alias(n)) for d, n in ((firsts, "kq"), (held, "kr"))]
    many = sizes[0].join(sizes[1], "g")  # a row a group that has both
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = firsts.join(many, "g").select("g", F.lit(True).alias("asks"), "id", "v", own("kq").alias("left"), every("kr").alias("right"))
    right = held.join(many, "g").select("g", F.lit(False).alias("asks"), "id", "v", own("kr").alias("right"), every("kq").alias("left"))

    kind, query_kind = (df.schema["id"].dataType.simpleString() for df in (rows, queries))
    near = left.unionByName(right).groupBy("g", "left", "right").applyInPandas(_block_nearest(most, digits), f"rep {query_kind}, id {kind}, score double")
    first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")))  # `most` a block at most
    top = near.groupBy("rep").agg(F.slice(first, 1, most).alias("top"))
    found = members.select(F.col("id").alias("query_id"), "rep").join(top, "rep")
    mine = F.filter("top", lambda x: x["id"] != F.col("query_id")) if others else F.col("top")
    found = found.select("query_id", F.posexplode(F.slice(mine, 1, k)).alias("at", "x"))
    return found.select("query_id", "x.id", (-F.col("x.s")).alias("score"), (F.col("at") + 1).alias("rank"))


def _block_nearest(k: int, digits: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("id", ignore_index=True)
        m = _unit(pdf["v"])
        fit = np.isfinite(m).all(axis=1)
        asks, ids, m = pdf["asks"].to_numpy(dtype=bool)[fit], pdf["id"].to_numpy()[fit], m[fit]
        q, r, asked, known = m[asks], m[~asks], ids[asks], ids[~asks]
        n = min(k, len(r))
        if not len(q) or not n:
            return
        slim, slack = r.astype(np.float32), 2 * _slack(m.shape[1]) + 10.0**-digits
        for x in range(0, len(q), TILE):
            mine = q[x : x + TILE].astype(np.float32)
            least, found = np.full(len(mine), -np.inf, dtype=np.float32), []
            for y in range(0, len(r), TILE):
                s = mine @ slim[y : y + TILE].T
                if y == 0 and s.shape[1] >= n:  # later tiles need only what reaches the first one's k-th
                    least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n] - np.float32(slack)
                i, j = np.nonzero(s >= least[:, None])
                found.append((i, j + y, s[i, j]))
            i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((-s, i))
            i, j, s = i[order], j[order], s[order]
            start = np.searchsorted(i, np.arange(len(mine)))
            near = s >= s[start + n - 1][i] - np.float32(slack)
            i, j = i[near], j[near]
            s = np.round(_dots(q, i + x, r, j), digits)
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.arange(len(i)) - np.searchsorted(i, np.arange(len(mine)))[i] < n
            yield pd.DataFrame({"rep": asked[i[first] + x], "id": known[j[first]], "score": s[first]})

    return best


# -- full text --------------------------------------------------------------------------------------------------------


def sanitised(query: str) -> str:
    """Terms joined by ' & ', without the query language's own signs; empty where nothing is left."""
    return " & ".join(t for t in (w.translate({ord(c): None for c in "'\\:&|!()"}) for w in query.split()) if t)


def has_words(query: str) -> bool:
    return any(set(w) - set("'\\:&|!()*") for w in query.split())


def terms(query: str) -> list[str]:
    import re

    return sorted(set(re.findall("[a-z0-9]+", query.lower())))


def matches(content: str | Column, query: str) -> tuple[Column, Column]:
    """(all terms occur, how often they occur together): the tier that SQL can follow."""
    words, wanted = tx.tokens(content), F.array(*map(F.lit, terms(query)))
    return F.size(F.array_except(wanted, words)) == 0, F.size(F.filter(words, lambda w: F.array_contains(wanted, w)))


def said_order(df: DataFrame, query: str, english: bool) -> tuple[DataFrame, Column]:
    """The rows that match a query and the order of their text rank: by terms as they stand, or by stems and cover density."""
    if english:
        got = df.withColumn("__rank", cover_density("content", query)).where("__rank is not null")
        return got, -F.col("__rank")
    ok, count = matches("content", query)
    return df.where(ok), -count


def ranked(df: DataFrame, by: Column, limit: int, name: str) -> DataFrame:
    """(id, name): the first `limit` ranks in the order of `by`, then id. The limit is below the window, so its one
    partition never holds more than that."""
    top = df.withColumn("__by", by).select("id", "__by").orderBy("__by", "id").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy("__by", "id")).alias(name))


def first_ranks(df: DataFrame, orders: dict[str, Column], limit: int) -> DataFrame:
    """(kind, id, at): the first `limit` ranks of each kind, by its order (null: not ranked) and then the id, in one pass
    over df. Each task sends on `limit` rows a kind at most."""
    # each order is a column first, so that it is worked out once a row
    slim = df.select("id", *[by.cast("double").alias(f"__by_{kind}") for kind, by in orders.items()])
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"__by_{kind}").alias("by")) for kind in orders])
    rows = slim.select("id", F.explode(each).alias("x")).select("id", "x.kind", "x.by").where("by IS NOT NULL")
    at = F.row_number().over(Window.partitionBy("kind").orderBy("by", "id"))
    return rows.withColumn("at", at).where(F.col("at") <= limit)


def fused_ranks(ranks: DataFrame) -> DataFrame:
    """(id, v, t): reciprocal ranks of the kinds v and t, 0 where one lacks the id; ranks are few."""
    part = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.lit(1.0) / (RRF_K + F.col("at")))), F.lit(0.0)).alias(kind)
    return ranks.where(F.col("kind").isin("v", "t")).groupBy("id").agg(part("v"), part("t"))


def _text_side(pool: DataFrame, query: str, english: bool, index) -> tuple[DataFrame, Column]:
    """pool and the order of its text rank, null where the text doesn't match; with a text index no text is read."""
    if index is not None:
        said = index.matches(query).select("id", F.col("rank").alias("__said"))
        return pool.join(said, "id", "left"), -F.col("__said")
    if english:
        return pool.withColumn("__said", cover_density("content", query)), -F.col("__said")
    asked = terms(query)
    found = pool.withColumn("__said", F.filter(tx.tokens("content"), lambda w: w.isin(asked)))
    return found, F.when(F.size(F.array_distinct("__said")) == len(asked), -F.size("__said"))


def fused(vector_ranks: DataFrame, text_ranks: DataFrame) -> DataFrame:
    """(id, v, t): reciprocal ranks of both sides, 0 where one lacks the id."""
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    return vector_ranks.join(text_ranks, "id", "full").select("id", part("vr").alias("v"), part("tr").alias("t"))


def hybrid_rules(rules: DataFrame, vector: Sequence[float], query: str, k: int, as_of: str, project: int | None = None, only: DataFrame | None = None, english: bool = False, text_index=None) -> DataFrame:
    """Rules by weighted fusion of vector rank, text rank, category, age and hits, times weight and the project's boost.

    `only` narrows the candidates (project, tags and so on); the largest hit count is taken over all of `rules`, old
    ones too. Without words in the query it is a vector search. `english` matches stems without stop words and ranks by
    cover density; a TextIndex over the rules gives the text ranks (by its own kind of terms) without reading texts.
    """
    if not sanitised(query):
        return vector_top_k((rules if only is None else only).where(searchable(as_of)), vector, k, project)
    k = max(1, k)
    pool = (rules if only is None else only).where(searchable(as_of))
    # ranks of both sides in one pass; the largest hit count needs no column but its own
    seen, text = _text_side(pool, query, english, text_index)
    ranks = first_ranks(seen, {"v": F.when(F.col("embedding").isNotNull(), -cosine_to("embedding", vector)), "t": text}, k * OVERFETCH)
    most = rules.agg(F.greatest(F.max("hit_count"), F.lit(1)).alias("most"))  # one row
    rows = pool.join(F.broadcast(fused_ranks(ranks)), "id").crossJoin(F.broadcast(most))  # 6k rows at most, and one row
    by = lambda table: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("category"))
    used = F.coalesce("last_used_at", "created_at")
    age = (F.unix_micros(at(as_of).cast("timestamp")) - F.unix_micros(used.cast("timestamp"))) / 86_400_000_000.0
    total = (
        WEIGHT["vector"] * F.col("v") + WEIGHT["text"] * F.col("t") + WEIGHT["category"] * by(CATEGORY) + WEIGHT["age"] * F.exp(-by(DECAY) * age)
        + WEIGHT["hits"] * F.log1p("hit_count") / F.log1p("most")
    ) * F.coalesce("weight", F.lit(1.0))
    boost = F.lit(1.0) if project is None else F.when(F.col("project_id") == project, BOOST).otherwise(1.0)
    return rows.withColumn("score", total * boost).orderBy(F.desc("score"), "id").limit(k).drop("v", "t", "most")


def hybrid_chunks(chunks: DataFrame, vector: Sequence[float], query: str, k: int, path: str | None = None, english: bool = False, text_index=None) -> DataFrame:
    """Chunks by the plain sum of reciprocal ranks; `path` is a LIKE pattern; `english` and text_index as in hybrid_rules."""
    pool = chunks if path is None else chunks.where(F.col("file_path").like(path))
    if not has_words(query):
        return vector_top_k(pool, vector, k)
    seen, text = _text_side(pool, query, english, text_index)
    ranks = first_ranks(seen, {"v": F.when(F.col("embedding").isNotNull(), -cosine_to("embedding", vector)), "t": text}, k * OVERFETCH)
    scored = fused_ranks(ranks).select("id", (F.col("v") + F.col("t")).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return pool.join(F.broadcast(scored), "id")


def hit_updates(hits: DataFrame, as_of: str) -> DataFrame:
    """What a search adds to the counts of the rules it returned; applied by state.apply_hits, never inside a query."""
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("last_used_at", at(as_of))


def compact(hits: DataFrame) -> DataFrame:
    return hits.select("id", "category", tx.preview("content", 80).alias("content"), "score", "tags", "hit_count", "last_used_at")


def bucket(category: str | Column = "category", tags: str | Column = "tags") -> Column:
    c, t = (F.col(x) if isinstance(x, str) else x for x in (category, tags))
    avoid = (c == "constraint") | ((c == "lesson") & F.array_contains(t, "origin:abandoned"))
    return F.when(avoid, "avoid").when(c == "fact", "info").otherwise("do_strategies")


def grouped(hits: DataFrame) -> DataFrame:
    """(bucket, ids in rank order): always three rows."""
    spark = hits.sparkSession
    names = spark.createDataFrame([(b,) for b in ("avoid", "do_strategies", "info")], "bucket string")
    got = hits.withColumn("bucket", bucket()).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("x"))
    return names.join(got, "bucket", "left").select("bucket", F.coalesce(F.transform("x", lambda r: r["id"]), F.array().cast("array<bigint>")).alias("ids"))


# -- diversity --------------------------------------------------------------------------------------------------------


def mmr_order(query: np.ndarray, vectors: np.ndarray, k: int, diversity: float) -> list[int]:
    """Positions chosen by maximal marginal relevance; all in their order where there are k or fewer."""
    if len(vectors) <= k:
        return list(range(len(vectors)))
    lam = 1 - min(1.0, max(0.0, diversity))
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=-1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=-1, keepdims=True) > 0)
    v = unit(np.asarray(vectors, dtype=np.float64))
    relevance = v @ unit(np.asarray(query, dtype=np.float64))
    last_best = lambda at, x: at[len(at) - 1 - int(np.argmax(x[at][::-1]))]  # noqa: E731  of equal maxima the last
    left = np.arange(len(v))
    chosen = [int(last_best(left, relevance))]
    nearest = np.maximum(0.0, v @ v[chosen[0]])  # negative similarities count as none
    while len(chosen) < k:
        left = left[left != chosen[-1]]
        chosen.append(int(last_best(left, lam * relevance - (1 - lam) * nearest)))
        nearest = np.maximum(nearest, v @ v[chosen[-1]])
    return chosen


def mmr(candidates: DataFrame, k: int = 5, diversity: float = 0.3) -> DataFrame:
    """(query_id, id, rank) from candidates (query_id, query, id, rank, embedding); a query's are a few times k."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], ignore_index=True)
        order = mmr_order(np.array(pdf["query"].iloc[0]), np.array(pdf["embedding"].tolist()), k, diversity)[:k]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[order], "id": pdf["id"].iloc[order], "rank": range(1, len(order) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, id long, rank int")


def hybrid_chunks_diverse(chunks: DataFrame, vector: Sequence[float], query: str, k: int = 5, diversity: float = 0.3, path: str | None = None, english: bool = False) -> DataFrame:
    """hybrid_chunks with several times k candidates, of which k are chosen by maximal marginal relevance: with `rank`."""
    found = hybrid_chunks(chunks, vector, query, k * MMR_OVERFETCH, path, english)
    order = Window.orderBy(F.desc("score"), "id")  # a few times k rows
    asked = F.array(*[F.lit(float(x)) for x in vector])
    rows = found.where(F.col("embedding").isNotNull()).select(F.lit(0).cast("long").alias("query_id"), asked.alias("query"), "id", F.row_number().over(order).alias("rank"), "embedding")
    return found.join(F.broadcast(mmr(rows, k, diversity).select("id", "rank")), "id").orderBy("rank")


def code_hits(chunks: DataFrame) -> DataFrame:
    """What a search of code shows of a chunk: file, lines 'start:end', language, content, summary (null if none)."""
    return chunks.select(F.col("file_path").alias("file"), F.concat_ws(":", "start_line", "end_line").alias("lines"), "language", "content", "summary")


def decision_messages(decisions: DataFrame, rules: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """insert_decisions with `previews` (100 chars of each duplicate) and `conflicts` (150 of each contradiction); with
    caps (ledger.cap_levels after the insert) also cap_level and cap_count of the projects that near their cap."""
    text = rules.select(F.col("id").alias("other"), "content")

    def shown(ids: str, chars: int, name: str) -> DataFrame:
        each = decisions.select("project_id", "id", F.posexplode(ids).alias("at", "other")).join(text, "other")  # five at most
        return each.groupBy("project_id", "id").agg(F.array_sort(F.collect_list(F.struct("at", tx.preview("content", chars).alias("t")))).alias("x")).select("project_id", "id", F.transform("x", lambda r: r["t"]).alias(name))

    out = decisions
    for ids, chars, name in (("duplicates", 100, "previews"), ("contradictions", 150, "conflicts")):
        out = out.join(shown(ids, chars, name), ["project_id", "id"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if caps is None:
        return out
    near = caps.where("level is not null").select("project_id", F.col("level").alias("cap_level"), F.col("count").alias("cap_count"))
    return out.join(near, "project_id", "left")


# -- links ------------------------------------------------------------------------------------------------------------


def rule_chunk_links(rules: DataFrame, chunks: DataFrame, vector: Sequence[float], task_id: int | None = None, low: float = LINK, k: int = 20) -> DataFrame:
    """(rule_id, chunk_id, similarity): the k chunks nearest to a snippet, each with every rule of that task or of none."""
    near = chunks.where(F.col("embedding").isNotNull()).withColumn("similarity", cosine_to("embedding", vector)).where(F.col("similarity") >= low)
    near = near.orderBy(F.desc("similarity"), "id").limit(k).select(F.col("id").alias("chunk_id"), "similarity")  # k rows
    own = F.col("source_task_id").isNull()
    own = own if task_id is None else own | (F.col("source_task_id") == task_id)
    return rules.where(own).select(F.col("id").alias("rule_id")).crossJoin(F.broadcast(near))


def first_independent(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """(id, stored): which nodes are taken if they are gone through in order and one with a taken neighbour before it isn't.

    before (id, earlier) has each pair of neighbours once, by the later and the earlier one. Decided in rounds for all
    nodes at once: a node is out as soon as one before it is in, and in when all before it are out; what is decided is
    joined no more. The rounds are as many as the longest chain of neighbours that alternate, not as the nodes.
    """
    open_ = stored(before, "open-pairs")  # first, as pairs cost much to find
    state = nodes.select("id", F.lit(True).alias("stored")).join(open_.select("id").distinct(), "id", "left_anti")
    taken = stored(state, "taken")
    done = [taken]
    while not open_.isEmpty():
        out = stored(open_.join(taken.select(F.col("id").alias("earlier")), "earlier", "left_semi").select("id").distinct(), "left-out")
        # pairs of what is out tell no more, as the later or as the earlier one
        rest = open_.join(out, "id", "left_anti")
        waits = stored(rest.join(out.select(F.col("id").alias("earlier")), "earlier", "left_anti").select("id", "earlier"), "open-pairs")
        taken = stored(rest.select("id").distinct().join(waits.select("id").distinct(), "id", "left_anti"), "taken")
        done += [out.select("id", F.lit(False).alias("stored")), taken.select("id", F.lit(True).alias("stored"))]
        open_ = waits
    decided = done[0].select("id", F.lit(True).alias("stored"))
    for d in done[1:]:
        decided = decided.unionByName(d)
    return decided


def insert_decisions(new: DataFrame, existing: DataFrame, duplicate: float = DUPLICATE, low: float = CONTRADICTION) -> DataFrame:
    """For new rules (id, project_id, content, embedding), in the order of their ids: stored or not, and why.

    A rule isn't stored if a stored one of its project is as similar as `duplicate`, earlier new ones that were stored
    included; if stored, those from `low` on contradict it: (project_id, id, stored, duplicates, contradictions), five
    of each at most, the most similar first. Similarities are found in blocks and decided in rounds, so no project and no
    rule is a task of its own.
    """
    pool = existing.where(comparable()).select("id", "project_id", "embedding", F.lit(False).alias("fresh"))
    both = pool.unionByName(new.select("id", "project_id", "embedding", F.lit(True).alias("fresh")))
    pairs = similar_pairs(both.withColumnRenamed("project_id", "p"), low, "p", fresh="fresh")
    seen = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    fresh = new.select("id", "project_id")
    seen = seen.join(fresh.select("id"), "id", "left_semi").join(pool.select(F.col("id").alias("other"), F.lit(True).alias("old")), "other", "left")
    seen = stored(seen.withColumn("old", F.coalesce("old", F.lit(False))).where("old OR other < id"), "near-rules")
    close = seen.where(F.col("similarity") >= duplicate)
    known = stored(close.where("old").select("id").distinct(), "known-duplicates")
    free = fresh.join(known, "id", "left_anti")
    # what duplicates an old rule is out from the start, and neither waits nor makes others wait
    between = close.where("NOT old").join(known, "id", "left_anti").join(known.select(F.col("id").alias("other")), "other", "left_anti")
    state = stored(first_independent(free, between.select("id", F.col("other").alias("earlier"))), "decisions")
    state = state.unionByName(known.select("id", F.lit(False).alias("stored")))
    near = seen.join(state.where("stored").select(F.col("id").alias("other"), F.lit(True).alias("in")), "other", "left").where("old OR `in`")
    near = near.join(state, "id").where(F.col("stored") | (F.col("similarity") >= duplicate))
    first = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    near = near.withColumn("at", F.row_number().over(first)).where("at <= 5")
    lists = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "other"))), lambda x: x["other"]).alias("near"))  # five at most
    none = F.array().cast("array<long>")
    out = fresh.join(state, "id").join(lists, "id", "left").withColumn("near", F.coalesce("near", none))
    return out.select("project_id", "id", "stored", F.when(F.col("stored"), none).otherwise(F.col("near")).alias("duplicates"), F.when(F.col("stored"), F.col("near")).otherwise(none).alias("contradictions"))
