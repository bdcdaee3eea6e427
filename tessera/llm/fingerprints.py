"""Content-defined chunking with normalised gear-hash boundaries; sets of chunk digests measure containment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix, parallelism, pieces_of, tidy

#: Bytes of a chunk: the least, where boundaries become likelier, the most.
LEAST, NORMAL, MOST = 8, 32, 128
#: A boundary before and from the normal size on: so many of the hash's high bits are zero.
STRICT, LOOSE = 6, 4
_GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0xC0FFEE)) >> np.uint64(32)).astype(np.uint32)
_DIGITS = 10  # hex digits of a chunk's digest


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: of the last 32, each shifted left once more than the next; in five doublings."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def chunks(data: bytes) -> list[tuple[int, int]]:
    """[begin, end) of each chunk of UTF-8 bytes."""
    n = len(data)
    if n <= LEAST:
        return [(0, n)] if n else []
    h = gear(np.frombuffer(data, dtype=np.uint8))
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    strict = loose[h[loose] < np.uint32(1 << (32 - STRICT))].tolist()
    loose = loose.tolist()
    out, begin, i, j, ns, nl = [], 0, 0, 0, len(strict), len(loose)
    while n - begin > LEAST:
        i = bisect_left(strict, begin + LEAST - 1, i)
        if i < ns and strict[i] < begin + NORMAL - 1:
            end = strict[i] + 1
        else:
            j = bisect_left(loose, begin + NORMAL - 1, j)
            end = min(loose[j] + 1 if j < nl else n, begin + MOST, n)
        out.append((begin, end))
        begin = end
    if begin < n:
        out.append((begin, n))
    return out


def fingerprint(text: str | None) -> dict[str, int]:
    """Digest of each distinct chunk and its length in bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    h = xxhash.xxh3_64_hexdigest
    return {h(data[a:b])[:_DIGITS]: b - a for a, b in chunks(data)}


def encoded(found: dict[str, int]) -> str:
    """Digests in order, each with its length in two hex digits: a string that depends on the set alone."""
    return "".join([f"{d}{found[d]:02x}" for d in sorted(found)])


def decoded(text: str) -> dict[str, int]:
    k = _DIGITS
    return {text[i : i + k]: int(text[i + k : i + k + 2], 16) for i in range(0, len(text), k + 2)}


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Bytes of the chunks that both have over those of the smaller set; 1 for two empty sets, 0 for one."""
    if not a or not b:
        return float(not a and not b)
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    return sum(n for d, n in few.items() if d in many) / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fingerprint (string), a column of that name replaced; null and empty texts have an empty one."""
    from pyspark.sql import types as T

    from tessera.llm.common import append_columns

    return append_columns(docs, [text_col], [T.StructField("fingerprint", T.StringType())], lambda: lambda t: [[encoded(fingerprint(x)) for x in t.to_pylist()]])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, id, text, sent): each document in the range of ids it belongs to, and with sent = true the first of a
    range again in the range before, as what follows its last; the first of all follows the last of all.

    Order: falling id (null last), then text. The ranges' bounds are quantiles, a few for each partition.
    """
    n = parallelism(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id")
    parts = 3 * n  # several ranges a task even out their sizes
    bounds = sorted({int(x) for x in ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []})
    # range k has the ids above the k-th bound from above; null ids are in the last
    spread = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    bucket = F.when(F.col("id").isNull(), len(bounds)).otherwise(F.size(F.filter(spread, lambda b: b >= F.col("id"))))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    heads = [(r["bucket"], r["id"]) for r in ids.withColumn("bucket", bucket.cast("int")).groupBy("bucket").agg(F.max("id").alias("id")).orderBy("bucket").collect()]
    # the first document of a range: of those with its largest id the one with the least text
    to = {b: heads[k - 1][0] for k, (b, _) in enumerate(heads)}
    spark = docs.sparkSession
    small = spark.createDataFrame([(b, i, to[b]) for b, i in heads], "bucket int, id long, back int")  # a row a range
    same = (F.col("rows.bucket") == F.col("heads.bucket")) & F.col("rows.id").eqNullSafe(F.col("heads.id"))
    wanted = F.col("id").isin([i for _, i in heads if i is not None])
    first = rows.where(wanted if all(i is not None for _, i in heads) else wanted | F.col("id").isNull())
    first = first.alias("rows").join(F.broadcast(small).alias("heads"), same).groupBy(F.col("heads.back").alias("bucket"), "rows.id").agg(F.min("text").alias("text"))
    return rows.select("bucket", "id", "text", F.lit(False).alias("sent")).unionByName(first.select("bucket", "id", "text", F.lit(True).alias("sent")))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by as many first ones (or all) of the next
    document's, by falling doc_id; the last is followed by the first. Documents that share an id are ordered by text,
    null ids come last, null texts are empty; a single document follows itself; other columns are ignored. Texts are
    shuffled once, by ranges of ids, so that neighbours meet in one task.
    """
    import hashlib

    dealt = with_next(docs, id_col, text_col)
    dealt = dealt.repartition(parallelism(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "sent", F.col("id").desc_nulls_last(), "text")

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text, fingerprint of the row before

        def against(at, nxt, next_print):
            text, own = at[2], at[3]
            cut = len(text) // 3
            edited = text[: len(text) - cut] + nxt[:cut] if cut else text
            other = fingerprint(edited) if cut else own
            return (at[1], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(own), encoded(other), containment(own, other), containment(own, next_print))

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for b in pieces_of(batch):
                rows = []
                for bucket, i, text, sent in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    own = fingerprint(text)
                    if held is not None and held[0] == bucket:
                        rows.append(against(held, text, own))
                    held = None if sent else (bucket, i, text, own)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
