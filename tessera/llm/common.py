"""Helpers shared by the operators: the shared folder, staged tables, Arrow batches with appended columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.batches import ARROW_BYTES, ARROW_ROWS, let_go, settle, tidy  # noqa: F401

#: Rows and bytes that one step of a Python operator handles at a time (a longer row is a step of its own).
STEP_ROWS, STEP_BYTES = 4096, 8 << 20


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine.

    On a cluster without the setting this fails, as executors don't see a folder of the driver's.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    return (where or _own_dir()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions(df: DataFrame) -> int:
    """The number of tasks that read df."""
    return max(1, df.rdd.getNumPartitions())


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null keys count as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0)) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(df: DataFrame, key: list[str], n: int, seed: int = 5) -> DataFrame:
    """The n rows of least hash of `key`: a sample that is the same on every run.

    A bound on the hash that lets about twice n rows pass comes first, so that tasks don't each send n rows on.
    """
    full = 1 << 40
    ranked = df.withColumn("__h", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key], F.lit(seed)), F.lit(full)))
    rows = df.count()
    below = ranked.where(F.col("__h") < int(full * min(1.0, (2 * n + 100) / max(1, rows))))
    if 2 * n + 100 < rows and below.count() >= n:
        ranked = below
    return ranked.orderBy("__h", *key).limit(n).drop("__h")


def pieces_of(batch: pa.RecordBatch, rows: int = STEP_ROWS, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows and bytes at most."""
    if batch.num_rows <= 1 or (batch.num_rows <= rows and batch.nbytes <= size):
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces_of(batch.slice(0, half), rows, size)
    yield from pieces_of(batch.slice(half), rows, size)


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list]]) -> DataFrame:
    """df with columns computed from `inputs` a step of rows at a time.

    make() runs once in each task and gives a function from the inputs' Arrow arrays to one list or array a field.
    Columns of df that are named like a new one are replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]
    # an input that stays is sent once
    place = {c: names.index(c) if c in names else len(names) + sum(x not in names for x in inputs[:i]) for i, c in enumerate(inputs)}
    carried = df.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs) if c not in names])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for b in pieces_of(batch):
                got = work(*[b.column(place[c]) for c in inputs])
                cols = b.columns[: len(names)]
                cols += [pa.array(x, type=arrow.field(len(names) + i).type) for i, x in enumerate(got)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return carried.mapInArrow(run, schema)


#: Tables for str-like bytes: A-Z to a-z; and besides, all ASCII but digits and letters to a space.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def translated(texts: pa.Array, by: bytes) -> pa.Array:
    """Texts with their UTF-8 bytes mapped one for one (ASCII to ASCII); null becomes empty."""
    texts = pc.fill_null(texts, "")
    if texts.offset or texts.type != pa.string():
        texts = pa.concat_arrays([texts.cast(pa.string()), pa.array([], pa.string())])
    if texts.offset:
        texts = pa.array(texts.to_pylist(), pa.string())
    _, offsets, data = texts.buffers()
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(by) if data is not None else b""))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut at ASCII white space: first word of each text (and the end), each word's code, the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    first = lists.offsets.to_numpy().astype(np.int64)
    first = first - first[0] if len(first) else np.zeros(1, dtype=np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end leaves empty words
        first = np.concatenate([[0], np.cumsum(full)])[first]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return first, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word: its bytes times a constant for each place (multilinear), and then mixed."""
    n = len(words)
    _, offsets, data = words.buffers()
    if not n or data is None:
        return mix(np.full(n, seed, dtype=np.uint64))
    at = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    x = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    at -= at[0]
    size = np.diff(at)
    place = np.arange(len(x)) - np.repeat(at[:-1], size)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(odd_constants(int(size.max()) + 1, 41)[place] * (x + np.uint64(1)))])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def word_hashes(texts: pa.Array, by: bytes = WORDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word of each text (and the end), and the hash of each word."""
    first, codes, words = split_words(translated(texts, by))
    return first, hash_words(words, seed)[codes] if len(words) else np.empty(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64)  # a copy, changed in place
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int, bits: int = 64) -> np.ndarray:
    """n odd multipliers made from a seed."""
    x = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (x >> np.uint64(64 - bits)).astype(np.uint64 if bits == 64 else np.uint32) | (np.uint64(1) if bits == 64 else np.uint32(1))


#: Parts that one task adds up, about, at each level of a sum.
FAN = 8


def sum_blocks(parts: DataFrame, read: Callable[[bytes, bytes], tuple[np.ndarray | slice, np.ndarray]], shape: tuple[int, ...], tasks: int) -> DataFrame:
    """Sums of blocks of numbers by block: (block int, data binary: float64 of `shape`).

    parts has block, part (the task's number), at and data (binaries), of which `read` makes the places and the values to
    be added there; so a part may hold only what its task touched. Values must be multiples of a fixed fraction, so that
    their sums are exact and don't depend on the order of tasks. `tasks` is how many parts there are: each level adds
    about FAN of them for each block, so no task reads more than FAN models, however many tasks there were.
    """

    def adder(read):
        def row(key, x):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([b""], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["block", "part", "at", "data"])

        @tidy
        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, total = None, np.zeros(shape)
            for b in batches:
                for *key, at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                    if key != held:
                        if held is not None:
                            yield row(held, total)
                        held, total = key, np.zeros(shape)
                    where, x = read(at.as_buffer(), data.as_buffer())
                    total[where] += x
            if held is not None:
                yield row(held, total)

        return add

    def dense(at, data):
        return slice(None), np.frombuffer(data, dtype=np.float64).reshape(shape)

    kind, n = "block int, part int, at binary, data binary", parallelism(parts.sparkSession)
    while True:
        tasks = -(-tasks // FAN)
        dealt = parts.withColumn("part", F.pmod("part", F.lit(tasks)).cast("int")).repartition(n, "block", "part").sortWithinPartitions("block", "part")
        parts, read = dealt.mapInArrow(adder(read), kind), dense
        if tasks == 1:
            return parts.select("block", "data")
