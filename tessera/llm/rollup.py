"""Token counts: additive totals by source, language and tokenizer version, maintained by signed batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces_of, tidy
from tessera.llm.packing import tokenizer

KEYS = ["source", "lang", "tokenizer_version"]


def signed_deltas(events: DataFrame) -> DataFrame:
    """Events (op, source, lang, tokenizer_version, n_tokens, old_tokens) as additive rows: the keys, n_docs, n_tokens.

    insert adds a document and its tokens, delete takes both away, revise adds n_tokens - old_tokens. Null counts are
    0, null keys are a group of their own; any other op fails. Sums are taken before the shuffle, so one hot source
    is a row a task.
    """
    op = F.lower("op")
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("int"))
    rows = events.withColumns({"d": sign.cast("long"), "t": F.when(op == "revise", n - old).otherwise(n * sign).cast("long")})
    return rows.groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))


class TokenRollup:
    """Totals kept in a folder: a folder of deltas for each committed batch, written beside and renamed into place.

    A batch is committed once: a repeated commit of its id changes nothing, whether the first came from this process or
    another, and a batch that failed half-way leaves nothing that is read. compact() folds all batches so far into a base
    that also holds their ids, so totals read the base and what came after it, not all of history.
    """

    SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(""))]
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def _listed(self) -> tuple[str | None, list[str]]:
        """The newest base and the batches, of one look at the folder."""
        names = self._names("")
        bases = [n for n in names if n.startswith("base=")]
        return (bases[-1] if bases else None), [n.removeprefix("batch=") for n in names if n.startswith("batch=")]

    def _ids(self, base: str | None) -> set[str]:
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{base}/ids").collect()} if base else set()

    def committed(self) -> list[str]:
        base, batches = self._listed()
        return sorted({*self._ids(base), *batches})

    def _place(self, beside: str, name: str) -> bool:
        """Whether the folder was renamed to a name that was free; of two that try at once, one finds its own inside."""
        if self.fs.exists(self._at(name)) or not self.fs.rename(self._at(beside), self._at(name)):
            self.fs.delete(self._at(beside), True)
            return False
        if self.fs.exists(self._at(f"{name}/{beside}")):  # moved into the other's
            self.fs.delete(self._at(f"{name}/{beside}"), True)
            return False
        return True

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Whether the batch was new. An empty batch is a batch, too."""
        if not batch or "/" in batch:
            raise ValueError("a batch id is a name")
        if batch in self.committed():
            return False
        beside = f"_pending-{uuid.uuid4().hex}"
        signed_deltas(events).write.parquet(f"{self.path}/{beside}")
        return self._place(beside, f"batch={batch}")

    def _rows(self) -> tuple[DataFrame | None, list[str], str | None]:
        """Deltas and base that make the totals, the batches in them, and the base: of one listing, so a batch that a
        compaction folds meanwhile is counted once, from where the listing had it."""
        base, batches = self._listed()
        folded = self._ids(base)
        fresh = [b for b in batches if b not in folded]
        paths = [*([f"{self.path}/{base}/totals"] if base else []), *(f"{self.path}/batch={b}" for b in fresh)]
        return (self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else None), sorted({*folded, *fresh}), base

    def compact(self, grace: float = 3600.0) -> bool:
        """Fold what is committed into a new base. One process at a time compacts; a commit meanwhile is safe, and a
        compaction that fails half-way leaves the old base and all batches as they were.

        What is folded stays for readers that have begun with it: folders go with the first compaction that comes at least
        `grace` seconds after the base that holds what they had.
        """
        rows, ids, old = self._rows()
        if rows is None:
            return False
        beside = f"_pending-{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.path}/{beside}/totals")
        self.spark.createDataFrame([(i,) for i in ids], "batch string").coalesce(1).write.parquet(f"{self.path}/{beside}/ids")
        if not self._place(beside, f"base={int(old.removeprefix('base=')) + 1 if old else 1:08d}"):
            return False
        self.clean(grace)
        return True

    def clean(self, grace: float = 3600.0) -> None:
        """Remove bases before, and batches in, the newest base that is at least `grace` seconds old."""
        now = self.spark._jvm.System.currentTimeMillis()
        bases = [f"base={n}" for n in self._names("base=")]
        aged = [b for b in bases if now - self.fs.getFileStatus(self._at(f"{b}/ids")).getModificationTime() >= 1000 * grace]
        if aged:
            for name in [*(f"batch={b}" for b in sorted(self._ids(aged[-1]))), *(b for b in bases if b < aged[-1])]:
                self.fs.delete(self._at(name), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups that have come to nothing are left out."""
        rows, _, _ = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")


def token_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(source, lang, text_bytes, n_tokens, n_words): the ids a tokenizers file gives each whole text, and its words.

    Null and empty texts have none; texts of any length are read whole; repeated rows are rows each; other columns are
    ignored.
    """

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for b in pieces_of(batch):
                first, _ = tok.ids(b.column(2))
                text = b.column(2).fill_null("")
                words = [len(x.split()) for x in text.to_pylist()]
                size = [len(x.encode()) for x in text.to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(words, pa.int64())], names=["source", "lang", "text_bytes", "n_tokens", "n_words"])

    return docs.select("source", "lang", F.col(text_col)).mapInArrow(run, "source string, lang string, text_bytes long, n_tokens long, n_words long")
