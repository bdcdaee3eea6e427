"""The corpus pipeline: quality, toxicity, near duplicates, decontamination, packing. Each stage's rows are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, packing, quality, toxicity
from tessera.llm.common import settle, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _kept(docs: DataFrame, scored: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of docs for which `keep` holds; the operator sees the text only, so no column of docs is touched.

    The text goes by a name of its own, and with it all columns as one, so names can't clash.
    """
    whole = docs.select(F.col("text").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__rest"))
    got = scored(whole).where(keep)
    return got.select(*[(F.col("__text") if c == "text" else F.col("__rest").getField(c)).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, all their columns as they were.

    Null and empty texts are scored like any (the score of no words), whole texts of any length are read, repeated rows
    fare alike, no documents give none, and where labels give nothing to learn, all rows get the share of good labels.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda df: quality.score(df, model, "__text"), "predicted = 1")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject, all their columns as they were.

    Null and empty texts get the score of the bias alone; the rest is as in keep_quality.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda df: toxicity.score(df, model, "__text"), "predicted = 0")


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id; texts without words all stay.

    Rows with a null doc_id stay too; where doc_ids repeat, rows are told apart by their texts.
    """
    settle(spark)
    return ngram_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, all their columns as they were; null and empty texts have none."""
    items = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda df: decontamination.find_contamination(df, items, text_col="__text"), "not contaminated")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence; null and empty texts are their end token."""
    settle(spark)
    pieces = packing.token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(staged(pieces, "pieces"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_duplicates), ("decontamination", drop_contaminated), ("packing", pack_sequences),
]

#: No stage but decontamination is expressible in SQL: the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
