"""Files of evaluation: cases to replay, and baselines of earlier runs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.evaluation import CASES, METRICS, SHAPE

VERSION = 1
_BASELINE = {"version", "metadata", "datasets"}


class FormatError(ValueError):
    """A file that isn't what it should be."""


def _known(what: str, value: object, allowed: set[str], needed: set[str]) -> dict:
    if not isinstance(value, dict):
        raise FormatError(f"{what} is not an object")
    if more := value.keys() - allowed:
        raise FormatError(f"{what}: unknown fields {sorted(more)}")
    if less := needed - value.keys():
        raise FormatError(f"{what}: missing fields {sorted(less)}")
    return value


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON arrays in files that Spark reads (see evaluation.CASES): each with an id, a dataset and events."""
    raw = spark.read.schema(CASES + ", _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    broken = raw.select("*").where("_broken IS NOT NULL OR coalesce(id, '') = '' OR dataset IS NULL OR events IS NULL").select("id").limit(1).collect()
    if broken:
        raise FormatError(f"case {broken[0]['id']!r}: not a case with an id, a dataset and events")
    return raw.drop("_broken")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A row a dataset (dataset, SHAPE, METRICS); unknown fields and other versions are refused; per_case isn't compared."""
    told = _known("the baseline", json.loads(Path(path).read_text(encoding="utf-8")), _BASELINE, _BASELINE)
    if told["version"] != VERSION:
        raise FormatError(f"version {told['version']}, not {VERSION}")
    fields, rows = [*SHAPE, *METRICS], []
    for name, d in sorted(told["datasets"].items()):
        _known(f"dataset {name}", d, {*fields, "per_case"}, set(fields))
        rows.append((name, *[int(d[c]) for c in SHAPE], *[float(d[c]) for c in METRICS]))
    return spark.createDataFrame(rows, "dataset string, " + ", ".join([f"{c} long" for c in SHAPE] + [f"{c} double" for c in METRICS]))


def write_baseline(summary: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """The summary of a run as a file whose order of keys is fixed, so that two differ where their values do."""
    rows = summary.collect()  # a row a dataset
    data = {"version": VERSION, "metadata": metadata or {}, "datasets": {r["dataset"]: {c: r[c] for c in (*SHAPE, *METRICS)} for r in sorted(rows, key=lambda r: r["dataset"])}}
    Path(path).write_text(json.dumps(data, indent=2, sort_keys=True) + "\n", encoding="utf-8")
