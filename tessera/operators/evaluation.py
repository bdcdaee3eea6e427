"""Retrieval quality: precision, recall and reciprocal rank at k, aggregation, and comparison with a baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.batches import settle
from tessera.plans.lineage import stored

TOLERANCE = 0.02  # fixed value: a metric may fall by so much


def case_metrics(cases: DataFrame, k: int = 10) -> DataFrame:
    """cases (case_id, dataset, expected array, returned array in rank order) with precision, recall, rr, negative_pass.

    Precision is over min(k, returned), 0 if nothing was returned; recall over all that was expected. A case that expects
    nothing is negative: it has no metrics and passes if nothing was returned.
    """
    top = F.slice("returned", 1, k)
    marks = F.transform(top, lambda x: F.array_contains("expected", x))
    hits = F.size(F.filter(marks, lambda x: x))
    first = F.array_position(marks, True)
    negative = F.size("expected") == 0
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return cases.select(
        "case_id", "dataset", F.when(~negative, zero(hits, F.size(top))).alias("precision"), F.when(~negative, zero(hits, F.size("expected"))).alias("recall"),
        F.when(~negative, F.when(first > 0, F.lit(1.0) / first).otherwise(0.0)).alias("rr"), F.when(negative, F.size("returned") == 0).alias("negative_pass"),
    )


def label_metrics(top: DataFrame, rows: DataFrame) -> DataFrame:
    """As case_metrics, where a case expects all other rows of its label: from top (query_id, id, rank) and rows (id, label).

    Labels are counted, so no list of what is expected is made. Cases whose label has no other row are left out.
    """
    own = rows.select(F.col("id").alias("query_id"), F.col("label").alias("want"))
    sizes = rows.groupBy(F.col("label").alias("want")).agg((F.count(F.lit(1)) - 1).alias("expected")).where("expected > 0")
    same = top.join(rows.select("id", "label"), "id").join(own, "query_id").join(sizes, "want").withColumn("hit", F.col("want") == F.col("label"))
    hits = F.sum(F.col("hit").cast("long"))
    return same.groupBy(F.col("query_id").alias("case_id")).agg(
        (hits / F.count(F.lit(1))).alias("precision"), (hits / F.first("expected")).alias("recall"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("rr"),
    ).select("case_id", F.lit("vectors").alias("dataset"), "precision", "recall", "rr", F.lit(None).cast("boolean").alias("negative_pass"))


def set_metrics(cases: DataFrame) -> DataFrame:
    """Set-based precision and recall of contexts, over distinct members."""
    hits = F.size(F.array_intersect("expected", "returned"))
    zero = lambda n: F.when(n > 0, hits / n).otherwise(0.0)
    negative = F.size("expected") == 0
    return cases.select("case_id", "dataset", F.when(~negative, zero(F.size(F.array_distinct("returned")))).alias("context_precision"), F.when(~negative, zero(F.size(F.array_distinct("expected")))).alias("context_recall"), F.when(negative, F.size("returned") == 0).alias("context_negative_pass"))


def dataset_metrics(metrics: DataFrame) -> DataFrame:
    """Means over cases that have the metric, 0 where none has."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    return metrics.groupBy("dataset").agg(F.count(F.lit(1)).alias("cases"), mean("precision"), mean("recall"), mean("rr"), F.coalesce(F.avg(F.col("negative_pass").cast("double")), F.lit(0.0)).alias("negative_pass_rate"))


def melt(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("dataset", "cases")]
    return metrics.unpivot("dataset", names, "metric", "value")


def diff(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(dataset, metric, delta, verdict) of two tables (dataset, metric, value).

    'regression' where the fall is finite and more than the tolerance, 'missing' or 'extra' where one side lacks the row.
    """
    j = current.withColumnRenamed("value", "now").join(baseline.withColumnRenamed("value", "before"), ["dataset", "metric"], "full")
    delta = F.col("now") - F.col("before")
    fell = ~F.isnan(delta) & (F.abs(delta) != float("inf")) & (delta < -tolerance - 1e-12)
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("before").isNull(), "extra").when(fell, "regression").otherwise("ok")
    return j.select("dataset", "metric", delta.alias("delta"), verdict.alias("verdict"))


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `old` that aren't in `new` just so, for a baseline that may only grow."""
    canon = lambda d: d.select(F.to_json(F.struct(*sorted(d.columns))).alias("row"))
    return canon(old).join(canon(new), "row", "left_anti")


# fixed values: what two runs must share for their metrics to be compared, and the metrics
SHAPE = ["k", "num_cases", "num_recalls", "num_scored", "num_negative", "num_contexts", "num_contexts_scored", "num_contexts_negative"]
METRICS = ["mean_precision_at_k", "mean_recall_at_k", "mean_mrr", "negative_pass_rate", "mean_context_precision", "mean_context_recall", "context_negative_pass_rate"]


def summarised(recalls: DataFrame, contexts: DataFrame, k: int = 10) -> DataFrame:
    """A row a dataset with all of SHAPE and METRICS, from case_metrics of recalls and set_metrics of contexts.

    Means are over the recalls and contexts that are scored, not over cases; 0 where there is none.
    """
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    count = lambda c: F.count(c).cast("long")
    r = recalls.groupBy("dataset").agg(
        count(F.lit(1)).alias("num_recalls"), count("precision").alias("num_scored"), count("negative_pass").alias("num_negative"), rate("negative_pass").alias("negative_pass_rate"),
        rate("precision").alias("mean_precision_at_k"), rate("recall").alias("mean_recall_at_k"), rate("rr").alias("mean_mrr"),
    )
    c = contexts.groupBy("dataset").agg(
        count(F.lit(1)).alias("num_contexts"), count("context_precision").alias("num_contexts_scored"), count("context_negative_pass").alias("num_contexts_negative"),
        rate("context_precision").alias("mean_context_precision"), rate("context_recall").alias("mean_context_recall"), rate("context_negative_pass").alias("context_negative_pass_rate"),
    )
    cases = recalls.select("dataset", "case_id").unionByName(contexts.select("dataset", "case_id")).groupBy("dataset").agg(F.count_distinct("case_id").alias("num_cases"))
    out = cases.join(r, "dataset", "left").join(c, "dataset", "left")
    return out.select("dataset", *[(F.lit(k) if n == "k" else F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in SHAPE], *[F.coalesce(n, F.lit(0.0)).alias(n) for n in METRICS])


def shape_mismatches(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(dataset, mismatch): "name: baseline=x current=y" for each of SHAPE that differs, for datasets that both have."""
    j = current.alias("c").join(baseline.alias("b"), "dataset")
    each = [F.when(~F.col(f"b.{n}").eqNullSafe(F.col(f"c.{n}")), F.concat(F.lit(f"{n}: baseline="), F.col(f"b.{n}").cast("string"), F.lit(" current="), F.col(f"c.{n}").cast("string"))) for n in SHAPE]
    return j.select("dataset", F.explode(F.array_compact(F.array(*each))).alias("mismatch"))


def compared(current: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """diff() of the seven metrics of two tables as summarised() makes them."""
    long = lambda d: d.unpivot("dataset", METRICS, "metric", "value")
    return diff(long(current), long(baseline), tolerance)


# fixed values: what an event of a tape can be
EVENTS = ["start_task", "propose_attempt", "log_outcome", "remember_rule", "recall_rules", "get_active_context"]
OUTCOMES = ["accepted", "rejected", "pending"]
CASES = """id string, dataset string, events array<struct<kind:string,task_ref:string,description:string,approach:string,attempt_ref:string,outcome:string,reasoning:string,
    content:string,category:string,label:string,always_inject:boolean,query:string,expected_hits:array<string>,expected_procedural_labels:array<string>>>"""


def _opened(cases: DataFrame) -> DataFrame:
    """The events of cases (see CASES), a row each: case_id, dataset, seq (from 0) and what the event has, and with a rule
    what is asked after it in its case: asks (at, number: from 1 within the case, query)."""
    every = F.filter(F.transform("events", lambda e, i: F.named_struct(F.lit("at"), i, F.lit("query"), e["query"], F.lit("kind"), e["kind"])), lambda a: a["kind"] == "recall_rules")
    asks = F.transform(every, lambda a, i: F.named_struct(F.lit("at"), a["at"], F.lit("number"), i + 1, F.lit("query"), a["query"]))
    rows = cases.select(F.col("id").alias("case_id"), "dataset", asks.alias("asks"), F.posexplode("events").alias("seq", "e"))
    later = F.when(F.col("e.kind") == "remember_rule", F.filter("asks", lambda a: a["at"] > F.col("seq")))
    return rows.select("case_id", "dataset", "seq", "e.*", later.alias("asks"))


def _referenced(rows: DataFrame) -> DataFrame:
    """Events with the reference that an attempt gets: '<task>-a<N>', N from 1. Only attempts are brought together."""
    is_try = F.col("kind").eqNullSafe("propose_attempt")
    own = Window.partitionBy("case_id", "task_ref").orderBy("seq")
    tries = rows.where(is_try).withColumn("own_ref", F.concat("task_ref", F.lit("-a"), F.row_number().over(own).cast("string")))
    return rows.where(~is_try).withColumn("own_ref", F.lit(None).cast("string")).unionByName(tries)


def taped(cases: DataFrame) -> DataFrame:
    """The events of cases (see CASES), a row each: case_id, dataset, seq (from 0), what the event has, and the reference
    that an attempt gets: '<task>-a<N>', N from 1."""
    return _referenced(_opened(cases).drop("asks"))


def _heard(make: Callable) -> Callable:
    """A function of a rule's text and of the queries after it: its vector, and each query's cosine and cover density.

    Worked out where the text is, so neither texts nor vectors of queries travel. Equal texts of a batch are embedded once;
    make() is called once in each task.
    """
    from tessera.functions.english import density_at, stems, wanted

    def close(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
        if a is None or b is None:
            return None
        n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()) if len(a) == len(b) else 0.0
        return float((a * b).sum() / n) if n else 0.0

    @F.pandas_udf("embedding array<float>, sims array<double>, said array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = make()
        for contents, queries in batches:
            asked = {q: wanted(q or "") for qs in queries if qs is not None for q in qs}
            distinct = list(dict.fromkeys(t for t in [*contents, *asked] if t is not None))
            vectors = dict(zip(distinct, encode(distinct), strict=True)) if distinct else {}
            wide = {q: vectors[q].astype(np.float64) for q in asked if q is not None}
            out = []
            for text, qs in zip(contents, queries, strict=True):
                v = vectors.get(text)
                if qs is None or not len(qs):
                    out.append((v, None if qs is None else [], None if qs is None else []))
                    continue
                mine, words = None if v is None else v.astype(np.float64), list(enumerate(stems(text)))
                out.append((v, [close(mine, wide.get(q)) for q in qs], [density_at([x for x in words if x[1] in asked[q]], asked[q]) for q in qs]))
            yield pd.DataFrame(out, columns=["embedding", "sims", "said"])

    return run


def tape_problems(events: DataFrame) -> DataFrame:
    """(case_id, seq, problem) of events of an unknown kind or outcome, and of references to a task or an attempt that no
    earlier event of the case made."""
    made = events.where("kind IN ('start_task', 'propose_attempt')").groupBy("case_id", F.coalesce("own_ref", "task_ref").alias("ref"), "kind").agg(F.min("seq").alias("made"))
    used = events.where("kind IN ('propose_attempt', 'log_outcome')").select("case_id", "seq", F.when(F.col("kind") == "log_outcome", F.col("attempt_ref")).otherwise(F.col("task_ref")).alias("ref"), F.when(F.col("kind") == "log_outcome", "propose_attempt").otherwise("start_task").alias("kind"))
    lost = used.join(made, ["case_id", "ref", "kind"], "left").where("made IS NULL OR made > seq")
    lost = lost.select("case_id", "seq", F.concat(F.when(F.col("kind") == "start_task", "unknown task: ").otherwise("unknown attempt: "), F.coalesce("ref", F.lit("null"))).alias("problem"))
    known = F.coalesce(F.col("kind").isin(EVENTS), F.lit(False))
    odd = events.where(~known).select("case_id", "seq", F.concat(F.lit("unknown event: "), F.coalesce("kind", F.lit("null"))).alias("problem"))
    ended = events.where((F.col("kind") == "log_outcome") & ~F.coalesce(F.col("outcome").isin(OUTCOMES), F.lit(False)))
    return lost.unionByName(odd).unionByName(ended.select("case_id", "seq", F.concat(F.lit("unknown outcome: "), F.coalesce("outcome", F.lit("null"))).alias("problem")))


@dataclass
class Replay:
    """What a tape leads to: labels (case_id, label, id: the seq that made it), deduplicated (case_id, label), recalls and
    contexts (case_id, seq, dataset, expected, returned) for case_metrics and set_metrics, and attempts with their outcomes."""

    labels: DataFrame
    deduplicated: DataFrame
    recalls: DataFrame
    contexts: DataFrame
    attempts: DataFrame


def replay(cases: DataFrame, as_of: str, k: int = 10, dim: int = 384, procedural: bool = False, make: Callable | None = None) -> Replay:
    """A tape of cases (see CASES) gone through: each case has a project of its own, whose events apply in order.

    A rule is stored unless one that was stored before in the case is as similar as 0.95; a search sees the rules stored
    before it, and adds a hit to those it returns, which later searches of the case weigh. Labels that no stored rule has
    are misses. Contexts are the standing rules if `procedural`, else empty. All cases go together: rules are decided in
    rounds, searches by their number within a case, of which there are few. A tape with problems fails, saying the first.
    A rule's likeness to the queries after it is worked out where its text is read, so texts stay there; vectors travel
    once, to be compared with those of their case.
    """
    from tessera.operators import embed, ledger, retrieval
    from tessera.operators.filters import at

    settle(cases.sparkSession)
    opened = _opened(cases).withColumn("heard", _heard(make or (lambda: embed.provider("hashed", dim)))(F.when(F.col("kind") == "remember_rule", F.col("content")), F.col("asks.query")))
    has_words = lambda q: F.regexp_replace(q, r"['\\\\:&|!()\s]", "") != ""
    asks = F.transform("asks", lambda a, i: F.named_struct(F.lit("at"), a["at"], F.lit("number"), a["number"], F.lit("words"), has_words(a["query"]), F.lit("sim"), F.get("heard.sims", i), F.lit("said"), F.get("heard.said", i)))
    text = [] if procedural else ["content"]
    rows = stored(opened.withColumns({"embedding": F.col("heard.embedding"), "asks": asks}).drop("heard", *text), "tape")
    events = _referenced(rows.drop("asks", "embedding"))
    for p in tape_problems(events).orderBy("case_id", "seq").limit(1).collect():
        raise ValueError(f"case {p['case_id']}, event {p['seq']}: {p['problem']}")
    # an id a rule: cases in the order of their ids, events in theirs
    rules = rows.where("kind = 'remember_rule'").withColumns({
        "id": F.concat("case_id", F.lit("#"), F.lpad(F.col("seq").cast("string"), 10, "0")), "project_id": F.xxhash64("case_id"), "is_always_injected": F.coalesce("always_inject", F.col("category") == "instruction"),
    })
    near = retrieval.similar_pairs(rules.select("id", "project_id", "embedding"), retrieval.DUPLICATE, "project_id")
    taken = retrieval.first_independent(rules.select("id"), near.select(F.col("b").alias("id"), F.col("a").alias("earlier")))
    slim = rules.select("id", "case_id", "seq", "label", "category", "is_always_injected", "asks", *(["content"] if procedural else []))
    rules = stored(slim.join(taken, "id"), "taped-rules")
    kept_rules, copies = rules.where("stored").drop("stored", "id"), rules.where("NOT stored").select("case_id", "label")

    asked = rows.where("kind = 'recall_rules'").select("case_id", "dataset", "seq", F.col("expected_hits").alias("expected"))
    most = asked.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0
    heard = stored(kept_rules.select("case_id", F.col("seq").alias("rule"), "category", F.explode("asks").alias("a")).select("case_id", "rule", "category", "a.*"), "tape-pairs")
    found, hits = [], None
    for number in range(1, most + 1):
        pairs = heard.where(F.col("number") == number)
        pairs = pairs.join(hits, ["case_id", "rule"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))) if hits is not None else pairs.withColumn("hits", F.lit(0).cast("long"))
        within = Window.partitionBy("case_id")
        rank = lambda by: F.when(by.isNotNull(), F.row_number().over(within.orderBy(by.asc_nulls_last(), "rule")))
        pairs = pairs.withColumns({"v": rank(-F.col("sim")), "t": rank(-F.col("said")), "most": F.greatest(F.max("hits").over(within), F.lit(1))})
        part = lambda c: F.when(F.col(c) <= k * retrieval.OVERFETCH, 1.0 / (retrieval.RRF_K + F.col(c))).otherwise(0.0)
        weight = F.element_at(F.create_map(*[F.lit(x) for p in retrieval.CATEGORY.items() for x in p]), F.col("category"))
        w = retrieval.WEIGHT
        fused = w["vector"] * part("v") + w["text"] * part("t") + w["category"] * weight + w["age"] + w["hits"] * F.log1p("hits") / F.log1p("most")
        either = (F.coalesce("v", F.lit(1 << 30)) <= k * retrieval.OVERFETCH) | (F.coalesce("t", F.lit(1 << 30)) <= k * retrieval.OVERFETCH)
        pairs = pairs.withColumn("score", F.when(F.col("words"), fused).otherwise(F.col("sim"))).where(either)
        pairs = pairs.withColumn("rank", F.row_number().over(within.orderBy(F.desc("score"), "rule"))).where(F.col("rank") <= k)
        found.append(stored(pairs.select("case_id", "at", "rule", "rank"), "tape-hits"))
        if number < most:
            more = found[-1].select("case_id", "rule", F.lit(1).cast("long").alias("hits"))
            hits = stored((more if hits is None else hits.unionByName(more)).groupBy("case_id", "rule").agg(F.sum("hits").alias("hits")), "tape-counts")
    kind = "case_id string, at int, rule int, rank int"
    returned = reduce(DataFrame.unionByName, found, cases.sparkSession.createDataFrame([], kind))

    contexts = rows.where("kind = 'get_active_context'").select("case_id", "dataset", "seq", F.col("expected_procedural_labels").alias("expected"))
    standing = kept_rules.join(contexts.select("case_id", F.col("seq").alias("at")), "case_id").where("seq < at" if procedural else "false")
    now = {"created_at": at(as_of), "valid_from": at(as_of), "valid_until": F.lit(None).cast("timestamp_ntz"), "expires_at": F.lit(None).cast("timestamp_ntz")}
    standing = standing if procedural else standing.withColumn("content", F.lit(None).cast("string"))
    standing = standing.withColumns(now | {"project_id": F.struct("case_id", "at"), "id": F.col("seq")})
    given = ledger.injected(standing, as_of).select("project_id.case_id", "project_id.at", F.col("id").alias("rule"), F.col("id").alias("rank"))

    last = Window.partitionBy("case_id", "label").orderBy(F.desc("seq"))
    of_rule = kept_rules.select("case_id", "label", F.col("seq").alias("id"))
    made = events.where("kind IN ('start_task', 'propose_attempt')").select("case_id", F.when(F.col("kind") == "start_task", F.concat(F.lit("task-"), "task_ref")).otherwise(F.concat(F.lit("attempt-"), "own_ref")).alias("label"), F.col("seq").alias("id"))
    labels = of_rule.unionByName(made).withColumn("n", F.row_number().over(last.orderBy(F.desc("id")))).where("n = 1").drop("n")

    def resolved(asks: DataFrame, answers: DataFrame) -> DataFrame:
        """Expected labels as ids (below zero for those of no rule), and what came back in the order of ranks."""
        each = asks.select("case_id", "dataset", "seq", F.posexplode_outer("expected").alias("n", "label")).join(labels, ["case_id", "label"], "left")
        want = F.when(F.col("n").isNotNull(), F.struct("n", F.coalesce(F.col("id"), -1 - F.col("n")).cast("long").alias("id")))
        wanted = each.groupBy("case_id", "dataset", "seq").agg(F.transform(F.array_sort(F.collect_list(want)), lambda x: x["id"]).alias("expected"))
        back = answers.groupBy("case_id", F.col("at").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("rule").cast("long").alias("rule")))), lambda x: x["rule"]).alias("returned"))
        return wanted.join(back, ["case_id", "seq"], "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<long>")))

    outcomes = rows.where("kind = 'log_outcome'").select("case_id", F.col("attempt_ref").alias("own_ref"), "seq", "outcome", "reasoning")
    newest = Window.partitionBy("case_id", "own_ref").orderBy(F.desc("seq"))
    outcomes = outcomes.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "seq")
    attempts = events.where("kind = 'propose_attempt'").select("case_id", "task_ref", "own_ref", "approach").join(outcomes, ["case_id", "own_ref"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("pending")))
    return Replay(labels, copies, resolved(asked, returned), resolved(contexts, given), attempts)
