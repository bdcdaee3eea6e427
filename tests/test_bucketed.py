"""Tables by key: joins and roll-ups over them have no exchange and the same rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger
from tessera.operators.bucketed import Bucketed, buckets_for
from tessera.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled_joins(spark):
    """Small test tables would be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_task_roll_ups_shuffle_nothing(spark, shuffled_joins):
    tasks, attempts = fx.tasks(spark, SF), fx.attempts(spark, SF)
    t, a = Bucketed.write(tasks, "id", 8), Bucketed.write(attempts, "task_id", 8)
    for build in (ledger.task_summaries, ledger.task_stats):
        got, want = build(t.read(), a.read()), build(tasks, attempts)
        assert "Exchange" not in plan(got) and "Exchange" in plan(want)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    t.drop()
    a.drop()
    assert not spark.catalog.tableExists(t.name)


def test_rules_for_a_file_shuffle_no_links(spark, shuffled_joins):
    links = spark.createDataFrame([(i % 40 if i % 9 else None, i % 13, i / 500) for i in range(500)], "rule_id long, chunk_id long, similarity double")
    rules = spark.createDataFrame([(i, f"rule {i}") for i in range(30)], "id long, content string")
    by_rule, of = Bucketed.write(links, "rule_id", 8), Bucketed.write(rules, "id", 8)
    best = by_rule.read().groupBy("rule_id").agg(F.max("similarity").alias("best")).join(of.read().withColumnRenamed("id", "rule_id"), "rule_id")
    assert "Exchange" not in plan(best)
    want = links.groupBy("rule_id").agg(F.max("similarity").alias("best")).join(rules.withColumnRenamed("id", "rule_id"), "rule_id")
    assert sorted(map(str, best.collect())) == sorted(map(str, want.collect()))
    assert by_rule.read().where("rule_id IS NULL").count() == links.where("rule_id IS NULL").count()


def test_empty_tables_and_numbers_of_buckets(spark):
    empty = Bucketed.write(spark.createDataFrame([], "k long, v string"), "k")
    assert empty.read().count() == 0 and empty.read().columns == ["k", "v"]
    assert [buckets_for(n) for n in (0, 16_000_000, 16_000_001, 10**13)] == [8, 8, 16, 8192]
