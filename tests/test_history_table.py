"""The bucketed history: replaced days, other sessions' days, pruned folders, joins without a shuffle of the history."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from briefwell.operators.history import COUNTS
from briefwell.sources import history_table


def counts(spark, rows):
    """(source, day of January, raw articles, last selected) as rows of counts."""
    whole = [(s, None if d is None else dt.date(2024, 1, d), *[n if c == "raw_articles" else None for c in COUNTS], last) for s, d, n, last in rows]
    return spark.createDataFrame(whole, ", ".join(["source_key string", "day date", *[f"{c} long" for c in COUNTS], "last_selected_at string"]))


def day(n):
    return F.lit(dt.date(2024, 1, n))


@pytest.fixture()
def table(spark, tmp_path, request):
    name = re.sub(r"\W", "_", request.node.name)
    history_table.open_history(spark, name, f"file://{tmp_path}/h", buckets=4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def got(rows):
    return {(r["source_key"], r["raw_articles"], r["last_selected_at"]) for r in rows.collect()}


def test_days_are_replaced_and_found_again(spark, table, tmp_path):
    first = counts(spark, [("a", 1, 2, ""), ("a", 1, 3, "2024-01-01"), ("b", 1, 7, ""), ("a", 2, 1, "2024-01-02"), (None, 2, 5, ""), ("c", None, 5, "")])
    for _ in range(2):  # a run that is written again changes nothing
        history_table.write_days(first, table)
    assert got(history_table.totals(spark.table(table))) == {("a", 6, "2024-01-02"), ("b", 7, None)}
    history_table.write_days(counts(spark, [("b", 2, 4, "")]), table)
    assert got(history_table.totals(spark.table(table))) == {("a", 5, "2024-01-01"), ("b", 11, None)}
    assert got(history_table.totals(spark.table(table), day(2))) == {("b", 4, None)} and got(history_table.totals(spark.table(table), None, day(1))) == {("a", 5, "2024-01-01"), ("b", 7, None)}
    again = history_table.open_history(spark, table + "_again", f"file://{tmp_path}/h", buckets=4)
    assert got(history_table.totals(again)) == {("a", 5, "2024-01-01"), ("b", 11, None)}
    spark.sql(f"DROP TABLE {table}_again")
    assert again.schema == spark.table(table).schema


def test_empty_tables(spark, table):
    history_table.write_days(counts(spark, []), table)
    rows = spark.createDataFrame([("a",), (None,)], "k string")
    assert history_table.totals(spark.table(table)).count() == 0
    assert [r["past"] for r in history_table.with_past(rows, spark.table(table), "k").collect()] == [None, None]
    assert history_table.lookback(spark.table(table), spark.createDataFrame([(None,)], "run_day date"), 3).count() == 0


def test_windows_read_their_days_only(spark, table):
    history_table.write_days(counts(spark, [(f"s{i % 9}", 1 + i % 28, 1, "") for i in range(400)]), table)
    history = spark.table(table)
    plan = history_table.totals(history, day(20), day(22))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-20", plan) and "Exchange" not in plan
    runs = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (3, 9, 20, 28)], "run_day date, n int").filter("n < 10")
    back = history_table.lookback(history, runs, 3)
    assert "dynamicpruning" in back._jdf.queryExecution().executedPlan().toString()
    plain = {}
    for i in range(400):
        for run in (3, 9):
            if run - 2 <= 1 + i % 28 <= run:
                plain[run, f"s{i % 9}"] = plain.get((run, f"s{i % 9}"), 0) + 1
    assert {(r["run_day"].day, r["source_key"]): r["raw_articles"] for r in back.collect()} == plain


def test_joins_do_not_shuffle_the_history(spark, table):
    history_table.write_days(counts(spark, [(f"s{i % 9}", 1 + i % 28, 1, "") for i in range(400)]), table)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(20).select("id", F.concat(F.lit("s"), "id").alias("k"))
        joined = history_table.with_past(rows, spark.table(table), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and re.search(r"hashpartitioning\(k#\d+, 4\)", plan)
        assert sum(r["past"]["raw_articles"] for r in joined.collect() if r["past"]) == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
