"""Ordered jobs give the rows of a window, with most rows in one group and with NULL keys."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cloakframe.operators.access import current_lifecycle, verify_transitions
from cloakframe.operators.metrics import latency_summary
from cloakframe.plans.ordering import previous_value, row_numbers, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.lit(0)).when(F.col("id") % 7 > 0, F.col("id") % 5).alias("k"),
        F.hash("id").alias("o"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"),
        (F.col("id") % 6).alias("w"),
    )


def rows(df):
    return sorted(df.collect(), key=str)


def over(*bounds):
    return Window.partitionBy("k").orderBy("o").rowsBetween(*bounds)


UPTO = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def test_row_numbers(skewed):
    want = skewed.withColumn("n", F.count("*").over(over(*UPTO)))
    got = row_numbers(skewed, ["k"], ["o"], "n")
    assert rows(got) == rows(want)
    assert got.count() == 4000


def test_running_total(skewed):
    want = skewed.withColumn("t", F.sum("w").over(over(*UPTO)))
    assert rows(running_total(skewed, ["k"], ["o"], "w", "t")) == rows(want)


def test_previous_value(skewed):
    want = skewed.withColumn("p", F.last("v", ignorenulls=True).over(over(*BEFORE)))
    assert rows(previous_value(skewed, ["k"], ["o"], F.col("v"), "p")) == rows(want)


ALLOWED = {"active": {"disabled", "retired", "compromised", "destroyed"}, "disabled": {"active"}}


def test_lifecycle_equals_a_fold(spark):
    statuses = ["active", "disabled", "active", "disabled", "retired", "compromised", "destroyed"]
    events = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("kid"),
        F.col("id").alias("at"),
        F.get(F.array(*[F.lit(s) for s in statuses]), F.abs(F.hash("id")) % 7).alias("status"),
    )
    checked = verify_transitions(events, ["at"])
    got = {(r["kid"], r["at"]): (r["current"], r["accepted"]) for r in checked.collect()}
    state: dict = {}
    want = {}
    for r in sorted(events.collect(), key=lambda r: r["at"]):
        now = state.get(r["kid"], "active")
        ok = r["status"] in ALLOWED.get(now, ())
        want[r["kid"], r["at"]] = (now, ok)
        state[r["kid"]] = r["status"] if ok else now
    assert got == want
    assert {r["kid"]: r["status"] for r in current_lifecycle(checked, ["at"]).collect()} == state


def test_percentiles(spark):
    df = spark.range(5000).select(
        (F.col("id") % 2).alias("g"),
        F.pmod(F.hash("id"), F.lit(97)).cast("double").alias("v"),
        F.timestamp_seconds("id").alias("ts"),
    )
    want = df.groupBy("g").agg(F.percentile("v", 0.95), F.percentile("v", 0.99)).collect()
    got = latency_summary(df, "v", ["g"], "ts").select("g", "p95", "p99").collect()
    for a, b in zip(sorted(got), sorted(want)):
        assert tuple(a) == pytest.approx(tuple(b))
    assert latency_summary(df, "v", ["g"], "ts", exact=False).count() == 2
