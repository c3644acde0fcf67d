"""Registered queries for metrics and batches (A-1, A-4, A-5, A-7, W-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.catalog.common import Entry
from cloakframe.catalog.fixtures import table
from cloakframe.operators.batches import batch_slots, duplicate_refs
from cloakframe.operators.metrics import (
    latency_histogram,
    latency_summary,
    method_label,
    op_counters,
)

_METHODS = ["GET", "POST", "PUT", "BREW"]


def _counters(spark, sf):
    methods = F.array(*[F.lit(m) for m in _METHODS])
    e = table(spark, sf, "events").select(
        method_label(F.get(methods, (F.col("user_id") % 4).cast("int"))).alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )
    return op_counters(e, ["method", "endpoint", "status"])


_COUNTERS_SQL = """
select ['GET', 'POST', 'PUT', 'other'][user_id % 4 + 1] as method, event_type as endpoint,
  case when event_type = 'error' then 500 else 200 end as status, count(*) as total
from events group by all
"""


def _histogram(spark, sf):
    e = table(spark, sf, "events").withColumn("secs", F.col("value") / 20)
    return latency_histogram(e, "secs", ["event_type"]).withColumn("sum", F.round("sum", 2))


_BOUNDS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5"]
_HISTOGRAM_SQL = " union all ".join(
    [
        f"select event_type, '{b}' as le, count(*) filter (value / 20 <= {b}) as n, "
        'round(sum(value / 20), 2) as "sum", count(value) as "count" from events group by 1'
        for b in _BOUNDS
    ]
    + [
        "select event_type, '+Inf', count(*), round(sum(value / 20), 2), count(value) "
        "from events group by 1"
    ]
)


def _summary(spark, sf):
    out = latency_summary(table(spark, sf, "events"), "value", ["event_type"], "ts")
    return out.select(
        "event_type",
        "n",
        *[F.round(c, 4).alias(c) for c in ["avg", "p95", "p99"]],
        F.round("per_second", 6).alias("per_second"),
    )


_SUMMARY_SQL = """
select event_type, count(*) as n, round(avg(value), 4) as avg,
  round(quantile_cont(value, 0.95), 4) as p95, round(quantile_cont(value, 0.99), 4) as p99,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) as per_second
from events group by 1
"""


def _duplicates(spark, sf):
    """A-1: per order, the first line whose part was already used in that order."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey",
        (F.col("l_partkey") % 10).alias("ref"),
        (F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return duplicate_refs(li, "ref", ["l_orderkey"], "pos")


_DUPLICATES_SQL = """
with v as (select l_orderkey, l_partkey % 10 as ref,
    l_partkey * 10000 + l_suppkey * 10 + l_linenumber as pos from lineitem),
  f as (select l_orderkey, ref, min(pos) as first from v group by all)
select l_orderkey, min(pos) as pos from v join f using (l_orderkey, ref) where pos > first
group by all
"""


def _slots(spark, sf):
    """W-6: the orders of every customer, numbered and cut into batches of four."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return batch_slots(o, ["o_orderkey"], ["o_custkey"], 4)


_SLOTS_SQL = """
with n as (select o_custkey, o_orderkey,
  row_number() over (partition by o_custkey order by o_orderkey) - 1 as r from orders)
select o_custkey, o_orderkey, r // 4 as batch, r % 4 as item from n
"""


ENTRIES = {
    "op_counters": Entry("A-4", _counters, _COUNTERS_SQL),
    "latency_histogram": Entry("A-5", _histogram, _HISTOGRAM_SQL),
    "latency_summary": Entry("A-7", _summary, _SUMMARY_SQL),
    "duplicate_refs": Entry("A-1", _duplicates, _DUPLICATES_SQL),
    "batch_slots": Entry("W-6", _slots, _SLOTS_SQL),
}
