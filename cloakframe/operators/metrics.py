"""A-4 .. A-7: operational metrics over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import ColumnLike, as_col
from cloakframe.plans.ordering import running_total

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]

# HTTP methods kept as labels; anything else is "other".
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT", "TRACE"]


def method_label(c: ColumnLike):
    method = as_col(c)
    return F.when(method.isin(*HTTP_METHODS), method).otherwise("other")


def op_counters(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A-4: one counter per label set."""
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def latency_histogram(
    events: DataFrame,
    seconds: str,
    labels: Sequence[str] = (),
    bounds: Sequence[float] = tuple(LATENCY_BOUNDS),
) -> DataFrame:
    """A-5: cumulative buckets ``(le, n)`` plus the ``sum`` and ``count`` of the series.

    All buckets are computed in one aggregate, then laid out as rows.
    """
    value = F.col(seconds)
    marks = [*bounds, float("inf")]
    counts = [F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(marks)]
    totals = events.groupBy(*labels).agg(
        *counts, F.sum(seconds).alias("sum"), F.count(seconds).alias("count")
    )
    names = ["+Inf" if b == float("inf") else f"{b:g}" for b in marks]
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("le"), F.col(f"_b{i}").alias("n"))
            for i, name in enumerate(names)
        ]
    )
    return totals.select(*labels, F.explode(cells).alias("cell"), "sum", "count").select(
        *labels, "cell.le", "cell.n", "sum", "count"
    )


def latency_summary(
    events: DataFrame,
    value: str,
    labels: Sequence[str],
    ts: str,
    exact: bool = True,
) -> DataFrame:
    """A-7: avg, p95, p99 and throughput per label set.

    Exact percentiles are read off running counts over the distinct values of a group, which
    works for groups of any size; ``exact=False`` uses a sketch of fixed size in one pass.
    """
    labels = list(labels)
    span = F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(
        F.min(ts).cast("timestamp")
    )
    totals = [
        F.count("*").alias("n"),
        F.count(value).alias("_n"),
        F.avg(value).alias("avg"),
        (span / 1e6).alias("_span"),
    ]
    marks = {"p95": 0.95, "p99": 0.99}
    if not exact:
        sketch = [F.percentile_approx(value, q, 10_000).alias(m) for m, q in marks.items()]
        summary = events.groupBy(*labels).agg(*totals, *sketch)
    else:
        summary = events.groupBy(*labels).agg(*totals)
        counted = (
            events.filter(F.col(value).isNotNull())
            .groupBy(*labels, F.col(value).alias("_v"))
            .agg(F.count("*").alias("_c"))
        )
        upto = running_total(counted, labels, ["_v"], "_c", "_upto")
        sized = upto.join(summary.select(*labels, "_n"), labels)
        ends = []
        for m, q in marks.items():
            rank = (F.col("_n") - 1) * F.lit(q)
            for side, at in [("lo", F.floor(rank)), ("hi", F.ceil(rank))]:
                ends.append(F.min(F.when(F.col("_upto") > at, F.col("_v"))).alias(f"_{m}{side}"))
        summary = summary.join(sized.groupBy(*labels).agg(*ends), labels, "left")
        for m, q in marks.items():
            rank = (F.col("_n") - 1) * F.lit(q)
            lo, hi = F.col(f"_{m}lo"), F.col(f"_{m}hi")
            summary = summary.withColumn(m, lo + (hi - lo) * (rank - F.floor(rank)))
    rate = F.when(F.col("_span") > 0, F.col("n") / F.col("_span"))
    return summary.select(*labels, "n", "avg", "p95", "p99", rate.alias("per_second"))
