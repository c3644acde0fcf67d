"""A-1, W-6: batch rules over frames of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.plans.ordering import row_numbers

# Fixed value: items per batch.
BATCH_MAX = 128


def duplicate_refs(df: DataFrame, ref: str, batch: list[str], pos: str) -> DataFrame:
    """A-1: per batch, the first item whose ref was already used in that batch.

    Two hash aggregates and a join instead of a window: the first aggregate combines inside
    each task, and only refs that do repeat reach the join.
    """
    items = df.select(*batch, ref, F.col(pos).alias("_at")).filter(F.col(ref).isNotNull())
    repeated = (
        items.groupBy(*batch, ref)
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    later = items.join(repeated, [*batch, ref]).filter(F.col("_at") > F.col("_first"))
    return later.groupBy(*batch).agg(F.min("_at").alias(pos))


def batch_slots(
    df: DataFrame, order: list[str], keys: list[str] = (), size: int = BATCH_MAX
) -> DataFrame:
    """W-6: item number within each key, cut into batches of at most ``size`` items."""
    numbered = row_numbers(df, list(keys), order, "_rn")
    slot = F.col("_rn") - 1
    return numbered.select(
        *df.columns,
        F.floor(slot / size).cast("long").alias("batch"),
        (slot % size).cast("int").alias("item"),
    )
