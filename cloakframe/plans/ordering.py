"""Ordered computations over groups of any size.

A window function sends a whole group to one task. When one group may hold a third of the
data, order is instead computed in two levels: rows are cut into blocks that are ranges of the
order, each block is handled by itself, and what passes from block to block (a row count, the
last value seen) is a small table with one row per block and group.
There is one path for all sizes: a group of three rows and a group of a third of the table are
computed the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.plans.runtime import cut_lineage


def range_blocks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_blk`` and ``_at``: rows of a group are ordered by ``(_blk, _at)``.

    Range boundaries are sampled, so a second evaluation could place them elsewhere; the
    blocks are therefore materialized once in the shared folder.
    """
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_blk", F.spark_partition_id().cast("long"))
        .withColumn("_at", F.monotonically_increasing_id())
    )
    return cut_lineage(placed)


def carry_between(blocks: DataFrame, keys: list[str], per_block: dict[str, Column]) -> DataFrame:
    """For each block, aggregate ``per_block`` over all earlier blocks of the group.

    ``blocks`` has one row per group and block, so the window of the largest group is as small
    as the number of blocks: about a million rows at 100 TB.
    """
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return blocks.select(
        *keys, "_blk", *[agg.over(earlier).alias(name) for name, agg in per_block.items()]
    )


def join_carried(placed: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Attach block values to rows; NULL is a group key like any other."""
    renamed = carried.withColumnsRenamed({k: f"_c_{k}" for k in [*keys, "_blk"]})
    match = F.col("_blk") == F.col("_c__blk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return placed.join(renamed, match, "left").drop(*[f"_c_{k}" for k in [*keys, "_blk"]])


def running_total(
    df: DataFrame, keys: list[str], order: list[str], weight: str, name: str
) -> DataFrame:
    """Sum of ``weight`` up to and including each row; ``order`` is unique within a group."""
    placed = range_blocks(df, keys, order)
    sums = placed.groupBy(*keys, "_blk").agg(F.sum(weight).alias("_n"))
    offsets = carry_between(sums, keys, {"_before": F.sum("_n")})
    within = Window.partitionBy(*keys, "_blk").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    total = F.sum(weight).over(within) + F.coalesce("_before", F.lit(0))
    return join_carried(placed, offsets, keys).withColumn(name, total).select(*df.columns, name)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number`` per group in ``order``, which is unique within a group."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(ones, keys, order, "_one", name).select(*df.columns, name)


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str
) -> DataFrame:
    """The latest non-null ``value`` among strictly earlier rows of the group."""
    df = df.withColumn("_value", value)
    kept = [c for c in df.columns if c != "_value"]
    return carry_value(range_blocks(df, keys, order), keys, ["_at"], name).select(*kept, name)


def carry_value(placed: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``previous_value`` for rows that already carry ``_blk`` and ``_value``."""
    last = F.max(
        F.when(
            F.col("_value").isNotNull(),
            F.struct(*[F.col(c) for c in order], F.col("_value").alias("_value")),
        )
    )
    ends = placed.groupBy(*keys, "_blk").agg(last.alias("_end"))
    carried = carry_between(ends, keys, {"_carry": F.last("_end", ignorenulls=True)})
    within = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    near = F.last("_value", ignorenulls=True).over(within)
    joined = join_carried(placed, carried, keys)
    return joined.withColumn(name, F.coalesce(near, F.col("_carry._value"))).drop("_carry")
