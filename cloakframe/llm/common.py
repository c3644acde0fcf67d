"""Tables and session helpers of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.plans.runtime import new_scratch, shared_dir, ship_package

__all__ = ["hashed_sample", "new_scratch", "prepare", "row_key", "shared_dir", "stored", "table", "texts", "unused"]


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare() -> None:
    """Ship the package, and pass texts to Python in batches of 1000 rows where the session has
    Spark's default of 10 000: texts can be long."""
    ship_package()
    conf = SparkSession.active().conf
    if conf.get(BATCH_ROWS) == "10000":
        conf.set(BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare()
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text; other columns, whatever their names, stay outside."""
    prepare()
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def row_key(*columns: str) -> Column:
    """Identity of a row that repeats when a lost task is run again."""
    return F.xxhash64(*columns)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends and sizes are known."""
    path = new_scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(rows: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """At most ``n`` of ``total`` rows, those with the least ``key`` (a hash of the row).

    Rows that cannot be among them are filtered out first, so that tasks together send about
    twice ``n`` rows to the driver, however many tasks there are.
    """
    if total > 2 * n:
        rows = rows.where(F.pmod(key, F.lit(1 << 31)) < int((1 << 31) * 2 * n / total))
    return rows.orderBy(F.pmod(key, F.lit(1 << 31)), key).limit(n)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
