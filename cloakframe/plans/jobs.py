"""How a column job ends: outputs, error column, and what happens to bad rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import error, error_when, first_error

# Why a key in each status is refused.
BLOCKED = {
    "disabled": "key is currently disabled",
    "compromised": "key is compromised and cannot be used for security reasons",
    "destroyed": "key is logically destroyed and cannot be used",
}
RETIRED = "key is retired and can only be used for decrypt or verification"
UNKNOWN_STATUS = "key lifecycle status does not allow this operation"


class JobError(ValueError):
    """Raised by ``on_error='fail'``: the whole frame is refused for its first bad row."""


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a projected column is pushed below the projection and computes it a second
    time, however costly it is. Rows of a one-element array are a barrier to that.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[made.alias(name) for name, made in columns.items()])
    return df.select(*kept, F.inline_outer(F.array(row)))


def lifecycle_error(status: Column, use: str) -> Column:
    """P-12: ``new`` needs an active key, ``verify`` an active or retired one."""
    if use not in ("new", "verify"):
        raise ValueError(f"unknown key use: {use}")
    refused = F.when(status == "active", F.lit(None))
    refused = refused.when(status == "retired", F.lit(RETIRED if use == "new" else None))
    for name, message in BLOCKED.items():
        refused = refused.when(status == name, F.lit(message))
    refused = refused.when(status.isNotNull(), F.lit(UNKNOWN_STATUS)).cast("string")
    return F.when(refused.isNotNull(), error("forbidden", refused))


def finish(
    df: DataFrame, outputs: dict[str, Column], problem: Column, on_error: str, pos: str | None
):
    """Attach outputs and the ``error`` column.

    ``null``       one frame; failed rows carry NULL outputs and the reason
    ``quarantine`` two frames: good rows, and rejected rows with the reason
    ``fail``       all or nothing: raise for the first bad row in ``pos`` order
    """
    if on_error == "null":
        out = df.withColumn("error", problem)
    else:
        out = compute_once(df, {"error": problem})
    ok = F.col("error").isNull()
    out = out.withColumns({name: F.when(ok, made) for name, made in outputs.items()})
    out = out.select(*[c for c in out.columns if c != "error"], "error")
    if on_error == "null":
        return out
    if on_error == "quarantine":
        return out.filter(ok).drop("error"), out.filter(~ok)
    if on_error == "fail":
        if pos is None:
            raise ValueError("on_error='fail' needs the position column")
        failed = first_failure(out, pos).first()
        if failed["message"] is not None:
            raise JobError(failed["message"])
        return out.drop("error")
    raise ValueError(f"unknown on_error: {on_error}")


DUPLICATE_REF = "batch contains duplicated ref"
STREAM_REFS = "a job with refs runs on micro-batches, not on a stream"


def require_unique_refs(df: DataFrame, ref: str) -> None:
    """A-1: refuse a frame that uses a ref twice; only refs are shuffled, and none is returned.

    This runs a job over the ref column. On a stream nobody could do that, so a job with refs is
    refused there; ``protect_batches`` and ``foreachBatch`` run it on micro-batches.
    """
    if df.isStreaming:
        raise JobError(STREAM_REFS)
    refs = df.select(F.col(ref).cast("string").alias("ref")).where("ref is not null")
    if refs.groupBy("ref").count().where("count > 1").first() is not None:
        raise JobError(DUPLICATE_REF)


def first_failure(df: DataFrame, pos: str, keys: Sequence[str] = ()) -> DataFrame:
    """L-1: the first failing row in input order decides the error of the batch.

    One partial aggregate per task; ``min`` over a struct keeps the earliest position.
    """
    first = F.min(
        F.when(
            F.col("error").isNotNull(),
            F.struct(
                F.col(pos).cast("long").alias("pos"),
                F.col("error.kind").alias("kind"),
                F.col("error.message").alias("message"),
            ),
        )
    )
    found = df.groupBy(*keys).agg(first.alias("f"))
    text = F.concat(
        F.lit("batch item "), F.col("f.pos").cast("string"), F.lit(" failed: "), F.col("f.message")
    )
    return found.select(
        *keys,
        F.col("f.pos").alias("pos"),
        F.col("f.kind").alias("kind"),
        text.alias("message"),
    )


def validate_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows by the first failing rule. ``rules`` maps a rule name to its error column."""
    tagged = [
        F.when(
            problem.isNotNull(),
            F.struct(
                F.lit(name).alias("rule"),
                problem["kind"].alias("kind"),
                problem["message"].alias("message"),
            ),
        )
        for name, problem in rules.items()
    ]
    checked = df.withColumn("_failed", F.coalesce(*tagged))
    good = checked.filter(F.col("_failed").isNull()).drop("_failed")
    rejects = checked.filter(F.col("_failed").isNotNull()).select(*df.columns, "_failed.*")
    return good, rejects


__all__ = [
    "JobError",
    "compute_once",
    "error_when",
    "finish",
    "first_error",
    "first_failure",
    "lifecycle_error",
    "require_unique_refs",
    "validate_rows",
]
