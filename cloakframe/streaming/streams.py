"""T-1 .. T-6: the same work on streams; chains are in ``chains``."""

from __future__ import annotations

import time
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import error
from cloakframe.operators.metrics import op_counters
from cloakframe.operators.tags import keyed_digest
from cloakframe.operators.tokens import NOT_FOUND, looked_up, opened
from cloakframe.plans.jobs import DUPLICATE_REF, JobError
from cloakframe.plans.policy import Policy
from cloakframe.plans.protect import Step, protect_frame
from cloakframe.sources.tables import ConcurrentWrite, SnapshotTable, TableError, upsert_index
from cloakframe.streaming.chains import append_chain_stream, seal_open_chains, verify_chain_stream


def protect_stream(
    stream: DataFrame, steps: list[Step], policy: Policy, drop: list[str] = ()
) -> DataFrame:
    """T-1: per-arrival protection. The jobs are stateless columns, so this is the batch job;
    failed rows carry their ``error``.

    Steps that need a ``ref`` are refused here, because no row of a stream can know of another;
    ``protect_batches`` takes them.
    """
    return protect_frame(stream, steps, policy, drop, on_error="null")


def protect_batches(
    stream: DataFrame, steps: list[Step], policy: Policy, sink, rejects=None, drop: list[str] = ()
):
    """T-1 with refs: each micro-batch is one batch, in which a ref stands once. Returns the writer.

    All rows of a ref that a micro-batch repeats, and rows that fail a check, go to
    ``rejects(rows, batch_id)`` with their ``error``; without ``rejects`` such a row stops the stream.
    """
    refs = sorted({s.ref for s in steps if s.ref})

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = F.lit(True)
        for ref in refs:
            ref_of, many = F.col(ref).cast("string"), f"_times_{ref}"
            times = batch.select(ref_of.alias(f"_ref_{ref}")).groupBy(f"_ref_{ref}").agg(F.count("*").alias(many))
            repeated = times.where(F.col(many) > 1)
            batch = batch.join(repeated, ref_of == F.col(f"_ref_{ref}"), "left").drop(f"_ref_{ref}")
            ok = ok & F.col(many).isNull()
        marks = [f"_times_{ref}" for ref in refs]
        twice = batch.where(~ok).drop(*marks).withColumn("error", error("invalid_input", F.lit(DUPLICATE_REF)))
        good, bad = protect_frame(batch.where(ok).drop(*marks), steps, policy, on_error="quarantine")
        bad = bad.select(*stream.columns, "error").unionByName(twice)
        if rejects is not None:
            rejects(bad, batch_id)
        elif (first := bad.select("error.message").first()) is not None:
            raise JobError(first["message"])
        sink(good.drop(*drop), batch_id)

    return stream.writeStream.foreachBatch(write)


def index_stream(
    stream: DataFrame, col: str, profile: str, policy: Policy, table: SnapshotTable, rejects=None
):
    """T-2: blind-index ingestion; replaying a micro-batch adds nothing. Returns the writer.

    ``rejects(rows, batch_id)`` receives the rows that failed validation, with their ``error``;
    without it such a row stops the stream.
    """
    kid = policy.profile("mac", profile)["kid"]

    def write(batch: DataFrame, batch_id: int) -> None:
        done = keyed_digest(batch, col, profile, policy, "digest", on_error="null")
        bad = done.filter(F.col("error").isNotNull())
        if rejects is not None:
            rejects(bad.drop("digest"), batch_id)
        elif (first := bad.select("error.message").first()) is not None:
            raise JobError(first["message"])
        rows = done.filter(F.col("digest").isNotNull()).select(F.lit(kid).alias("kid"), "digest")
        upsert_index(rows, table)

    return stream.writeStream.foreachBatch(write)


def redeem_stream(
    stream: DataFrame,
    token_col: str,
    profile: str,
    policy: Policy,
    table: SnapshotTable,
    sink,
    rejects=None,
    name: str = "redeem",
    retries: int = 100,
):
    """T-3: of all redemptions of a one-time token exactly one wins. Returns the writer.

    The vault decides. The vault rows of a micro-batch are staged as they are, sealed; one commit
    deletes those that open and records the batch under ``name``; then ``sink(winners, batch_id)``
    receives them, opened on the way, and has to have stored them when it returns. After that the
    staged rows are erased, so that plaintext never lies below the table path and nothing stays
    there. A replayed batch that is recorded goes straight to the sink (which has to accept a batch
    twice) while its rows are still staged, and nowhere once they are erased. Rows that are
    malformed, unknown or damaged, and repeats within a batch, go to ``rejects(rows, batch_id)``
    with their ``error``; their vault rows stay. Other writers of the table make a commit wait
    and try again, up to ``retries`` times.
    """
    spec = policy.profile("token", profile)
    if not spec["one_time"]:
        raise JobError("tokenization profile is not one-time")

    def judged(rows: DataFrame) -> DataFrame:
        """Staged rows with ``error`` or ``plaintext``; of equal tokens the first row counts."""
        first = rows.where("hashid is not null").groupBy("hashid").agg(F.min("_row").alias("_first"))
        told = rows.join(first, "hashid", "left")
        done = opened(told, rows.columns + ["_first"], profile, policy, "null")
        late = F.when(F.col("_row") != F.col("_first"), error("not_found", F.lit(NOT_FOUND)))
        return done.withColumn("error", F.coalesce("error", late))

    def write(batch: DataFrame, batch_id: int) -> None:
        staged = f"{table.path}/_redeemed/{name}/batch={batch_id}"
        version = table.version()
        if table.state(version).get("marks", {}).get(name, -1) < batch_id:
            for attempt in range(retries + 1):
                found = looked_up(batch, token_col, profile, policy, table, version)
                found.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
                rows = judged(table.spark.read.parquet(staged))
                try:
                    table.delete(rows.where("error is null").select("kid", "hashid"), version, mark=(name, batch_id))
                    break
                except ConcurrentWrite:
                    if attempt == retries:
                        raise TableError("too many concurrent writers") from None
                    time.sleep(min(0.05 * 2**attempt, 5.0))
                    version = table.version()
        if not table.has(staged):
            return  # the sink had it before
        rows = judged(table.spark.read.parquet(staged)).select(*batch.columns, "plaintext", "metadata", "error")
        sink(rows.where("error is null").drop("error"), batch_id)
        if rejects is not None:
            rejects(rows.where("error is not null").drop("plaintext", "metadata"), batch_id)
        table.erase(staged)

    return stream.writeStream.foreachBatch(write)


def counters_stream(events: DataFrame, labels: list[str]) -> DataFrame:
    """T-6: running counters; write with ``outputMode('complete')`` or ``'update'``."""
    return op_counters(events, labels)


__all__ = [
    "append_chain_stream",
    "counters_stream",
    "index_stream",
    "protect_batches",
    "protect_stream",
    "redeem_stream",
    "seal_open_chains",
    "verify_chain_stream",
]
