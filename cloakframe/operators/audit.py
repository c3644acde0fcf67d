"""W-1, W-2, W-5, A-3: building and verifying hash-chained audit logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.digests import hmac_hex, python_hash
from cloakframe.functions.text import object_json, sanitize, utf8
from cloakframe.plans.ordering import carry_between, join_carried, row_numbers
from cloakframe.plans.runtime import cut_lineage, ship_package
from cloakframe.sources.audit_log import (
    BODY_FIELDS,
    CHECKPOINT_EVERY,
    CHECKPOINT_VERSION,
    DEFAULT_HASH,
    GENESIS_ACTION,
    GENESIS_EVENT,
    RECORD_DOMAIN,
    RECORD_FIELDS,
    RECORD_VERSION,
    TEXT_FIELDS,
    TEXT_MAX_CHARS,
    ZERO_HASH,
    json_of,
)

# --- W-5: building --------------------------------------------------------------------

_BEFORE = [f for f in BODY_FIELDS if f < "prev_hash"]
_AFTER = [f for f in BODY_FIELDS if f > "prev_hash"]


def _event_struct(events: DataFrame, alg: str) -> dict[str, Column]:
    """Record fields taken from the event columns that exist; missing ones get defaults."""
    have = set(events.columns)
    fields: dict[str, Column] = {}
    for name in TEXT_FIELDS:
        value = F.col(name).cast("string") if name in have else F.lit("")
        fields[name] = F.coalesce(sanitize(value, TEXT_MAX_CHARS), F.lit(""))
    if "outcome" not in have:
        fields["outcome"] = F.lit("success")
    for name in ["root", "admin"]:
        fields[name] = F.col(name) if name in have else F.lit(False)
    fields["timestamp"] = F.col("timestamp").cast("string")
    fields["version"] = F.lit(RECORD_VERSION)
    fields["hash_alg"] = F.lit(alg)
    fields["chain_id"] = F.col("chain_id")
    return fields


def _genesis(fields: dict[str, Column]) -> dict[str, Column]:
    first = {name: F.lit("") for name in TEXT_FIELDS}
    first |= {
        "event": F.lit(GENESIS_EVENT),
        "outcome": F.lit("success"),
        "action": F.lit(GENESIS_ACTION),
        "root": F.lit(False),
        "admin": F.lit(False),
    }
    return {**fields, **first}


def link_batches(alg: str):
    """Arrow iterator that fills in hashes; rows of a chain arrive together and in order."""
    ship_package()
    make = python_hash(alg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = ZERO_HASH
        for batch in batches:
            prev, own = [], []
            rows = zip(
                batch.column("sequence").to_pylist(),
                batch.column("_before").to_pylist(),
                batch.column("_after").to_pylist(),
            )
            for sequence, before, after in rows:
                last = ZERO_HASH if sequence == 0 else head
                body = f'{before[:-1]},"prev_hash":"{last}",{after[1:]}'
                head = make(RECORD_DOMAIN + body.encode()).hexdigest()
                prev.append(last)
                own.append(head)
            kept = [n for n in batch.schema.names if n not in ("_before", "_after")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(prev), pa.array(own)],
                names=[*kept, "prev_hash", "event_hash"],
            )

    return run


def build_chain(
    events: DataFrame,
    chain_key: list[str],
    order: list[str],
    log_id: str = "",
    segment: int = CHECKPOINT_EVERY,
    alg: str = DEFAULT_HASH,
) -> DataFrame:
    """Chain the events of each key in ``order`` (unique per key).

    A hash chain is sequential, so a key is cut into chains of at most ``segment`` events, each
    starting with its own genesis record: chains are then independent and of bounded size, and
    a key that holds a third of all events is hashed by many tasks. ``events`` needs an
    ``event`` and a ``timestamp`` column (decimal Unix seconds). Returns the record fields plus
    ``chain_key`` columns, ``place`` and ``line``.
    """
    numbered = row_numbers(events, chain_key, order, "_rn")
    cut = F.floor((F.col("_rn") - 1) / segment).cast("string")
    name = F.concat_ws("|", F.lit(log_id), *[F.col(k).cast("string") for k in chain_key], cut)
    keyed = numbered.withColumn("chain_id", F.left(F.sha2(name, 256), F.lit(32)))
    keyed = keyed.withColumn("_seq", ((F.col("_rn") - 1) % segment + 1).cast("long"))
    fields = _event_struct(events, alg)

    def body(values: dict[str, Column], sequence: Column) -> Column:
        full = {**values, "sequence": sequence}
        return F.struct(*[full[n].alias(n) for n in BODY_FIELDS if n != "prev_hash"])

    here = body(fields, F.col("_seq"))
    start = body(_genesis(fields), F.lit(0).cast("long"))
    rows = F.when(F.col("_seq") == 1, F.array(start, here)).otherwise(F.array(here))
    keys = [k for k in chain_key if k not in RECORD_FIELDS]
    bodies = keyed.select(*keys, F.explode(rows).alias("_b"))
    ready = bodies.select(
        *keys,
        "_b.*",
        json_of("_b", _BEFORE).alias("_before"),
        json_of("_b", _AFTER).alias("_after"),
    )
    ordered = ready.repartition("chain_id").sortWithinPartitions("chain_id", "sequence")
    schema = ordered.drop("_before", "_after").schema
    schema = schema.add("prev_hash", "string").add("event_hash", "string")
    linked = ordered.mapInArrow(link_batches(alg), schema)
    linked = linked.withColumn("_r", F.struct(*[F.col(n).alias(n) for n in RECORD_FIELDS]))
    return linked.withColumns(
        {"place": F.col("sequence") * 2, "line": json_of("_r", RECORD_FIELDS)}
    ).drop("_r")


def checkpoint_seal(fields: dict[str, Column], pads: Column) -> Column:
    signed = {n: fields[n] for n in ["chain_id", "created_at", "head_hash", "last_sequence"]}
    signed["version"] = F.lit(CHECKPOINT_VERSION)
    return hmac_hex(utf8(object_json(signed)), pads["ipad"], pads["opad"])


def make_checkpoints(
    records: DataFrame, pads: Column, every: int = CHECKPOINT_EVERY, created_at: str = "0"
) -> DataFrame:
    """Checkpoint lines: after every ``every`` events and at the end of each chain."""
    ends = records.groupBy("chain_id").agg(F.max("sequence").alias("_end"))
    at = records.join(ends, "chain_id").filter(
        (F.col("sequence") == F.col("_end"))
        | ((F.col("sequence") > 0) & (F.col("sequence") % every == 0))
    )
    fields = {
        "chain_id": F.col("chain_id"),
        "created_at": F.lit(created_at),
        "head_hash": F.col("event_hash"),
        "last_sequence": F.col("sequence"),
    }
    made = at.withColumn("_seal", checkpoint_seal(fields, pads))
    line = object_json(
        {**fields, "seal": F.col("_seal"), "version": F.lit(CHECKPOINT_VERSION)}
    )
    return made.select("chain_id", (F.col("sequence") * 2 + 1).alias("place"), line.alias("line"))


def log_lines(records: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Records and checkpoints as one log: ``chain_id, place, line``."""
    lines = records.select("chain_id", "place", "line")
    if checkpoints is None:
        return lines
    return lines.unionByName(checkpoints.select("chain_id", "place", "line"))


def as_log(lines: DataFrame, per_block: int = 4096) -> DataFrame:
    """Chain lines held in memory, shaped like a scanned log: one log per chain."""
    return lines.select(
        F.col("chain_id").alias("log"),
        F.lpad(F.floor(F.col("place") / per_block).cast("string"), 20, "0").alias("_blk"),
        F.col("place").alias("_at"),
        "line",
    )


# --- W-1, W-2: verifying --------------------------------------------------------------


def link_lines(parsed: DataFrame, seal: Column | None = None) -> DataFrame:
    """Check every line against the record before it in its log.

    Adds ``line_no``, completes ``reason``, and keeps the linking fields (``hash`` is the event
    hash of a record or the head hash of a checkpoint).
    Two levels: a window inside each file split, and one summary row per split that carries the
    last record and the line count over to the next one. Nothing is ordered across a whole log.
    The few fields all levels need are shuffled and stored once, so a line is parsed and hashed once
    however often the result is read.
    """
    lines = cut_lineage(_slim(parsed, seal).repartition("log", "_blk"))
    is_record, is_checkpoint = F.col("kind") == "record", F.col("kind") == "checkpoint"
    lines = lines.withColumn("_head", F.when(is_record, F.struct("chain_id", "sequence", "hash")))
    newest = F.max(
        F.when(F.col("_head").isNotNull(), F.struct(F.col("_at"), F.col("_head").alias("h")))
    )
    ends = lines.groupBy("log", "_blk").agg(newest.alias("_end"), F.count("*").alias("_n"))
    carried = carry_between(
        ends,
        ["log"],
        {"_carry": F.last("_end", ignorenulls=True), "_before": F.sum("_n")},
    )
    block = Window.partitionBy("log", "_blk").orderBy("_at")
    near = F.last("_head", ignorenulls=True).over(
        block.rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = join_carried(lines, carried, ["log"])
    placed = placed.withColumns(
        {
            "line_no": F.row_number().over(block) + F.coalesce("_before", F.lit(0)),
            "_prev": F.coalesce(near, F.col("_carry.h")),
        }
    )
    prev = F.col("_prev")
    follows = is_record & ~F.col("_genesis")
    checks = [
        (follows & prev.isNull(), "first record must start a chain"),
        (
            follows & (F.col("chain_id") != prev["chain_id"]),
            "chain_id changed without a genesis record",
        ),
        (
            follows & (F.col("sequence") != prev["sequence"] + 1),
            "sequence is not consecutive",
        ),
        (
            follows & (F.col("prev_hash") != prev["hash"]),
            "prev_hash does not match prior event hash",
        ),
        (is_checkpoint & prev.isNull(), "checkpoint appears before chain genesis"),
        (
            is_checkpoint & F.col("_seal_bad"),
            "audit checkpoint signature verification failed",
        ),
        (
            is_checkpoint & (F.col("chain_id") != prev["chain_id"]),
            "checkpoint chain_id does not match active chain",
        ),
        (
            is_checkpoint & (F.col("sequence") != prev["sequence"]),
            "checkpoint sequence does not match active chain",
        ),
        (
            is_checkpoint & (F.col("hash") != prev["hash"]),
            "checkpoint head_hash does not match active chain",
        ),
    ]
    linked = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])
    return placed.withColumn("reason", F.coalesce("reason", linked)).select(
        "log", "line_no", "kind", "chain_id", "sequence", "hash", "reason"
    )


def _slim(parsed: DataFrame, seal: Column | None) -> DataFrame:
    """The few fields linking needs, so that only they are shuffled."""
    doc, is_checkpoint = F.col("doc"), F.col("kind") == "checkpoint"
    seal_bad = F.lit(False)
    if seal is not None:
        fields = {n: doc[n] for n in ["chain_id", "created_at", "head_hash", "last_sequence"]}
        seal_bad = is_checkpoint & (F.lower(doc["seal"]) != checkpoint_seal(fields, seal))
    return parsed.select(
        "log",
        "_blk",
        "_at",
        "kind",
        "reason",
        F.coalesce(doc["event"] == GENESIS_EVENT, F.lit(False)).alias("_genesis"),
        doc["chain_id"].alias("chain_id"),
        F.when(is_checkpoint, doc["last_sequence"]).otherwise(doc["sequence"]).alias("sequence"),
        F.when(is_checkpoint, doc["head_hash"]).otherwise(doc["event_hash"]).alias("hash"),
        doc["prev_hash"].alias("prev_hash"),
        seal_bad.alias("_seal_bad"),
    )


def verify_chain(linked: DataFrame) -> DataFrame:
    """W-1: one row per log ``(log, lines, valid, bad_line, reason)``; the first bad line wins."""
    first = F.min(
        F.when(
            F.col("reason").isNotNull(), F.struct(F.col("line_no"), F.col("reason"))
        )
    )
    found = linked.groupBy("log").agg(F.count("*").alias("lines"), first.alias("_f"))
    return found.select(
        "log",
        "lines",
        F.col("_f").isNull().alias("valid"),
        F.col("_f.line_no").alias("bad_line"),
        F.col("_f.reason").alias("reason"),
    )


def verify_checkpoints(linked: DataFrame) -> DataFrame:
    """W-2: every checkpoint with its place and whether it equals the running head."""
    return linked.filter("kind = 'checkpoint'").select(
        "log",
        "line_no",
        "chain_id",
        F.col("sequence").alias("last_sequence"),
        F.col("reason").isNull().alias("valid"),
        "reason",
    )


def chain_summary(linked: DataFrame, per_block: int = 65_536) -> DataFrame:
    """A-3: one row per chain: size, head, and what its checkpoints covered.

    Verification stops at the first bad line of a log: neither that line nor any behind it counts.
    A whole folder may be one log, so lines learn of it by log and block of ``per_block`` lines: a
    log is neither joined nor aggregated in one task.
    """
    lines = linked.withColumn("_blk", F.floor(F.col("line_no") / per_block))
    first = F.min(F.when(F.col("reason").isNotNull(), F.col("line_no")))
    blocks = lines.groupBy("log", "_blk").agg(first.alias("_first"))
    so_far = Window.partitionBy("log").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    stops = blocks.withColumn("_bad", F.min("_first").over(so_far)).where("_bad is not null").drop("_first")
    lines = join_carried(lines, stops, ["log"])
    linked = lines.where(F.col("_bad").isNull() | (F.col("line_no") < F.col("_bad")))
    is_record, is_checkpoint = F.col("kind") == "record", F.col("kind") == "checkpoint"
    end = F.struct(F.col("sequence").alias("s"), F.col("hash").alias("h"))
    grouped = (
        linked.groupBy("log", "chain_id")
        .agg(
            F.count_if(is_record).alias("records"),
            F.max(F.when(is_record, end)).alias("_h"),
            F.count_if(is_checkpoint).alias("checkpoints_verified"),
            F.max(F.when(is_checkpoint, end)).alias("_m"),
        )
    )
    return grouped.select(
        "log",
        "chain_id",
        "records",
        F.col("_h.s").alias("last_sequence"),
        F.col("_h.h").alias("head_hash"),
        "checkpoints_verified",
        F.col("_m.s").alias("last_checkpoint_sequence"),
        F.col("_m.h").alias("last_checkpoint_head_hash"),
    )
