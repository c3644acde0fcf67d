"""T-4 and T-5: hash chains on streams, with state that stays small.

Both keep their state per chain in the state store and take a micro-batch frame by frame, so memory
holds one Arrow batch, however many events one key has. They need the RocksDB state store, which
``keep_state`` sets for a session.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import batched
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from cloakframe.functions.digests import python_hash
from cloakframe.functions.text import object_json
from cloakframe.operators.audit import _AFTER, _BEFORE, _event_struct, _genesis, checkpoint_seal
from cloakframe.plans.runtime import ship_package
from cloakframe.sources.audit_log import (
    CHECKPOINT_EVERY,
    CHECKPOINT_VERSION,
    DEFAULT_HASH,
    GENESIS_EVENT,
    RECORD_DOMAIN,
    RECORD_FIELDS,
    ZERO_HASH,
    field_names,
    record_hash,
)

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Use the state store that these streams need; set it before a stream starts.

    Spark also loads a state processor on the driver, outside the session's own Python files.
    """
    if spark.conf.get(_PROVIDER) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    seen, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in seen.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        seen["PYTHONPATH"] = os.pathsep.join([*paths, here])


# --- T-4: verifying a chain as it grows -----------------------------------------------

_VERIFY_OUT = (
    "chain_id string, records bigint, last_sequence bigint, head_hash string, "
    "pending bigint, valid boolean, reason string"
)


SPAN = 64  # early records that share an entry of the state
ENTRIES = 256  # entries that a task holds
FRAME = 10_000  # records sorted at once


class _ChainVerifier(StatefulProcessor):
    """Advances the head of a chain; records that are early wait in a map by ranges of their sequence.

    A call to the state store costs more than a record, so ``SPAN`` early records share an entry, and
    an entry is read and written once for a frame (or as often as ``ENTRIES`` others come between).
    One frame and ``ENTRIES`` entries are in memory.
    """

    def __init__(self, patience_ms: int | None) -> None:
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState(
            "head", "records bigint, last_sequence bigint, head_hash string, pending bigint, reason string"
        )
        self.early = handle.getMapState("early", "range bigint", "waiting string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        records, last, head, pending, reason = self.head.get() if self.head.exists() else (0, -1, ZERO_HASH, 0, "")
        ranges: dict[int, dict] = {}  # entries in memory
        changed: set[int] = set()
        stored = pending > 0  # whether the map holds anything

        def step(sequence, prev_hash, event_hash, genesis, hash_ok):
            nonlocal records, last, head, reason
            if not hash_ok:
                reason = "event hash does not match record content"
            elif genesis != (sequence == 0):
                reason = "chain genesis is invalid"
            elif prev_hash != head:
                reason = "prev_hash does not match prior event hash"
            else:
                records, last, head = records + 1, sequence, event_hash

        def entry(sequence) -> dict:
            at = sequence // SPAN
            if at not in ranges:
                if len(ranges) >= ENTRIES:
                    flush()
                found = self.early.getValue((at,)) if stored else None
                ranges[at] = {} if found is None else {r[0]: r[1:] for r in json.loads(found[0])}
            return ranges[at]

        def advance():
            nonlocal pending
            while pending and not reason and last + 1 in entry(last + 1):
                waiting = entry(last + 1).pop(last + 1)
                changed.add((last + 1) // SPAN)
                pending -= 1
                step(last + 1, *waiting)

        def flush():
            nonlocal stored
            for at in changed:
                if ranges[at]:
                    self.early.updateValue((at,), (json.dumps([[s, *r] for s, r in ranges[at].items()]),))
                    stored = True
                elif stored:
                    self.early.removeKey((at,))
            ranges.clear()
            changed.clear()

        for frame in batched(rows, FRAME):
            if reason:
                continue  # a failed chain stays failed
            for row in sorted(frame, key=lambda r: r.sequence):
                at = int(row.sequence)
                record = (row.prev_hash, row.event_hash, bool(row.genesis), bool(row.hash_ok))
                if at <= last or (at > last + 1 and pending and at in entry(at)):
                    reason = "sequence is not consecutive"
                elif at > last + 1:
                    entry(at)[at] = record
                    changed.add(at // SPAN)
                    pending += 1
                else:
                    step(at, *record)
                    advance()
                if reason:
                    break
            if not reason:
                flush()
        if reason and (pending or stored):
            self.early.clear()
            pending = 0
        self.head.update((records, last, head, pending, reason))
        self._wait(pending, timerValues)
        yield self._row(key, records, last, head, pending, reason)

    def _wait(self, pending: int, timerValues) -> None:
        if self.patience_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if pending:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        records, last, head, pending, reason = self.head.get()
        if pending and not reason:
            reason = "sequence is not consecutive"
            self.early.clear()
            self.head.update((records, last, head, 0, reason))
            yield self._row(key, records, last, head, 0, reason)

    @staticmethod
    def _row(key, records, last, head, pending, reason) -> Row:
        row = (key[0], records, last, head, pending, not reason and not pending, reason or None)
        return Row(*field_names(_VERIFY_OUT))(*row)

    def close(self) -> None:
        pass


def verify_chain_stream(
    records: DataFrame, alg: str = DEFAULT_HASH, patience_ms: int | None = None
) -> DataFrame:
    """T-4: incremental check; a failed chain stays failed. Emits a row per chain touched.

    Records may arrive in any order: an early one waits in the state (``pending``), and a chain with
    such records is not valid yet, without a reason. With ``patience_ms`` a gap that is still open
    so long after the last record of the chain fails it; without, it stays open.
    Hashes are recomputed before the shuffle.
    """
    ship_package()
    keep_state(records.sparkSession)
    packed = records.withColumn("_r", F.struct(*[F.col(n) for n in RECORD_FIELDS]))
    slim = packed.select(
        "chain_id",
        "sequence",
        "prev_hash",
        "event_hash",
        (F.col("event") == GENESIS_EVENT).alias("genesis"),
        (record_hash("_r", alg) == F.col("event_hash")).alias("hash_ok"),
    )
    return slim.groupBy("chain_id").transformWithState(
        statefulProcessor=_ChainVerifier(patience_ms),
        outputStructType=_VERIFY_OUT,
        outputMode="Update",
        timeMode="None" if patience_ms is None else "ProcessingTime",
    )


# --- T-5: appending to a chain --------------------------------------------------------

_APPEND_OUT = (
    "chain_id string, place bigint, body string, sequence bigint, event_hash string, "
    "checkpoint boolean, timestamp string"
)
_HEAD = "generation bigint, next_sequence bigint, head_hash string, since bigint, stamp string, timer bigint"


def _chain_id(lane: str, generation: int) -> str:
    return hashlib.sha256(f"{lane}|{generation}".encode()).hexdigest()[:32]


class _ChainAppender(StatefulProcessor):
    """Appends events to the chain of a lane; full chains are sealed and followed by new ones."""

    def __init__(self, every: int, most: int, idle_ms: int | None, alg: str, order: list[str]) -> None:
        self.every, self.most, self.idle_ms, self.alg, self.order = every, most, idle_ms, alg, order

    def init(self, handle) -> None:
        self.handle, self.make = handle, python_hash(self.alg)
        self.head = handle.getValueState("head", _HEAD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        generation, following, head, since, stamp, timer = (
            self.head.get() if self.head.exists() else (0, 0, ZERO_HASH, 0, "", 0)
        )
        for frame in rows:
            out = []

            def put(before, after):
                nonlocal head, following
                name = _chain_id(key[0], generation)
                body = f'{before},"sequence":{following},{after}'
                body = body.replace('"chain_id":""', f'"chain_id":"{name}"', 1)
                body = body.replace('"prev_hash":""', f'"prev_hash":"{head}"', 1)
                head = self.make(RECORD_DOMAIN + body.encode()).hexdigest()
                out.append((name, 2 * following, body, following, head, False, stamp))
                following += 1

            for row in frame.sort_values(self.order).itertuples(index=False):
                stamp = row.timestamp
                if following == 0:
                    put(row.genesis_before, row.genesis_after)
                put(row.before, row.after)
                since += 1
                full = following > self.most
                if since >= self.every or full:
                    out.append(self._seal(key, generation, following, head, stamp))
                    since = 0
                if full:
                    generation, following, head = generation + 1, 0, ZERO_HASH
            yield pd.DataFrame(out, columns=field_names(_APPEND_OUT))
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if since and self.idle_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.head.update((generation, following, head, since, stamp, timer))

    @staticmethod
    def _seal(key, generation, following, head, stamp):
        last = following - 1
        return (_chain_id(key[0], generation), 2 * last + 1, "", last, head, True, stamp)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, following, head, since, stamp, _ = self.head.get()
        if since:
            self.head.update((generation, following, head, 0, stamp, 0))
            sealed = [self._seal(key, generation, following, head, stamp)]
            yield pd.DataFrame(sealed, columns=field_names(_APPEND_OUT))

    def close(self) -> None:
        pass


def append_chain_stream(
    events: DataFrame,
    chain_key: list[str],
    order: list[str],
    pads: Column,
    every: int = CHECKPOINT_EVERY,
    lanes: int = 1,
    log_id: str = "",
    alg: str = DEFAULT_HASH,
    most: int = CHECKPOINT_EVERY,
    idle_ms: int | None = None,
) -> DataFrame:
    """T-5: continue each chain from its head and seal it every ``every`` events.

    Returns log lines ``(chain_id, place, line)``. A chain ends after ``most`` events with a seal, and
    the key goes on with a new one. With ``idle_ms`` a chain without events for so long is sealed where
    it stands (a stream that waits for timers does not end by itself, so this is not for the
    available-now trigger); what is open when the stream stops is sealed by ``seal_open_chains``. Events
    are taken as they arrive, in ``order`` within an Arrow batch. A chain is sequential, so a hot
    key is spread over ``lanes`` parallel chains, as several writers would each keep their own.
    """
    ship_package()
    keep_state(events.sparkSession)
    number = F.pmod(F.xxhash64(*order), F.lit(lanes)).cast("string")
    name = F.concat_ws("|", F.lit(log_id), *[F.col(k).cast("string") for k in chain_key], number)
    # the chain and the sequence are known only inside the stateful step: the body is cut around them
    keyed = events.withColumn("_lane", F.left(F.sha2(name, 256), F.lit(32))).withColumn("chain_id", F.lit(""))
    fields = {**_event_struct(keyed, alg), "prev_hash": F.lit("")}
    start = _genesis(fields)
    names = [*_BEFORE, "prev_hash", *_AFTER]

    def before(values: dict[str, Column]) -> Column:
        text = object_json({n: values[n] for n in names if n < "sequence"})
        return F.substr(text, F.lit(1), F.char_length(text) - 1)

    def after(values: dict[str, Column]) -> Column:
        return F.substr(object_json({n: values[n] for n in names if n > "sequence"}), F.lit(2))

    slim = keyed.select(
        F.col("_lane").alias("lane"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        before(fields).alias("before"),
        after(fields).alias("after"),
        before(start).alias("genesis_before"),
        after(start).alias("genesis_after"),
        fields["timestamp"].alias("timestamp"),
    )
    made = slim.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=_ChainAppender(every, most, idle_ms, alg, [f"o{i}" for i in range(len(order))]),
        outputStructType=_APPEND_OUT,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
    record = F.replace(
        F.col("body"),
        F.lit(',"hash_alg":'),
        F.concat(F.lit(',"event_hash":"'), F.col("event_hash"), F.lit('","hash_alg":')),
    )
    line = F.when(F.col("checkpoint"), _checkpoint(pads)).otherwise(record)
    return made.select("chain_id", "place", line.alias("line"))


def _checkpoint(pads: Column) -> Column:
    fields = {
        "chain_id": F.col("chain_id"),
        "created_at": F.col("timestamp"),
        "head_hash": F.col("event_hash"),
        "last_sequence": F.col("sequence"),
    }
    seal = checkpoint_seal(fields, pads)
    return object_json({**fields, "seal": seal, "version": F.lit(CHECKPOINT_VERSION)})


def seal_open_chains(spark: SparkSession, state: str, pads: Column) -> DataFrame:
    """Checkpoint lines ``(chain_id, place, line)`` for every chain that a stopped stream left open.

    ``state`` is the checkpoint folder of the stream. The lines depend on the state alone, so sealing
    twice gives the same lines, and a stream that goes on later continues behind them.
    """
    heads = spark.read.format("statestore").option("stateVarName", "head").load(state)
    last = F.col("value.next_sequence") - 1
    number = F.concat_ws("|", F.col("key.lane"), F.col("value.generation").cast("string"))
    ends = heads.where("value.since > 0").select(
        F.left(F.sha2(number, 256), F.lit(32)).alias("chain_id"),
        (2 * last + 1).alias("place"),
        last.alias("sequence"),
        F.col("value.head_hash").alias("event_hash"),
        F.col("value.stamp").alias("timestamp"),
    )
    return ends.select("chain_id", "place", _checkpoint(pads).alias("line"))
