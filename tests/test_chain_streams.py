"""T-4 and T-5 over several micro-batches: late, missing, repeated and damaged records; seals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakframe.catalog.fixtures import kid_of, wide
from cloakframe.catalog.streams import run_batches, run_to_files, stream_frame
from cloakframe.operators import audit as A
from cloakframe.plans.runtime import new_scratch
from cloakframe.sources import audit_log as L
from cloakframe.streaming import streams as S


@pytest.fixture(scope="module")
def chain(spark):
    events = spark.range(12).selectExpr("id", "'login' as event", "'u' as actor", "cast(id as string) as timestamp")
    records = A.build_chain(events, ["actor"], ["id"], "t").select(*L.RECORD_FIELDS)
    return sorted(records.collect(), key=lambda r: r.sequence)


def verified(spark, *deliveries):
    """The last row of each chain after these micro-batches."""
    path, out = new_scratch(spark, "in"), new_scratch(spark, "out")
    schema = L.RECORD
    for rows in deliveries:
        spark.createDataFrame([tuple(r[n] for n in L.RECORD_FIELDS) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def keep(batch, number):
        batch.withColumn("number", F.lit(number)).write.mode("append").parquet(out)

    run_batches(spark, S.verify_chain_stream(stream).writeStream.outputMode("update").foreachBatch(keep))
    return max(spark.read.parquet(out).collect(), key=lambda r: r.number)


def test_records_may_come_in_any_order(spark, chain):
    got = verified(spark, chain[7:], chain[3:5], chain[:3] + chain[5:7])
    assert (got.records, got.last_sequence, got.pending, got.valid, got.reason) == (13, 12, 0, True, None)


def test_a_gap_stays_open_and_damage_is_final(spark, chain):
    got = verified(spark, chain[:4], chain[5:])
    assert (got.records, got.pending, got.valid, got.reason) == (4, 8, False, None)
    got = verified(spark, chain[:4], chain[2:6])
    assert (got.valid, got.reason) == (False, "sequence is not consecutive")
    changed = L.RECORD_FIELDS.index("actor")
    bad = [*chain[:5], chain[5].__class__(*["x" if i == changed else v for i, v in enumerate(chain[5])]), *chain[6:]]
    bad[5] = type(chain[5])(**{**chain[5].asDict(), "actor": "x"})
    got = verified(spark, bad[6:], bad[:6])
    assert (got.records, got.valid, got.reason) == (5, False, "event hash does not match record content")


def test_early_records_share_entries_of_the_state(spark):
    """300 records without the first are 5 or 6 entries, whichever way they come."""
    events = spark.range(300).selectExpr("id", "'login' as event", "'u' as actor", "cast(id as string) as timestamp")
    records = A.build_chain(events, ["actor"], ["id"], "t").select(*L.RECORD_FIELDS).where("sequence > 0")
    path, state, out = (new_scratch(spark, n) for n in ("in", "state", "out"))
    records.coalesce(1).write.parquet(path)
    stream = S.verify_chain_stream(spark.readStream.schema(L.RECORD).parquet(path))

    def keep(batch, number):
        batch.write.mode("append").parquet(out)

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state)
    query.trigger(availableNow=True).start().awaitTermination()
    (got,) = spark.read.parquet(out).collect()
    assert (got.records, got.pending, got.valid) == (0, 300, False)
    assert spark.read.format("statestore").option("stateVarName", "early").load(state).count() <= 6


def test_long_chains_in_any_order(spark):
    """Many early ranges over several deliveries."""
    events = spark.range(1500).selectExpr("id", "'login' as event", "'u' as actor", "cast(id as string) as timestamp")
    rows = A.build_chain(events, ["actor"], ["id"], "t").select(*L.RECORD_FIELDS).collect()
    got = verified(spark, *[[r for r in rows if (r.sequence * 7919 + 1) % 3 == k] for k in range(3)])
    assert (got.records, got.last_sequence, got.pending, got.valid) == (1501, 1500, 0, True)


def test_wide_tables_and_streams_use_all_cores(spark, tmp_path):
    """One row group is dealt to all cores, and so is every micro-batch."""
    spark.range(4000).selectExpr("id as k").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    rows = wide(spark, str(tmp_path), "t", "k")
    cores = spark.sparkContext.defaultParallelism
    assert len(rows.groupBy(F.spark_partition_id()).count().collect()) == cores
    sizes = []
    stream = stream_frame(spark, rows, parts=3).withColumn("file", F.input_file_name())

    def keep(batch, _):
        sizes.append(tuple(batch.agg(F.count("*"), F.count_distinct("file")).first()))

    run_batches(spark, stream.writeStream.foreachBatch(keep))
    assert sum(n for n, _ in sizes) == 4000 and [f for _, f in sizes] == [cores] * 3


def test_a_stopped_stream_goes_on_behind_its_seals(spark, policy):
    """Chains of at most 5 events, sealed every 2; the stream stops twice."""
    pads = policy.seal_column(kid_of("main"), "audit")
    path, state, out = (new_scratch(spark, n) for n in ("in", "state", "out"))
    seals = None
    for lo, hi in ((0, 3), (3, 9), (9, 12)):
        rows = spark.range(lo, hi).selectExpr("id", "'login' as event", "'u' as actor", "cast(id as string) as timestamp")
        rows.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        lines = S.append_chain_stream(stream, ["actor"], ["id"], pads, every=2, most=5)
        made = run_to_files(spark, lines, state, out)
        end = S.seal_open_chains(spark, state, pads).checkpoint()
        seals = end if seals is None else seals.union(end)
    again = S.seal_open_chains(spark, state, pads)
    log = made.union(seals).union(again).dropDuplicates(["chain_id", "place"])
    linked = A.link_lines(L.parse_lines(A.as_log(log, 4)), pads)
    assert {(r.valid, r.lines) for r in A.verify_chain(linked).collect()} == {(True, 10), (True, 9), (True, 4)}
    assert sorted(r.records for r in A.chain_summary(linked).collect()) == [3, 6, 6]
