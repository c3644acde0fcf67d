"""Audit chains: tampering, file splits, several logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakframe.catalog.fixtures import kid_of
from cloakframe.operators import audit as A
from cloakframe.sources import audit_log as L


@pytest.fixture(scope="module")
def records(spark):
    events = spark.range(60).select(
        F.col("id").alias("at"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("actor"),
        F.lit("sign.success").alias("event"),
        F.concat(F.lit('he said "x",\u0007 '), F.col("id")).alias("reason"),
        (F.col("id") + 100).cast("string").alias("timestamp"),
    )
    return A.build_chain(events, ["actor"], ["at"], "t", segment=25)


@pytest.fixture(scope="module")
def seal(policy):
    return policy.seal_column(kid_of("main"), "audit")


def texts(records, seal, every=10):
    lines = A.log_lines(records, A.make_checkpoints(records, seal, every))
    return [r["line"] for r in lines.orderBy("chain_id", "place").collect()]


def check(spark, folder, lines, seal=None, tail="\n", unit="file"):
    for name, content in lines.items():
        (folder / name).write_text("\n".join(content) + tail)
    linked = A.link_lines(L.parse_lines(L.scan_lines(spark, str(folder), unit)), seal)
    found = A.verify_chain(linked).collect()
    return {r["log"].rsplit("/", 1)[1]: (r["valid"], r["bad_line"], r["reason"]) for r in found}, linked


def test_segments_are_bounded(records):
    sizes = {r["chain_id"]: r["count"] for r in records.groupBy("chain_id").count().collect()}
    assert sorted(sizes.values()) == [16, 21, 26]
    clean = records.filter("sequence > 0").select("reason").distinct().collect()
    assert all("\u0007" not in r["reason"] for r in clean)


@pytest.mark.parametrize("alg", ["SHA-256", "BLAKE2b(256)"])
def test_good_log(spark, records, seal, tmp_path, alg):
    if alg != "SHA-256":
        events = records.filter("sequence > 0").select("actor", "event", "timestamp", "sequence", "chain_id")
        records = A.build_chain(events.withColumnRenamed("chain_id", "c"), ["c"], ["sequence"], "b", alg=alg)
    content = texts(records, seal)
    (tmp_path / "a.log").write_text("\n".join(content) + "\n")
    linked = A.link_lines(L.parse_lines(L.scan_lines(spark, str(tmp_path)), alg), seal)
    verdict = A.verify_chain(linked).first()
    assert verdict["valid"] and verdict["lines"] == len(content)
    assert A.chain_summary(linked).count() == 3
    assert A.verify_checkpoints(linked).filter("valid").count() == sum("seal" in c for c in content)


def test_each_kind_of_damage(spark, records, seal, tmp_path):
    good = texts(records, seal)
    first = next(i for i, c in enumerate(good) if '"seal"' in c)
    swapped = [*good[:2], good[3], good[2], *good[4:]]
    files = {
        "altered": [good[0], good[1].replace("sign.success", "sign.failure"), *good[2:]],
        "missing": [*good[:2], *good[3:]],
        "swapped": swapped,
        "spaced": [good[0], good[1].replace('{"action"', '{ "action"'), *good[2:]],
        "unknown": [good[0], good[1].replace("cf-audit-v1", "cf-audit-v9"), *good[2:]],
        "extra": [good[0], good[1].replace('{"action"', '{"a":1,"action"'), *good[2:]],
        "blank": [good[0], "", *good[1:]],
        "large": [good[0], '{"version":"' + "x" * 17_000 + '"}', *good[1:]],
        "headless": good[1:],
        "early": [good[first], *good],
        "moved": [*good[: first - 1], good[first], good[first - 1], *good[first + 1 :]],
        "forged": [*good[:first], good[first].replace('"seal":"', '"seal":"0')[:-1] + "}", *good[first + 1 :]],
        "good": good,
    }
    got, _ = check(spark, tmp_path, files, seal)
    assert got["good"] == (True, None, None)
    assert got["altered"][1:] == (2, "event hash does not match record content")
    assert got["missing"][1:] == (3, "sequence is not consecutive")
    assert got["swapped"][1:] == (3, "sequence is not consecutive")
    assert got["spaced"][1:] == (2, "record JSON is not canonical")
    assert got["unknown"][1:] == (2, "record version is unsupported")
    assert got["extra"][1:] == (2, "record JSON is not canonical")
    assert got["blank"][1:] == (2, "record is empty")
    assert got["large"][1:] == (2, "record exceeds maximum size")
    assert got["headless"][1:] == (1, "first record must start a chain")
    assert got["early"][1:] == (1, "checkpoint appears before chain genesis")
    assert got["moved"][1:] == (first, "checkpoint sequence does not match active chain")
    assert got["forged"][1:] == (first + 1, "audit checkpoint signature verification failed")


def test_order_survives_many_splits(spark, records, seal, tmp_path):
    """Files cut into splits of a few lines; chains continue from split to split."""
    good = texts(records, seal)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        gap = next(
            i
            for i in range(30, len(good))
            if not any('"seal"' in c or L.GENESIS_EVENT in c for c in good[i : i + 2])
        )
        bad = [*good[:gap], *good[gap + 1 :]]
        got, linked = check(spark, tmp_path, {"a.log": good, "b.log": bad, "c.log": good}, seal)
        parts = L.scan_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        numbers = linked.groupBy("log").agg(F.countDistinct("line_no"), F.max("line_no")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert parts > 20
    assert got["a.log"] == got["c.log"] == (True, None, None)
    assert got["b.log"] == (False, gap + 1, "sequence is not consecutive")
    assert all(r[1] == r[2] for r in numbers)


def test_folder_is_one_log(spark, records, seal, tmp_path):
    lines = A.log_lines(records, A.make_checkpoints(records, seal, 10))
    path = str(tmp_path / "log")
    L.write_audit_log(lines, path)
    linked = A.link_lines(L.parse_lines(L.scan_lines(spark, path, "directory")), seal)
    verdict = A.verify_chain(linked).collect()
    assert len(verdict) == 1 and verdict[0]["valid"] and verdict[0]["lines"] == lines.count()


def test_a_summary_keeps_no_log_in_one_task(spark, records, seal, tmp_path):
    """A folder of many chains is one log: its chains are summed up by several tasks."""
    lines = A.log_lines(records, A.make_checkpoints(records, seal, 10))
    L.write_audit_log(lines, str(tmp_path / "log"))
    linked = A.link_lines(L.parse_lines(L.scan_lines(spark, str(tmp_path / "log"), "directory")), seal)
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        chains = A.chain_summary(linked).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    assert sum(r.records for r in chains) == records.count()
    assert len({r.task for r in chains}) > 1


def test_a_summary_ends_at_the_first_bad_line_in_any_block(spark, records, seal, tmp_path):
    lines = [*texts(records, seal)]
    at = len(lines) // 2
    (tmp_path / "a.log").write_text("".join(f"{x}\n" for x in [*lines[:at], "{}", *lines[at:]]))
    (tmp_path / "b.log").write_text("".join(f"{x}\n" for x in lines))
    linked = A.link_lines(L.parse_lines(L.scan_lines(spark, str(tmp_path))), seal)
    for per_block in (1, 7, 1000):
        chains = A.chain_summary(linked, per_block).collect()
        for name, n in (("a.log", at), ("b.log", len(lines))):
            mine = [r for r in chains if r.log.endswith(name)]
            assert sum(r.records + r.checkpoints_verified for r in mine) == n


def test_same_events_give_same_chain(spark, records):
    again = spark.range(60).select(
        F.col("id").alias("at"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("actor"),
        F.lit("sign.success").alias("event"),
        F.concat(F.lit('he said "x",\u0007 '), F.col("id")).alias("reason"),
        (F.col("id") + 100).cast("string").alias("timestamp"),
    )
    built = A.build_chain(again.repartition(5), ["actor"], ["at"], "t", segment=25)
    assert {r["line"] for r in built.collect()} == {r["line"] for r in records.collect()}


def test_a_last_line_without_line_feed_is_bad(spark, tmp_path):
    events = spark.range(8).selectExpr("id", "'e' as event", "'ü' as actor", "cast(id as string) as timestamp")
    built = A.build_chain(events, ["actor"], ["id"], "t", segment=20)
    lines = [r.line for r in sorted(built.select("place", "line").collect(), key=lambda r: r.place)]
    (tmp_path / "whole.log").write_bytes("".join(f"{x}\n" for x in lines).encode())
    (tmp_path / "cut.log").write_bytes("\n".join(lines).encode())
    (tmp_path / "empty.log").write_bytes(b"")
    records, _, bad = L.read_audit_log(spark, str(tmp_path))
    assert records.count() == 2 * len(lines) - 1
    (found,) = bad.collect()
    assert found.line == lines[-1] and found.log.endswith("cut.log")
    assert found.reason == "record is truncated (missing trailing newline)"
