"""Redeemed values leave no trace, refs are unique on streams, run keys survive, summaries stop."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cloakframe.catalog.fixtures import key_ring, kid_of, policy_document
from cloakframe.catalog.streams import run_batches, stream_frame
from cloakframe.operators import audit as A
from cloakframe.operators import commitments
from cloakframe.operators import tokens as tok
from cloakframe.plans.jobs import DUPLICATE_REF, JobError
from cloakframe.plans.keys import RunKey
from cloakframe.plans.policy import Policy
from cloakframe.plans.protect import Step, protect_and_store
from cloakframe.sources import audit_log as L
from cloakframe.sources import tables as T
from cloakframe.streaming import streams as S


def values_below(folder: str) -> set[str]:
    """Every text in every Parquet file of a folder."""
    found = set()
    for path in Path(folder).rglob("*.parquet"):
        for column in pq.read_table(str(path), partitioning=None).columns:
            found |= {v for v in column.to_pylist() if isinstance(v, str)}
    return found


def test_redeemed_values_are_never_on_disk_in_clear(spark, policy, scratch):
    accounts = spark.createDataFrame([("a", "1234567890"), ("b", "2345678901")], "ref string, v string")
    done, rows = tok.tokenize(accounts, "v", "once", policy, "ref")
    vault = T.create_vault(spark, scratch("vault"))
    T.append_vault(rows, vault)
    bad = spark.createDataFrame([("x", "nonsense"), ("y", None), ("z", "nonsense")], "ref string, token string")
    shown = stream_frame(spark, done.select("ref", "token").union(done.select("ref", "token")).union(bad), parts=2)
    won, lost, seen, calls = [], [], set(), []

    def sink(winners, batch_id):
        seen.update(values_below(vault.path))  # what lies there while the sink works
        won.extend(r.plaintext for r in winners.collect())

    def rejects(refused, batch_id):
        lost.extend(r.error.message for r in refused.collect())

    writer = S.redeem_stream(shown, "token", "once", policy, vault, sink, rejects)
    run_batches(spark, writer)
    assert sorted(v for v in won if v) == ["1234567890", "2345678901"]
    assert len(lost) + len(won) == 7
    assert not {"1234567890", "2345678901"} & (seen | values_below(vault.path))
    assert not list(Path(vault.path, "_redeemed", "redeem").glob("batch=*"))
    # a batch that is recorded and was handed over is not handed over again
    again = S.redeem_stream(shown, "token", "once", policy, vault, lambda rows, n: calls.append(n), rejects)
    run_batches(spark, again)
    assert calls == []


def test_refs_are_unique_in_every_micro_batch(spark, policy):
    rows = spark.createDataFrame([(r, "1234567890") for r in "abbc"], "ref string, v string").coalesce(1)
    steps = [Step("commit", "v", "account", "c", ref="ref")]
    with pytest.raises(JobError, match="micro-batches"):
        S.protect_stream(stream_frame(spark, rows, 1), steps, policy)
    good, bad = [], []
    run_batches(spark, S.protect_batches(
        stream_frame(spark, rows, 1), steps, policy,
        lambda f, n: good.extend(f.collect()), lambda f, n: bad.extend(f.collect()), drop=["v"],
    ))
    assert sorted(r.ref for r in good) == ["a", "c"] and "v" not in good[0]
    assert [(r.ref, r.error.message) for r in bad] == [("b", DUPLICATE_REF)] * 2
    with pytest.raises(Exception, match=DUPLICATE_REF):
        run_batches(spark, S.protect_batches(stream_frame(spark, rows, 1), steps, policy, lambda f, n: None))


def test_a_kept_run_key_repeats_after_a_restart(spark, scratch):
    rows = spark.createDataFrame([("a", "1234567890")], "ref string, v string")
    key = list(key_ring().keys.values())[0]

    def opening(folder):
        run = RunKey.kept(spark, folder, key)
        policy = Policy.parse(spark, json.dumps(policy_document()), key_ring(), run_key=run)
        return commitments.commit(rows, "v", "account", policy, "ref", on_error="null").select("opening").first()[0]

    first = opening(scratch("state"))
    assert opening(scratch("state")) == first != opening(scratch("other"))
    said = Path(scratch("state"), "run-key.json").read_text()
    assert key.secret.hex() not in said and set(json.loads(said)) == {"kid", "salt"}
    other = list(key_ring().keys.values())[1]
    with pytest.raises(ValueError, match="another key"):
        RunKey.kept(spark, scratch("state"), other)


def test_a_summary_stops_at_the_first_bad_line(spark):
    events = spark.range(30).selectExpr("id", "'e' as event", "'u' as actor", "cast(id as string) as timestamp")
    lines = A.build_chain(events, ["actor"], ["id"], "t", segment=10).select("chain_id", "place", "line").collect()
    chains = sorted({r.chain_id for r in lines})
    text = [r.line for c in chains for r in sorted((r for r in lines if r.chain_id == c), key=lambda r: r.place)]
    text[15] = text[15].replace('"actor":"u"', '"actor":"x"')  # in the second of three chains
    log = spark.createDataFrame([("log", "0", i, t) for i, t in enumerate(text)], "log string, _blk string, _at long, line string")
    linked = A.link_lines(L.parse_lines(log))
    assert A.verify_chain(linked).first().bad_line == 16
    assert {r.chain_id: r.records for r in A.chain_summary(linked).collect()} == {chains[0]: 11, chains[1]: 4}


def test_seven_jobs_from_one_stage_without_plaintext(spark, policy):
    rows = spark.createDataFrame([("a", "1234567890"), ("b", "2345678901"), ("c", "12"), ("d", None)], "ref string, v string")
    steps = [
        Step("mask", "v", "account", "shown"), Step("tokenize", "v", "account", "token", ref="ref"),
        Step("encrypt", "v", kid_of("main"), "sealed", ref="ref"), Step("split", "v", "secret", "set_id", ref="ref"),
    ]
    made = protect_and_store(rows, steps, policy, drop=["v"])
    assert sorted(r.ref for r in made.rows.collect()) == ["a", "b", "d"]
    assert [(r.ref, "v" in r) for r in made.rejects.collect()] == [("c", False)]
    assert made.vault.count() == 2 and made.shares["set_id"].count() == 10
    assert not {"1234567890", "2345678901", "12"} & values_below(made.path)
    assert sum("FileScan" in line for line in made.rows._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
    made.erase()
    assert not Path(made.path).exists()
    with pytest.raises(JobError, match="duplicated ref"):
        protect_and_store(rows.withColumn("ref", F.lit("same")), steps, policy, drop=["v"])
