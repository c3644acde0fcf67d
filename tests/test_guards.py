"""What must not happen: one-time tokens read twice, nonces shared, half-written snapshots, rows lost."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakframe.catalog.fixtures import kid_of
from cloakframe.operators import commitments, encryption, sharing, tags
from cloakframe.operators import tokens as tok
from cloakframe.plans.jobs import JobError
from cloakframe.plans.protect import Step, protect_frame
from cloakframe.sources import tables as T


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame([("a", "1234567890"), ("b", "2345678901")], "ref string, v string")


def vault_of(spark, scratch, rows):
    vault = T.create_vault(spark, scratch("vault"))
    T.append_vault(rows, vault)
    return vault


def test_one_time_tokens_are_only_redeemed(spark, policy, accounts, scratch):
    done, rows = tok.tokenize(accounts, "v", "once", policy, "ref")
    vault = vault_of(spark, scratch, rows)
    shown = done.select("ref", "token")
    with pytest.raises(JobError, match="one-time"):
        tok.detokenize(shown, "token", "once", policy, vault)
    assert all(r.stored for r in tok.stored_tokens(shown, "token", "once", policy, vault).collect())


@pytest.mark.parametrize("job", [
    lambda df, p: tok.tokenize(df, "v", "account", p, "ref"),
    lambda df, p: encryption.encrypt_column(df, "v", kid_of("main"), p, "ref"),
    lambda df, p: commitments.commit(df, "v", "account", p, "ref"),
    lambda df, p: sharing.split_secret(df, "v", "secret", p, "ref"),
    lambda df, p: protect_frame(df, [Step("commit", "v", "account", "c", ref="ref")], p),
])
def test_a_ref_used_twice_refuses_the_frame(accounts, policy, job):
    with pytest.raises(JobError, match="duplicated ref"):
        job(accounts.withColumn("ref", F.lit("same")), policy)


def test_nonces_depend_on_all_that_is_sealed(spark, policy, accounts):
    seen = []
    for column, ts in (("v", "1"), ("v", "2"), ("w", "1")):
        df = accounts.withColumn("w", F.col("v"))
        sealed = encryption.encrypt_column(df, column, kid_of("main"), policy, "ref", timestamp=ts, on_error="null")
        seen += [r.nonce for r in sealed.select("sealed.nonce").collect()]
    for m, at in (('{"a":1}', "1"), ('{"a":2}', "1"), ('{"a":1}', "2")):
        df = accounts.withColumn("m", F.lit(m))
        _, rows = tok.tokenize(df, "v", "account", policy, "ref", metadata="m", created_at=at)
        seen += [r.n for r in rows.select(F.split("data", "\\.")[1].alias("n")).collect()]
    assert len(set(seen)) == len(seen) == 12


def test_a_crash_before_the_rename_leaves_the_old_snapshot(spark, scratch):
    index = T.create_index(spark, scratch("index"))
    rows = spark.createDataFrame([(kid_of("main"), "ab" * 32)], "kid string, digest string")
    T.upsert_index(rows, index)
    half = index._fs.create(index._path_of(f"{index.path}/_versions/_half.tmp"), False)
    half.write(bytearray(b'{"segm'))
    half.close()
    assert index.version() == 1 and index.read().count() == 1
    with pytest.raises(T.ConcurrentWrite):
        index._commit(index.state(), 1)
    assert index.read().count() == 1


def test_probes_read_only_their_shards(spark, scratch):
    rows = spark.range(200).select(F.lit(kid_of("main")).alias("kid"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    index = T.create_index(spark, scratch("index"))
    T.upsert_index(rows, index)
    probe = rows.filter("digest like 'a%'")
    found = index.matching(probe)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == probe.count() > 0
    assert "shard" in plan.split("PartitionFilters")[1].split("]")[0]
    assert index.shards_of(probe.withColumn("shard", F.left("digest", F.lit(1)))) == ["a"]


def test_vacuum_removes_consumed_rows_from_disk(spark, scratch):
    rows = spark.range(20).select(F.lit(kid_of("main")).alias("kid"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    index = T.create_index(spark, scratch("index"))
    version = T.upsert_index(rows, index)
    index.delete(rows.limit(5), version)
    left = {r.digest for r in index.read().collect()}
    index.compact()
    assert index.vacuum() == 2
    assert {r.digest for r in index.read().collect()} == left and len(left) == 15
    assert spark.read.parquet(f"{index.path}/data").count() == 15


def test_null_and_blank_keys_stay_apart(spark, policy):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, " ")], "id int, v string")
    kept, apart = tags.dedupe_by_digest(df, "v", "account", policy, ["id"])
    assert [r.id for r in kept.collect()] == [1]
    assert {r.id: r.error and r.error.message for r in apart.collect()} == {3: None, 4: "plaintext must not be empty"}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    none, refused = tags.dedupe_by_digest(df, "v", "retired", policy, ["id"])
    assert none.count() == 0 and refused.count() == 4


def test_openings_of_failed_rows_are_null(spark, policy):
    df = spark.createDataFrame([("a", "1234567890"), ("b", " ")], "ref string, v string")
    out = protect_frame(df, [Step("commit", "v", "account", "c", ref="ref")], policy, on_error="null")
    rows = {r.ref: r for r in out.collect()}
    assert rows["a"].c_opening and rows["a"].c and rows["b"].c is None and rows["b"].c_opening is None


def test_split_secret_can_refuse_the_frame(spark, policy):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "")], "pos int, ref string, v string")
    with pytest.raises(JobError, match="batch item 2 failed"):
        sharing.split_secret(df, "v", "secret", policy, "ref", "fail", "pos")
    with pytest.raises(ValueError, match="unknown on_error"):
        sharing.split_secret(df, "v", "secret", policy, "ref", "other")
