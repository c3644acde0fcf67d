"""Registered queries for the streaming jobs (T-1 .. T-6): each runs a file stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.catalog.common import Entry, account, account_sql, message, tag_sql
from cloakframe.catalog.fixtures import demo_policy, kid_of, table
from cloakframe.operators import audit as A
from cloakframe.operators import tokens as tok
from cloakframe.plans.protect import Step
from cloakframe.plans.runtime import new_scratch
from cloakframe.sources import audit_log as L
from cloakframe.sources import tables as T
from cloakframe.streaming import streams as S

MAIN = kid_of("main")


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of three micro-batches."""
    return stream_frame(spark, table(spark, sf, name))


def stream_frame(spark: SparkSession, df: DataFrame, parts: int = 3) -> DataFrame:
    """A frame as a stream of ``parts`` micro-batches, each of as many files as the session has cores."""
    path = new_scratch(spark, "stream")
    df.repartition(parts * spark.sparkContext.defaultParallelism).write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())  # few rows make fewer files
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // parts)))
    return reader.parquet(path)


def run_to_files(spark: SparkSession, stream: DataFrame, state: str | None = None, out: str | None = None) -> DataFrame:
    """Run an append stream over what is there now and read its output."""
    out, state = out or new_scratch(spark, "out"), state or new_scratch(spark, "state")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(spark: SparkSession, writer) -> None:
    """Run a ``foreachBatch`` writer over what is there now."""
    state = new_scratch(spark, "state")
    query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def _protect(spark, sf):
    """T-1: mask, digest and encrypt order accounts on arrival."""
    o = stream_of(spark, sf, "orders").select("o_orderkey", account("o_custkey").alias("acct"))
    steps = [
        Step("mask", "acct", "account", "display"),
        Step("digest", "acct", "account", "search"),
        Step("fpe", "acct", "account", "stored"),
    ]
    out = S.protect_stream(o, steps, demo_policy(spark), drop=["acct"])
    done = message(run_to_files(spark, out))
    return done.select("o_orderkey", "display", "search", F.length("stored").alias("n"), "message")


_PROTECT_SQL = f"""
select o_orderkey, '********' || right({account_sql("o_custkey")}, 4) as display,
  {tag_sql("account", account_sql("o_custkey"))} as search, 12 as n,
  cast(null as varchar) as message from orders
"""


def _index(spark, sf):
    """T-2: the blind index fed twice by the same stream."""
    pol = demo_policy(spark)
    index = T.create_index(spark, new_scratch(spark, "index"))
    for _ in range(2):
        o = stream_of(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"))
        run_batches(spark, S.index_stream(o, "k", "customer", pol, index))
    return index.read().select("kid", "digest")


_INDEX_SQL = f"""
select distinct '{MAIN}' as kid, {tag_sql("customer", "cast(o_custkey as varchar)")} as digest
from orders
"""


def _redeem(spark, sf):
    """T-3: every one-time token is presented three times; each is redeemed once."""
    pol = demo_policy(spark)
    c = table(spark, sf, "customer").select("c_custkey", account("c_custkey").alias("acct"))
    done, rows = tok.tokenize(c, "acct", "once", pol, "c_custkey", created_at="1")
    vault = T.create_vault(spark, new_scratch(spark, "vault"))
    T.append_vault(rows, vault)
    shown = done.select("c_custkey", "token", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    out = new_scratch(spark, "winners")

    def sink(winners, batch_id):
        winners.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = stream_frame(spark, shown)
    run_batches(spark, S.redeem_stream(stream, "token", "once", pol, vault, sink))
    won = spark.read.parquet(out).groupBy("c_custkey", "plaintext").agg(F.count("*").alias("wins"))
    left = vault.read().agg(F.count("*")).scalar()
    return won.select("*", left.alias("left_over"))


_REDEEM_SQL = f"""
select c_custkey, {account_sql("c_custkey")} as plaintext, 1 as wins, 0 as left_over from customer
"""


def _events(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        F.col("event_type").alias("event"),
        F.col("user_id").cast("string").alias("actor"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
    )


def _verify(spark, sf):
    """T-4: chains of all users, delivered in four shuffled micro-batches; the last state of each."""
    records = A.build_chain(
        _events(table(spark, sf, "events")), ["actor"], ["event_id"], "stream", segment=40
    )
    stream = stream_frame(spark, records.select(*L.RECORD_FIELDS), parts=4)
    out = new_scratch(spark, "verified")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(spark, S.verify_chain_stream(stream).writeStream.outputMode("update").foreachBatch(keep))
    newest = F.max_by(F.struct("records", "valid", "last_sequence"), "batch")
    final = spark.read.parquet(out).groupBy("chain_id").agg(newest.alias("s"))
    return final.select("s.*").groupBy("records", "valid", "last_sequence").agg(
        F.count("*").alias("chains")
    )


_VERIFY_SQL = """
with u as (select user_id, count(*) as n from events group by 1),
  g as (select n, unnest(range((n + 39) // 40)) as i from u),
  c as (select least(40, n - 40 * i) as m from g)
select m + 1 as records, true as valid, m as last_sequence, count(*) as chains from c group by m
"""


def _append(spark, sf):
    """T-5: chains continued from their heads over four micro-batches, at most 25 events each, sealed
    every ten events, at their ends and where the stream stops; the result verifies as a log."""
    pol = demo_policy(spark)
    seal = pol.seal_column(MAIN, "audit")
    events = stream_frame(spark, _events(table(spark, sf, "events")), parts=4)
    lines = S.append_chain_stream(
        events, ["actor"], ["event_id"], seal, every=10, most=25
    )
    state = new_scratch(spark, "state")
    done = run_to_files(spark, lines, state).union(S.seal_open_chains(spark, state, seal))
    linked = A.link_lines(L.parse_lines(A.as_log(done, 64)), seal)
    summary = A.chain_summary(linked).select(
        F.col("log"), "records", "checkpoints_verified"
    )
    verdict = A.verify_chain(linked).select("log", "lines", "valid")
    return summary.join(verdict, "log").groupBy(
        "records", "checkpoints_verified", "lines", "valid"
    ).agg(F.count("*").alias("chains"))


_APPEND_SQL = """
with u as (select user_id, count(*) as n from events group by 1),
  c as (select unnest(list_concat(list_transform(range(n // 25), lambda i: 25),
    case when n % 25 > 0 then [n % 25] else [] end)) as m from u),
  s as (select m, m // 10 + cast(m % 10 > 0 as bigint) as seals from c)
select m + 1 as records, seals as checkpoints_verified, m + 1 + seals as lines, true as valid,
  count(*) as chains from s group by m, seals
"""


def _counters(spark, sf):
    """T-6: running counters by event type and outcome."""
    e = stream_of(spark, sf, "events").select(
        "event_type", F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome")
    )
    out = new_scratch(spark, "counters")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    counted = S.counters_stream(e, ["event_type", "outcome"])
    run_batches(spark, counted.writeStream.outputMode("complete").foreachBatch(keep))
    return spark.read.parquet(out)


_COUNTERS_SQL = """
select event_type, case when event_type = 'error' then 'failure' else 'success' end as outcome,
  count(*) as total from events group by all
"""


ENTRIES = {
    "protect_stream": Entry("T-1", _protect, _PROTECT_SQL),
    "index_stream": Entry("T-2", _index, _INDEX_SQL),
    "redeem_stream": Entry("T-3", _redeem, _REDEEM_SQL),
    "verify_chain_stream": Entry("T-4", _verify, _VERIFY_SQL),
    "append_chain_stream": Entry("T-5", _append, _APPEND_SQL),
    "counters_stream": Entry("T-6", _counters, _COUNTERS_SQL),
}
