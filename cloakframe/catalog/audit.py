"""Registered queries for audit logs (SRC-1, SNK-3, W-1, W-2, W-5, A-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.catalog.common import Entry
from cloakframe.catalog.fixtures import demo_policy, kid_of, wide
from cloakframe.operators import audit as A
from cloakframe.plans.runtime import cut_lineage, new_scratch
from cloakframe.sources import audit_log as L

SEGMENT = 25


def _events(spark, sf):
    e = wide(spark, sf, "events", "event_id", "event_type", "user_id", "props", "ts")
    return e.select(
        "event_id",
        F.col("event_type").alias("event"),
        F.col("user_id").cast("string").alias("actor"),
        F.col("props").alias("reason"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
    )


def _chains(spark, sf):
    # stored by the caller, because the queries read the records several times
    return cut_lineage(
        A.build_chain(_events(spark, sf), ["actor"], ["event_id"], "demo", segment=SEGMENT)
    )


def _log(spark, sf):
    """Records and sealed checkpoints, written as files and scanned back."""
    records = _chains(spark, sf)
    seal = demo_policy(spark).seal_column(kid_of("main"), "audit")
    lines = A.log_lines(records, A.make_checkpoints(records, seal, every=10))
    path = new_scratch(spark, "audit")
    L.write_audit_log(lines, path)
    return path, seal


def build_and_verify(spark, sf):
    """W-5, W-1: chains of all users, verified without files, one row per user."""
    records = _chains(spark, sf)
    parsed = L.parse_lines(A.as_log(records.select("chain_id", "place", "line"), 16))
    verified = A.verify_chain(A.link_lines(parsed))
    owner = records.filter("sequence = 1").select("actor", F.col("chain_id").alias("log"))
    return verified.join(owner, "log").groupBy("actor").agg(
        F.count("*").alias("chains"),
        F.sum("lines").alias("lines"),
        F.count_if("valid").alias("valid"),
    )


_BUILD_SQL = f"""
with u as (select cast(user_id as varchar) as actor, count(*) as n from events group by 1)
select actor, (n + {SEGMENT - 1}) // {SEGMENT} as chains, n + (n + {SEGMENT - 1}) // {SEGMENT} as lines,
  (n + {SEGMENT - 1}) // {SEGMENT} as valid from u
"""


def _read(spark, sf):
    """SRC-1, SNK-3: what comes back from the files, per actor and event."""
    path, _ = _log(spark, sf)
    records, checkpoints, bad = L.read_audit_log(spark, path, "directory")
    kinds = records.groupBy("actor", "event").agg(F.count("*").alias("n"))
    bad_rows = bad.groupBy(F.lit("bad").alias("actor"), F.col("reason").alias("event"))
    return kinds.unionByName(bad_rows.agg(F.count("*").alias("n"))).filter(
        F.col("event") != L.GENESIS_EVENT
    )


_READ_SQL = """
select cast(user_id as varchar) as actor, event_type as event, count(*) as n from events group by all
"""


def _verify_files(spark, sf):
    """W-1, W-2 over a log spread over several files: the whole folder is one valid log."""
    path, seal = _log(spark, sf)
    linked = A.link_lines(L.parse_lines(L.scan_lines(spark, path, "directory")), seal)
    marks = A.verify_checkpoints(linked)
    found = marks.groupBy("log").agg(
        F.count("*").alias("checkpoints"), F.count_if("valid").alias("checkpoints_valid")
    )
    return A.verify_chain(linked).join(found, "log").agg(
        F.count("*").alias("logs"),
        F.sum("lines").alias("lines"),
        F.bool_and("valid").alias("valid"),
        F.sum("checkpoints").alias("checkpoints"),
        F.sum("checkpoints_valid").alias("checkpoints_valid"),
    )


# Checkpoints: one per ten events of a chain and one at its end (when that is not the tenth).
_CHUNKS = f"""
with u as (select user_id, count(*) as n from events group by 1),
  g as (select user_id, n, unnest(range((n + {SEGMENT - 1}) // {SEGMENT})) as i from u),
  c as (select user_id, i, least({SEGMENT}, n - {SEGMENT} * i) as m from g),
  k as (select *, m // 10 + case when m % 10 > 0 then 1 else 0 end as marks from c)
"""
_VERIFY_SQL = _CHUNKS + """
select 1 as logs, sum(m) + count(*) + sum(marks) as lines, true as valid,
  sum(marks) as checkpoints, sum(marks) as checkpoints_valid from k
"""


def _summary(spark, sf):
    """A-3: one row per chain, counted by its shape."""
    path, seal = _log(spark, sf)
    linked = A.link_lines(L.parse_lines(L.scan_lines(spark, path, "directory")), seal)
    s = A.chain_summary(linked)
    sealed_head = F.col("head_hash") == F.col("last_checkpoint_head_hash")
    return s.groupBy("records", "last_sequence", "checkpoints_verified").agg(
        F.count("*").alias("chains"),
        F.count_if(sealed_head).alias("sealed"),
        F.max("last_checkpoint_sequence").alias("last_checkpoint"),
    )


_SUMMARY_SQL = _CHUNKS + """
select m + 1 as records, m as last_sequence, marks as checkpoints_verified, count(*) as chains,
  count(*) as sealed, m as last_checkpoint from k group by m, marks
"""


def _tampered(spark, sf):
    """W-1: each user's first chain is damaged in one of six ways; the first bad line is named."""
    records = _chains(spark, sf)
    u = F.col("actor").cast("long") % 6
    seq = F.col("sequence")
    line = (
        F.when((u == 1) & (seq == 1), F.replace("line", F.lit('"success"'), F.lit('"failure"')))
        .when((u == 2) & (seq == 1), F.replace("line", F.lit('{"action"'), F.lit('{ "action"')))
        .when((u == 3) & (seq == 1), F.lit("{}"))
        .when((u == 4) & (seq == 1), F.lit(""))
        .otherwise(F.col("line"))
    )
    # The genesis row has no actor of its own; it takes the one of the chain.
    owner = records.filter("sequence = 1").select(
        "chain_id", F.col("actor").alias("_owner")
    )
    owned = records.drop("actor").join(owner, "chain_id").withColumnRenamed("_owner", "actor")
    lines = owned.filter(~((u == 5) & (seq == 0))).select(
        "chain_id", "place", line.alias("line"), "actor"
    )
    log = A.as_log(lines, 8)
    verified = A.verify_chain(A.link_lines(L.parse_lines(log)))
    names = owner.select(F.col("chain_id").alias("log"), F.col("_owner").alias("actor"))
    return verified.join(names, "log").groupBy("actor", "valid", "bad_line", "reason").agg(
        F.count("*").alias("chains")
    )


_TAMPERED_SQL = f"""
with u as (select user_id, (count(*) + {SEGMENT - 1}) // {SEGMENT} as chains from events group by 1)
select cast(user_id as varchar) as actor, chains, user_id % 6 = 0 as valid,
  case user_id % 6 when 0 then null when 5 then 1 else 2 end as bad_line,
  case user_id % 6 when 1 then 'event hash does not match record content'
    when 2 then 'record JSON is not canonical' when 3 then 'record contains invalid JSON'
    when 4 then 'record is empty' when 5 then 'first record must start a chain' end as reason
from u
"""


ENTRIES = {
    "build_chains": Entry("W-5 W-1", build_and_verify, _BUILD_SQL),
    "read_audit_log": Entry("SRC-1 SNK-3", _read, _READ_SQL),
    "verify_audit_log": Entry("W-1 W-2", _verify_files, _VERIFY_SQL),
    "chain_summary": Entry("A-3", _summary, _SUMMARY_SQL),
    "tampered_chains": Entry("W-1", _tampered, _TAMPERED_SQL),
}
