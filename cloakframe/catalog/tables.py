"""Registered queries for table sources, sinks and maintenance (SRC-3..5, SNK-*, S-*, L-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.catalog.common import Entry, account, account_sql, message, tag_sql
from cloakframe.catalog.fixtures import demo_policy, kid_of, table
from cloakframe.operators import tags
from cloakframe.operators import tokens as tok
from cloakframe.operators.access import list_keys
from cloakframe.plans.runtime import new_scratch
from cloakframe.sources import tables as T
from cloakframe.sources.requests import read_request_batches

MAIN, OLD = kid_of("main"), kid_of("old")


def _requests(spark, sf):
    """SRC-3: one request document per order, some of them malformed."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 10

    def item(ref, text):
        return F.struct(ref.alias("ref"), text.alias("plaintext"))

    first = item(F.concat(F.lit("a"), "o_orderkey"), F.col("o_orderpriority"))
    second = item(
        F.concat(F.when(k == 1, F.lit("a")).otherwise(F.lit("b")), "o_orderkey"),
        F.when(k == 2, F.lit("  ")).otherwise(F.col("o_orderstatus")),
    )
    many = F.transform(
        F.sequence(F.lit(1), F.lit(129)), lambda i: item(i.cast("string"), F.lit("x"))
    )
    items = F.when(k == 3, F.slice(many, 1, 0)).when(k == 4, many).otherwise(F.array(first, second))
    doc = F.to_json(F.struct(F.lit("account").alias("profile"), items.alias("items")))
    doc = (
        F.when(k == 5, F.concat(F.lit('{"extra":1,'), F.substr(doc, F.lit(2))))
        .when(k == 6, F.replace(doc, F.lit('"plaintext"'), F.lit('"plain"')))
        .when(k == 7, F.left(doc, F.lit(20)))
        .otherwise(doc)
    )
    out = read_request_batches(o.select("o_orderkey", doc.alias("doc")), "mask")
    return message(out).select("o_orderkey", "pos", "ref", "plaintext", "message")


_REQUESTS_SQL = """
with i as (select o_orderkey, o_orderkey % 10 as k, unnest([0, 1]) as pos, o_orderpriority as p,
    o_orderstatus as s from orders where o_orderkey % 10 not between 3 and 7)
select o_orderkey, pos,
  case when pos = 0 or k = 1 then 'a' else 'b' end || o_orderkey as ref,
  case when pos = 0 then p when k = 2 then '  ' else s end as plaintext,
  case when pos = 1 and k = 1 then 'mask batch ref must be unique'
    when pos = 1 and k = 2 then 'plaintext must not be empty' end as message from i
union all
select o_orderkey, null, null, null, case o_orderkey % 10
  when 3 then 'mask batch items must not be empty'
  when 4 then 'mask batch items exceeds maximum allowed value: 128'
  when 5 then 'mask request contains an unknown field'
  when 6 then 'mask request contains an unknown or missing item field'
  else 'mask request contains invalid JSON' end from orders where o_orderkey % 10 between 3 and 7
"""


def vault_rows(spark, sf):
    """SNK-1, SRC-4: customers tokenized into the vault in two appends, scanned per kid."""
    pol = demo_policy(spark)
    c = table(spark, sf, "customer").select("c_custkey", account("c_custkey").alias("acct"))
    vault = T.create_vault(spark, new_scratch(spark, "vault"))
    for rest in (0, 1):
        _, rows = tok.tokenize(
            c.filter(F.col("c_custkey") % 2 == rest), "acct", "account", pol, "c_custkey",
            created_at="1",
        )
        T.append_vault(rows, vault)
    good, bad = T.scan_vault(spark, vault.path, [MAIN])
    other, _ = T.scan_vault(spark, vault.path, [OLD])
    counted = good.groupBy("kid").agg(
        F.count("*").alias("rows"), F.countDistinct("hashid").alias("hashids")
    )
    return counted.select(
        "*",
        bad.agg(F.count("*")).scalar().alias("bad"),
        other.agg(F.count("*")).scalar().alias("other"),
    )


_VAULT_SQL = f"""
select '{MAIN}' as kid, count(*) as rows, count(*) as hashids, 0 as bad, 0 as other from customer
"""


def _index(spark, sf):
    """SNK-2, S-1: order customers upserted twice into the blind index; it is a set."""
    pol = demo_policy(spark)
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    rows = tags.keyed_digest(o, "k", "customer", pol, "digest", "null").select(
        F.lit(MAIN).alias("kid"), "digest"
    )
    index = T.create_index(spark, new_scratch(spark, "index"))
    T.upsert_index(rows, index)
    T.upsert_index(rows, index)
    return index.read().select("kid", "digest")


_INDEX_SQL = f"""
select distinct '{MAIN}' as kid, {tag_sql("customer", "cast(o_custkey as varchar)")} as digest
from orders
"""


def _union(spark, sf):
    o = table(spark, sf, "orders").select(
        F.lit(MAIN).alias("kid"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("digest")
    )
    c = table(spark, sf, "customer").select(
        F.lit(MAIN).alias("kid"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("digest")
    )
    return T.index_union(o, c)


_UNION_SQL = f"""
select '{MAIN}' as kid, sha256(cast(o_custkey as varchar)) as digest from orders
union select '{MAIN}', sha256(cast(c_custkey as varchar)) from customer
"""


def _consume(spark, sf):
    """S-2: consume the index rows of the customers with even keys, all or nothing; compact and
    vacuum; what is left, and what an attempt with one unknown key says."""
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.lit(MAIN).alias("kid"),
        F.sha2(F.col("c_custkey").cast("string"), 256).alias("hashid"),
        F.concat(F.lit("AAAAAAAAAAAAAAAAAAAAAA==.AAAAAAAAAAAAAAAA."), _b64("c_name")).alias("data"),
    )
    vault = T.create_vault(spark, new_scratch(spark, "vault"))
    T.append_vault(c.drop("c_custkey"), vault)
    try:
        T.consume(vault, c.select("kid", F.sha2(F.concat("hashid", F.lit("?")), 256).alias("hashid")))
        said = None
    except T.TableError as err:
        said = str(err)
    T.consume(vault, c.filter("c_custkey % 2 = 0").select("kid", "hashid"))
    vault.compact()
    vault.vacuum()
    return vault.read().select("hashid", F.lit(said).alias("said"))


_CONSUME_SQL = """
select sha256(cast(c_custkey as varchar)) as hashid, 'token not found' as said from customer
where c_custkey % 2 = 1
"""


def _missing(spark, sf):
    """L-3: in every market segment the first requested customer that is not among the even ones."""
    c = table(spark, sf, "customer")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    found = c.filter("c_custkey % 2 = 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("hashid"))
    out = None
    for segment in segments:
        asked = c.filter(F.col("c_mktsegment") == segment).select(
            F.sha2(F.col("c_custkey").cast("string"), 256).alias("hashid")
        )
        part = T.first_missing(asked, found).select(F.lit(segment).alias("segment"), "hashid")
        out = part if out is None else out.union(part)
    return out


_MISSING_SQL = """
select s.segment, min(sha256(cast(c_custkey as varchar))) filter (c_custkey % 2 = 1) as hashid
from (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) as segment) s
left join customer on c_mktsegment = s.segment group by s.segment
"""


def _keys(spark, sf):
    """SRC-5, L-2: a key registry made from customers; unusable rows are skipped."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey") % 7
    status = F.when(k == 1, "lost").when(k % 2 == 0, "active").otherwise("retired")
    lifecycle = F.struct(
        status.alias("status"),
        F.when(k == 2, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("reason"),
        F.lit("1").alias("changed_at"),
    )
    properties = F.struct(
        F.lit(1).alias("version"),
        F.lit("hybrid-standard-v1").alias("profile"),
        F.col("c_name").alias("tag"),
        F.lit("1").alias("created_at"),
        lifecycle.alias("lifecycle"),
    )
    rows = c.select(
        F.sha2("c_name", 256).alias("kid"), F.when(k != 3, properties).alias("properties")
    )
    path = new_scratch(spark, "keys")
    rows.write.parquet(path)
    good, bad = T.scan_keys(spark, path)
    listed = list_keys(good).select(
        "kid", F.col("properties.lifecycle.status").alias("status"), F.lit(None).cast("string").alias("message")
    )
    return listed.unionByName(
        bad.select("kid", F.lit(None).cast("string").alias("status"), F.col("error.message").alias("message"))
    )


_KEYS_SQL = """
with v as (select sha256(c_name) as kid, c_custkey % 7 as k from customer)
select kid, case when k in (1, 2, 3) then null when k % 2 = 0 then 'active' else 'retired' end
    as status,
  case k when 1 then 'properties.lifecycle.status must be one of active, disabled, retired, '
      || 'compromised, destroyed' when 2 then 'properties.lifecycle.reason must not be empty'
    when 3 then 'properties cannot be read' end as message from v
"""


def _lookup(spark, sf):
    """J-6: order accounts against a stored vault of customers, missing ones kept."""
    c = table(spark, sf, "customer").select(
        F.lit(MAIN).alias("kid"),
        F.sha2(account("c_custkey"), 256).alias("hashid"),
        F.concat(F.lit("AAAAAAAAAAAAAAAAAAAAAA==.AAAAAAAAAAAAAAAA."), _b64("c_name")).alias("data"),
    )
    vault = T.create_vault(spark, new_scratch(spark, "vault"))
    T.append_vault(c, vault)
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.lit(MAIN).alias("kid"),
        F.sha2(account("o_custkey"), 256).alias("hashid"),
    )
    out = tok.vault_lookup(o, vault)
    return out.select("o_orderkey", F.substring_index("data", ".", -1).alias("data"))


def _b64(c):
    from cloakframe.functions.text import to_base64, utf8

    return to_base64(utf8(c))


_LOOKUP_SQL = f"""
select o_orderkey, to_base64(encode(c_name)) as data
from orders left join customer on {account_sql("o_custkey")} = {account_sql("c_custkey")}
"""


ENTRIES = {
    "request_batches": Entry("SRC-3 A-1", _requests, _REQUESTS_SQL),
    "vault_rows": Entry("SRC-4 SNK-1", vault_rows, _VAULT_SQL),
    "blind_index": Entry("SNK-2", _index, _INDEX_SQL),
    "index_union": Entry("S-1", _union, _UNION_SQL),
    "consume_rows": Entry("S-2", _consume, _CONSUME_SQL),
    "first_missing": Entry("L-3", _missing, _MISSING_SQL),
    "key_registry": Entry("SRC-5 L-2", _keys, _KEYS_SQL),
    "vault_lookup": Entry("J-6", _lookup, _LOOKUP_SQL),
}
