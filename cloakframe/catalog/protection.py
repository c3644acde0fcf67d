"""Registered queries for the column jobs (X-*, R-1, J-9, J-10, A-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.catalog.common import Entry, account, account_sql, message, tag_sql
from cloakframe.catalog.fixtures import demo_policy, kid_of, table, wide
from cloakframe.operators import commitments, digest_frames, encryption, fpe, masking, sharing, tags
from cloakframe.operators import tokens as tok
from cloakframe.plans.jobs import JobError, first_failure
from cloakframe.plans.protect import Step, protect_and_store, protect_frame
from cloakframe.plans.runtime import new_scratch
from cloakframe.sources import tables as T

MAIN = kid_of("main")


def mask_accounts(spark, sf):
    """X-1: two columns masked in one projection, with the reasons rows were refused."""
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey").cast("string"))
        .otherwise(account("c_custkey"))
        .alias("acct"),
        "c_name",
    )
    pol = demo_policy(spark)
    return message(masking.mask_columns(c, {"acct": "account", "c_name": "name"}, pol, "null"))


_MASK_SQL = f"""
with v as (select c_custkey, c_name, case when c_custkey % 7 = 0 then cast(c_custkey as varchar)
    else {account_sql("c_custkey")} end as a from customer)
select c_custkey,
  case when length(a) >= 6 then repeat('*', length(a) - 4) || right(a, 4) end as acct,
  case when length(a) >= 6 then left(c_name, 1) || repeat('*', length(c_name) - 1) end as c_name,
  case when length(a) < 6 then 'plaintext length is outside masking profile bounds' end as message
from v
"""


def _mask_rows(spark, sf):
    """X-1 with a profile named per row, over every key status."""
    c = table(spark, sf, "orders").select(
        "o_orderkey",
        account("o_orderkey").alias("acct"),
        F.get(
            F.array(*[F.lit(n) for n in ["account", "name", "paused", "leaked", "gone", "none"]]),
            (F.col("o_custkey") % 6).cast("int"),
        ).alias("profile"),
    )
    return message(masking.mask_by_profile(c, "acct", "profile", demo_policy(spark), "null"))


_MASK_ROWS_SQL = f"""
with v as (select o_orderkey, {account_sql("o_orderkey")} as a, o_custkey % 6 as k from orders)
select o_orderkey, ['account', 'name', 'paused', 'leaked', 'gone', 'none'][k + 1] as profile,
  case k when 0 then repeat('*', length(a) - 4) || right(a, 4)
    when 1 then left(a, 1) || repeat('*', length(a) - 1) end as acct,
  case k when 2 then 'key is currently disabled'
    when 3 then 'key is compromised and cannot be used for security reasons'
    when 4 then 'key is logically destroyed and cannot be used'
    when 5 then 'masking profile not found' end as message
from v
"""


def fpe_round_trip(spark, sf):
    """X-2, X-3: encrypt and decrypt every order account; shape and change are checked too."""
    o = wide(spark, sf, "orders", "o_orderkey")
    o = o.select("o_orderkey", account("o_orderkey", 16).alias("acct"))
    pol = demo_policy(spark)
    sealed = fpe.fpe_encrypt(o.withColumn("c", F.col("acct")), "c", "card", pol, "null")
    plain = sealed.drop("error").withColumn("plain", F.col("c"))
    back = fpe.fpe_decrypt(plain, "plain", "card", pol, "null")
    return back.select(
        "o_orderkey",
        "plain",
        F.col("c").rlike("^[0-9]{16}$").alias("shape"),
        (F.col("c") != F.col("acct")).alias("changed"),
    )


_FPE_SQL = f"""
select o_orderkey, {account_sql("o_orderkey", 16)} as plain, true as shape, true as changed
from orders
"""


def _fpe_distinct(spark, sf):
    """X-2 on a repeating column of mixed lengths, each distinct value encrypted once."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("P#"), "l_partkey", F.lit(" x")).alias("code")
    )
    pol = demo_policy(spark)
    sealed = fpe.fpe_encrypt_distinct(li, "code", "code", pol)
    counted = sealed.groupBy("code").agg(F.count("*").alias("n"))
    back = fpe.fpe_decrypt(counted, "code", "code", pol, "null")
    return back.select("code", "n")


_FPE_DISTINCT_SQL = """
select 'P#' || l_partkey || ' x' as code, count(*) as n from lineitem
where length('P#' || l_partkey || ' x') >= 6 group by all
union all
select null, count(*) from lineitem where length('P#' || l_partkey || ' x') < 6 having count(*) > 0
"""


def keyed_digests(spark, sf):
    """X-4, X-5: digest every order account and verify it against right and wrong tags."""
    o = wide(spark, sf, "orders", "o_orderkey", "o_custkey")
    o = o.select("o_orderkey", account("o_custkey").alias("acct"))
    pol = demo_policy(spark)
    made = tags.keyed_digest(o, "acct", "account", pol, "digest", "null").drop("error")
    presented = F.when(F.col("o_orderkey") % 3 == 0, F.upper("digest")).when(
        F.col("o_orderkey") % 3 == 1, F.sha2("digest", 256)
    )
    shown = made.withColumn("shown", presented.otherwise(F.left("digest", F.lit(10))))
    checked = tags.verify_digest(shown, "acct", "shown", "account", pol, "null")
    return message(checked).select("o_orderkey", "digest", "valid", "message")


_TAGS_SQL = f"""
select o_orderkey, {tag_sql("account", account_sql("o_custkey"))} as digest,
  case o_orderkey % 3 when 0 then true when 1 then false end as valid,
  case when o_orderkey % 3 = 2 then 'digest must be 64 hex characters for SHA-256, got 10' end
    as message from orders
"""


def _commit(spark, sf):
    """X-6, X-7: commitments to a repeating column: all verify, none repeats."""
    o = wide(spark, sf, "orders", "o_orderkey", "o_custkey")
    o = o.select("o_orderkey", account("o_custkey").alias("acct"))
    pol = demo_policy(spark)
    made = commitments.commit(o, "acct", "account", pol, "o_orderkey", "null").drop("error")
    wrong = F.when(F.col("o_orderkey") % 2 == 0, F.col("acct")).otherwise(F.lit("somebody"))
    shown = made.withColumn("shown", wrong)
    checked = commitments.verify_commitment(
        shown, "shown", "opening", "commitment", "account", pol, "null"
    )
    return checked.groupBy("acct").agg(
        F.count("*").alias("n"),
        F.countDistinct("commitment").alias("commitments"),
        F.countDistinct("opening").alias("openings"),
        F.count_if("valid").alias("valid"),
        F.count("error").alias("errors"),
    )


_COMMIT_SQL = f"""
select {account_sql("o_custkey")} as acct, count(*) as n, count(*) as commitments,
  count(*) as openings, count(*) filter (o_orderkey % 2 = 0) as valid, 0 as errors
from orders group by all
"""


def encrypt_round_trip(spark, sf):
    """X-8, X-9: every document encrypted and opened again; a changed label fails."""
    d = wide(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.regexp_replace("text", "\\p{Cc}", " ").alias("text")
    )
    pol, kid = demo_policy(spark), kid_of("main")
    sealed = encryption.encrypt_column(d, "text", kid, pol, "doc_id", timestamp="1", on_error="null")
    flipped = F.concat(
        F.translate(F.left("sealed.ctx", F.lit(1)), "0123456789abcdef", "123456789abcdef0"),
        F.substr("sealed.ctx", F.lit(2)),
    )
    bent = F.col("sealed").withField(
        "ctx",
        F.when(F.col("doc_id") % 10 == 0, flipped).otherwise(F.col("sealed.ctx")),
    )
    bent = bent.withField(
        "timestamp", F.when(F.col("doc_id") % 10 == 1, "2").otherwise(F.col("sealed.timestamp"))
    )
    tampered = sealed.drop("error", "text").withColumn("sealed", bent)
    opened = encryption.decrypt_column(tampered, "sealed", kid, pol, "plain", "null")
    return opened.select(
        "doc_id",
        F.sha2(F.col("plain").cast("binary"), 256).alias("digest"),
        F.col("error.message").alias("message"),
    )


_ENCRYPT_SQL = r"""
with d as (select doc_id, regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', ' ', 'g') as t
  from documents)
select doc_id, case when doc_id % 10 > 1 then sha256(t) end as digest,
  case when doc_id % 10 = 0 then 'message authentication failed' when doc_id % 10 = 1 then 'timestamp does not match message aad' end as message from d
"""


def _reencrypt(spark, sf):
    """X-10: rotate every order record from one key to another and open it there."""
    o = wide(spark, sf, "orders", "o_orderkey", "o_custkey")
    o = o.select("o_orderkey", account("o_custkey").alias("acct"))
    pol, a, b = demo_policy(spark), kid_of("main"), kid_of("next")
    sealed = encryption.encrypt_column(o, "acct", a, pol, "o_orderkey", timestamp="1", on_error="null")
    moved = encryption.reencrypt_column(
        sealed.drop("error", "acct"), "sealed", a, b, pol, "o_orderkey", timestamp="2", on_error="null"
    ).drop("error")
    opened = encryption.decrypt_column(moved, "sealed", b, pol, "acct", "null")
    return opened.select(
        "o_orderkey",
        "acct",
        F.regexp_extract("sealed.aad", "source_created_at=([0-9]+)", 1).alias("source_time"),
        (F.col("sealed.kid") == b).alias("moved"),
    )


_REENCRYPT_SQL = f"""
select o_orderkey, {account_sql("o_custkey")} as acct, '1' as source_time, true as moved
from orders
"""


def _new_vault(spark, df, col, profile, ref):
    """Tokenize a column into a fresh vault: ``(tokens, vault)``."""
    pol = demo_policy(spark)
    done, rows = tok.tokenize(df, col, profile, pol, ref, created_at="1")
    vault = T.create_vault(spark, new_scratch(spark, "vault"))
    T.append_vault(rows, vault)
    return done, vault


def tokenize_round_trip(spark, sf):
    """X-11, X-12, J-6: tokenize customers, look all tokens (and some unknown ones) up again."""
    c = wide(spark, sf, "customer", "c_custkey")
    c = c.select("c_custkey", account("c_custkey").alias("acct"))
    done, vault = _new_vault(spark, c, "acct", "account", "c_custkey")
    kind = F.col("c_custkey") % 10
    shown = (
        F.when(kind == 0, F.concat(F.lit("tok_acct_"), F.repeat(F.lit("A"), F.lit(43))))
        .when(kind == 1, F.concat(F.lit("tok_card_"), F.substr("token", F.lit(10))))
        .when(kind == 2, F.left("token", F.lit(21)))
        .otherwise(F.col("token"))
    )
    asked = done.select("c_custkey", shown.alias("token"))
    out = tok.detokenize(asked, "token", "account", demo_policy(spark), vault, "null")
    return out.select(
        "c_custkey",
        "plaintext",
        F.col("error.kind").alias("kind"),
        F.col("error.message").alias("message"),
    )


_TOKEN_SQL = f"""
select c_custkey, case when c_custkey % 10 > 2 then {account_sql("c_custkey")} end as plaintext,
  case when c_custkey % 10 = 0 then 'not_found' when c_custkey % 10 < 3 then 'invalid_input' end
    as kind,
  case c_custkey % 10 when 0 then 'token not found'
    when 1 then 'token prefix does not match tokenization profile'
    when 2 then 'token length does not match tokenization profile' end as message
from customer
"""


def _redeem(spark, sf):
    """X-13, S-2: redeem the even customers' one-time tokens, then the odd ones' in a second
    batch; what the vault still holds in between decides about a second redemption."""
    c = wide(spark, sf, "customer", "c_custkey")
    c = c.select("c_custkey", account("c_custkey").alias("acct"))
    done, vault = _new_vault(spark, c, "acct", "once", "c_custkey")
    pol = demo_policy(spark)
    shown = done.select("c_custkey", "token")
    even, odd = shown.filter("c_custkey % 2 = 0"), shown.filter("c_custkey % 2 = 1")
    first, version = tok.redeem_once(even, "token", "once", pol, vault, "c_custkey")
    held = tok.stored_tokens(shown, "token", "once", pol, vault, version)
    second, _ = tok.redeem_once(odd, "token", "once", pol, vault, "c_custkey")
    out = held.join(first.select("c_custkey", F.col("plaintext").alias("redeemed")), "c_custkey", "left")
    out = out.join(second.select("c_custkey", F.col("plaintext").alias("left_over")), "c_custkey", "left")
    message = F.when(~F.col("stored"), F.lit(tok.NOT_FOUND)).alias("message")
    return out.select("c_custkey", "redeemed", "left_over", message)


_REDEEM_SQL = f"""
select c_custkey, case when c_custkey % 2 = 0 then {account_sql("c_custkey")} end as redeemed,
  case when c_custkey % 2 = 1 then {account_sql("c_custkey")} end as left_over,
  case when c_custkey % 2 = 0 then 'token not found' end as message from customer
"""


def _one_time(spark, sf):
    """X-12: plain decoding of one-time tokens is refused and leaves the vault as it is."""
    c = wide(spark, sf, "customer", "c_custkey")
    c = c.select("c_custkey", account("c_custkey").alias("acct"))
    done, vault = _new_vault(spark, c, "acct", "once", "c_custkey")
    pol = demo_policy(spark)
    shown = done.select("c_custkey", "token")
    try:
        tok.detokenize(shown, "token", "once", pol, vault, "null")
        refused = None
    except JobError as err:
        refused = str(err)
    held = tok.stored_tokens(shown, "token", "once", pol, vault)
    return held.select("c_custkey", "stored", F.lit(refused).alias("refused"))


_ONE_TIME_SQL = """
select c_custkey, true as stored, 'tokens of a one-time profile can only be redeemed' as refused
from customer
"""


def _nonces(spark, sf):
    """R-1: one value in two columns, sealed at two times: no nonce serves two records."""
    pol = demo_policy(spark)
    o = table(spark, sf, "orders").select(
        "o_orderkey", account("o_custkey").alias("a"), account("o_custkey").alias("b")
    )
    sealed = None
    for column in ("a", "b"):
        for ts in ("1", "2"):
            part = encryption.encrypt_column(
                o, column, MAIN, pol, "o_orderkey", timestamp=ts, on_error="null"
            ).select("sealed.kid", "sealed.nonce")
            sealed = part if sealed is None else sealed.union(part)
    return sealed.groupBy("kid").agg(
        F.count("*").alias("rows"), F.countDistinct("nonce").alias("nonces")
    )


_NONCES_SQL = f"""
select '{MAIN}' as kid, 4 * count(*) as rows, 4 * count(*) as nonces from orders
"""


def share_round_trip(spark, sf):
    """X-14, X-15: split customer secrets 3-of-5; two, three, four or five shares come back."""
    c = wide(spark, sf, "customer", "c_custkey", "c_name")
    c = c.select("c_custkey", F.col("c_name").alias("secret"))
    pol = demo_policy(spark)
    shares = sharing.split_secret(c, "secret", "secret", pol, "c_custkey", "null")
    kept = shares.filter(F.col("index") <= F.col("c_custkey") % 4 + 2)
    out = sharing.combine_shares(kept, "share", "secret", pol, group=["c_custkey"])
    return message(out).select("c_custkey", F.col("plaintext").alias("secret"), "message")


_SHARE_SQL = """
select c_custkey, case when c_custkey % 4 > 0 then c_name end as secret,
  case when c_custkey % 4 = 0 then 'not enough shares to meet sharing profile threshold' end
    as message from customer
"""


def _row_digest(spark, sf):
    """X-16: digest of every order record."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    out = digest_frames.row_digest(o, ["o_orderkey", "o_custkey", "o_orderstatus"])
    return out.select("o_orderkey", "digest")


_ROW_SQL = """
select o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey
  || ',"o_orderstatus":"' || o_orderstatus || '"}') as digest from orders
"""


def table_digests(spark, sf):
    """X-17: one digest for all line items, whatever their order."""
    li = wide(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    cols = ["l_orderkey", "l_partkey", "l_returnflag"]
    return digest_frames.table_digest(li, cols)


_LIMBS = ", ".join(
    f"sum(cast('0x' || substr(h, {5 * i + 1}, 5) as bigint)) as s{i}" for i in range(13)
)
_TABLE_SQL = f"""
with r as (select sha256('{{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey
    || ',"l_returnflag":"' || l_returnflag || '"}}') as h from lineitem),
  s as (select count(*) as n, {_LIMBS} from r)
select n as rows, sha256(concat_ws(',', n, {", ".join(f"s{i}" for i in range(13))})) as digest
from s
"""


def _seal(spark, sf):
    """X-17: a sealed table verifies whole and reordered, not with a row changed or missing."""
    o = wide(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    pol, cols = demo_policy(spark), ["o_orderkey", "o_custkey", "o_orderstatus"]
    seal = digest_frames.seal_table(o, cols, kid_of("main"), pol).first().asDict()
    last = o.agg(F.max("o_orderkey").alias("m")).first()["m"]
    changed = o.withColumn(
        "o_custkey",
        F.when(F.col("o_orderkey") == last, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")),
    )
    frames = {
        "same": o,
        "reordered": o.orderBy(F.desc("o_orderkey")),
        "changed": changed,
        "shorter": o.filter(F.col("o_orderkey") < last),
    }
    out = None
    for name, frame in frames.items():
        row = digest_frames.verify_table_digest(frame, cols, seal, pol)
        row = row.withColumn("frame", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


_SEAL_SQL = """
select 'same' as frame, count(*) as rows, true as valid from orders union all
select 'reordered', count(*), true from orders union all
select 'changed', count(*), false from orders union all
select 'shorter', count(*) - 1, false from orders
"""

_STEPS = [
    Step("fpe", "acct", "account", "stored"),
    Step("digest", "acct", "account", "search"),
    Step("mask", "acct", "account", "display"),
    Step("commit", "acct", "account", "pledge", ref="o_orderkey"),
]


def protect_orders(spark, sf):
    """X-18: store, search, display and pledge one column in a single pass over the orders."""
    o = wide(spark, sf, "orders", "o_orderkey", "o_custkey")
    o = o.select("o_orderkey", account("o_custkey").alias("acct"))
    pol = demo_policy(spark)
    out = protect_frame(o, _STEPS, pol, drop=["acct"], on_error="null").drop("error")
    back = fpe.fpe_decrypt(out, "stored", "account", pol, "null")
    return back.select(
        "o_orderkey",
        "stored",
        "search",
        "display",
        F.length("pledge").alias("pledge_chars"),
        F.length("pledge_opening").alias("opening_chars"),
    )


_PROTECT_SQL = f"""
select o_orderkey, {account_sql("o_custkey")} as stored,
  {tag_sql("account", account_sql("o_custkey"))} as search,
  '********' || right({account_sql("o_custkey")}, 4) as display,
  64 as pledge_chars, 43 as opening_chars from orders
"""


def _protect_and_store(spark, sf):
    """X-18: all seven jobs on the accounts of customers in one pass over the table; rows, vault
    rows and shares come from one stored stage and lead back to the value."""
    pol = demo_policy(spark)
    c = wide(spark, sf, "customer", "c_custkey").select(
        F.col("c_custkey").cast("string").alias("ref"), "c_custkey", account("c_custkey").alias("acct")
    )
    steps = [
        *[Step(s.job, s.source, s.profile, s.output, ref="ref" if s.ref else None) for s in _STEPS],
        Step("encrypt", "acct", kid_of("main"), "sealed", ref="ref"),
        Step("tokenize", "acct", "account", "token", ref="ref"),
        Step("split", "acct", "secret", "set_id", ref="ref"),
    ]
    made = protect_and_store(c, steps, pol, drop=["acct"])
    vault = T.create_vault(spark, new_scratch(spark, "vault"))
    T.append_vault(made.vault, vault)
    rows = tok.detokenize(made.rows, "token", "account", pol, vault, "null").drop("error", "metadata")
    rows = encryption.decrypt_column(rows, "sealed", kid_of("main"), pol, "opened", "null").drop("error")
    rows = fpe.fpe_decrypt(rows, "stored", "account", pol, "null").drop("error")
    # any three of five shares
    some = made.shares["set_id"].where(F.col("index") != 1 + F.pmod(F.xxhash64("set_id"), F.lit(5)))
    joined = sharing.combine_shares(some, "share", "secret", pol)
    back = joined.where("error is null").select("set_id", F.col("plaintext").alias("rejoined"))
    return rows.join(back, "set_id").select(
        "c_custkey", "stored", "search", "display", "plaintext", "opened", "rejoined",
        F.length("pledge").alias("pledge_chars"),
    )


_STORE_SQL = f"""
select c_custkey, {account_sql("c_custkey")} as stored,
  {tag_sql("account", account_sql("c_custkey"))} as search,
  '********' || right({account_sql("c_custkey")}, 4) as display,
  {account_sql("c_custkey")} as plaintext, {account_sql("c_custkey")} as opened,
  {account_sql("c_custkey")} as rejoined, 64 as pledge_chars from customer
"""


def _join(spark, sf):
    """J-10: orders joined to customers on digests only."""
    pol = demo_policy(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"))
    c = table(spark, sf, "customer").select("c_name", F.col("c_custkey").cast("string").alias("k"))
    return tags.protected_join(o, c, "k", "k", "customer", pol)


_JOIN_SQL = f"""
select {tag_sql("customer", "cast(o_custkey as varchar)")} as digest, o_orderkey, c_name
from orders join customer on o_custkey = c_custkey
"""


def _dedupe(spark, sf):
    """A-8: the first order of every customer, keyed by digest; every seventh order has no key and
    every eleventh a blank one, and these stay apart."""
    pol = demo_policy(spark)
    key = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string"))
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, F.lit(" ")).otherwise(key).alias("k")
    )
    kept, apart = tags.dedupe_by_digest(o, "k", "customer", pol, ["o_orderkey"])
    apart = apart.select(
        F.lit(None).cast("string").alias("digest"), "o_orderkey", "o_orderstatus", F.col("error.message").alias("message")
    )
    return kept.withColumn("message", F.lit(None).cast("string")).unionByName(apart)


_DEDUPE_SQL = f"""
select {tag_sql("customer", "cast(o_custkey as varchar)")} as digest,
  min(o_orderkey) as o_orderkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus,
  cast(null as varchar) as message
from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 group by o_custkey
union all select null, o_orderkey, o_orderstatus,
  case when o_orderkey % 11 = 0 then 'plaintext must not be empty' end
from orders where o_orderkey % 7 = 0 or o_orderkey % 11 = 0
"""


def _join_states(spark, sf):
    """J-10: an inner join under an active key matches, under a retired one (new digests are not
    allowed) nothing does, and an outer join still keeps the orders."""
    pol = demo_policy(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"))
    c = table(spark, sf, "customer").select("c_name", F.col("c_custkey").cast("string").alias("k"))
    out = None
    for profile in ("account", "retired"):
        part = tags.protected_join(o, c, "k", "k", profile, pol, "left").groupBy().agg(
            F.lit(profile).alias("profile"),
            F.count("*").alias("orders"),
            F.count("digest").alias("digests"),
            F.count("c_name").alias("matched"),
        )
        out = part if out is None else out.union(part)
    return out


_JOIN_STATES_SQL = """
select 'account' as profile, count(*) as orders, count(*) as digests, count(c_name) as matched
from orders left join customer on o_custkey = c_custkey
union all select 'retired', count(*), 0, 0 from orders
"""


def _membership(spark, sf):
    """J-9: which order accounts occur in an index of the even customers, built twice."""
    pol = demo_policy(spark)
    c = table(spark, sf, "customer").filter("c_custkey % 2 = 0")
    known = tags.keyed_digest(
        c.select(account("c_custkey").alias("acct")), "acct", "account", pol, "digest", "null"
    ).select(F.lit(kid_of("main")).alias("kid"), "digest")
    index = T.create_index(spark, new_scratch(spark, "index"))
    T.upsert_index(known, index)
    T.upsert_index(known, index)
    o = wide(spark, sf, "orders", "o_orderkey", "o_custkey")
    o = o.select("o_orderkey", account("o_custkey").alias("acct"))
    out = tags.index_membership(o, "acct", "account", pol, index.read())
    return out.select("o_orderkey", "digest", "matched")


_MEMBERSHIP_SQL = f"""
select o_orderkey, {tag_sql("account", account_sql("o_custkey"))} as digest,
  o_custkey % 2 = 0 and o_custkey in (select c_custkey from customer) as matched from orders
"""


def _first_failure(spark, sf):
    """L-1: the first refused order of every customer decides that batch's error."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(" "))
        .when(F.col("o_orderkey") % 4 == 1, F.lit("12"))
        .otherwise(account("o_orderkey"))
        .alias("acct"),
    )
    pol = demo_policy(spark)
    done = masking.mask_columns(o, {"acct": "account"}, pol, "null")
    return first_failure(done, "o_orderkey", ["o_custkey"]).select("o_custkey", "pos", "message")


_FIRST_SQL = """
select o_custkey, min(o_orderkey) filter (o_orderkey % 4 < 2) as pos,
  'batch item ' || min(o_orderkey) filter (o_orderkey % 4 < 2) || ' failed: ' ||
  case min(o_orderkey) filter (o_orderkey % 4 < 2) % 4 when 0 then 'plaintext must not be empty'
    else 'plaintext length is outside masking profile bounds' end as message
from orders group by o_custkey
"""


ENTRIES = {
    "mask_accounts": Entry("X-1 SRC-2 J-1 P-1", mask_accounts, _MASK_SQL),
    "mask_by_profile": Entry("X-1 J-1 P-12", _mask_rows, _MASK_ROWS_SQL),
    "fpe_round_trip": Entry("X-2 X-3", fpe_round_trip, _FPE_SQL),
    "fpe_distinct_values": Entry("X-2 X-3", _fpe_distinct, _FPE_DISTINCT_SQL),
    "keyed_digests": Entry("X-4 X-5", keyed_digests, _TAGS_SQL),
    "commitments": Entry("X-6 X-7 R-1", _commit, _COMMIT_SQL),
    "encrypt_documents": Entry("X-8 X-9", encrypt_round_trip, _ENCRYPT_SQL),
    "rotate_keys": Entry("X-10", _reencrypt, _REENCRYPT_SQL),
    "tokenize_customers": Entry("X-11 X-12 J-6 SNK-1", tokenize_round_trip, _TOKEN_SQL),
    "redeem_tokens": Entry("X-13 S-2 A-1", _redeem, _REDEEM_SQL),
    "one_time_guard": Entry("X-12 X-13", _one_time, _ONE_TIME_SQL),
    "nonce_uniqueness": Entry("R-1 X-8", _nonces, _NONCES_SQL),
    "join_key_states": Entry("J-10 P-12", _join_states, _JOIN_STATES_SQL),
    "share_secrets": Entry("X-14 X-15 A-9", share_round_trip, _SHARE_SQL),
    "record_digests": Entry("X-16", _row_digest, _ROW_SQL),
    "table_digest": Entry("X-17", table_digests, _TABLE_SQL),
    "sealed_tables": Entry("X-17", _seal, _SEAL_SQL),
    "protect_orders": Entry("X-18", protect_orders, _PROTECT_SQL),
    "protect_and_store": Entry("X-18", _protect_and_store, _STORE_SQL),
    "protected_join": Entry("J-10", _join, _JOIN_SQL),
    "dedupe_by_digest": Entry("A-8", _dedupe, _DEDUPE_SQL),
    "index_membership": Entry("J-9 SNK-2", _membership, _MEMBERSHIP_SQL),
    "first_failure": Entry("L-1", _first_failure, _FIRST_SQL),
}
