"""Registered queries for predicates and scalar functions (P-*, F-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe.catalog.common import (
    Entry,
    blank_sql,
    control_sql,
    text_message_sql,
)
from cloakframe.catalog.fixtures import kid_of, table, wide
from cloakframe.functions import digests as D
from cloakframe.functions import predicates as P
from cloakframe.functions import text as X
from cloakframe.functions.gf256 import gf_div, gf_inverse, gf_mul
from cloakframe.operators import policy_checks as C
from cloakframe.operators.access import usable_keys
from cloakframe.plans.jobs import compute_once, validate_rows


def _text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    rules = {
        "text": P.text_error("text", "text"),
        "source": P.bounded_text_error("source", "source", 8),
    }
    good, rejects = validate_rows(docs, rules)
    return good.select(
        "doc_id", F.lit("ok").alias("rule"), F.lit(None).cast("string").alias("message")
    ).unionByName(rejects.select("doc_id", "rule", "message"))


_TEXT_SQL = f"""
with m as (select doc_id, {text_message_sql("text", "text")} as a,
  coalesce({text_message_sql("source", "source")}, case when length(source) > 8
    then 'source exceeds maximum allowed length: 8' end) as b from documents)
select doc_id, case when a is not null then 'text' when b is not null then 'source' else 'ok' end
  as rule, coalesce(a, b) as message from m
"""


def _bounded(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        P.text_ok("text").alias("text_ok"),
        P.bounded_text_ok("text", 128).alias("short"),
        P.name_ok("text").alias("name_ok"),
        P.ref_error(F.concat_ws("-", "role", "conv_id"))["message"].alias("ref_message"),
    )


_BOUNDED_SQL = f"""
select conv_id, turn,
  not {blank_sql("text")} and not {control_sql("text")} as text_ok,
  not {blank_sql("text")} and not {control_sql("text")} and length(text) <= 128 as short,
  not {blank_sql("text")} and not {control_sql("text")} and length(text) <= 128
    and not regexp_matches(text, '[;=]') as name_ok,
  cast(null as varchar) as ref_message
from conversations
"""


def _names(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id",
        P.name_error("url", "url")["message"].alias("message"),
        P.name_ok("url").alias("ok"),
    )


_NAMES_SQL = """
select page_id, case when length(url) > 128 then 'url exceeds maximum allowed length: 128'
  when regexp_matches(url, '[;=]') then 'url must not contain '';'' or ''=''' end as message,
  length(url) <= 128 and not regexp_matches(url, '[;=]') as ok from pages
"""

_LABELS = """case o_orderkey % 7
  when 0 then concat('status=', o_orderstatus, ';prio=', o_orderpriority)
  when 1 then concat('status=', o_orderstatus, ';status=', o_orderpriority)
  when 2 then concat('status', o_orderstatus)
  when 3 then concat('=', o_orderstatus)
  when 4 then concat('status=', o_orderstatus, ';prio=')
  when 5 then concat('a b=', o_orderstatus)
  else concat('k=', o_orderstatus, '=', o_orderpriority) end"""


def _labels(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_LABELS).alias("labels"))
    return o.select(
        "o_orderkey",
        P.labels_ok("labels").alias("ok"),
        P.labels_error("context", "labels")["message"].alias("message"),
        P.aad_ok("labels").alias("aad_ok"),
        P.aad_error("labels")["message"].alias("aad_message"),
        X.aad_field("labels", "status").alias("status"),
        X.aad_field("labels", "prio").alias("prio"),
    )


_LABELS_SQL = f"""
select o_orderkey, o_orderkey % 7 = 0 as ok,
  case o_orderkey % 7 when 1 then 'context label keys must be unique'
    when 2 then 'context labels must use key=value format'
    when 3 then 'context label key must not be empty'
    when 4 then 'context label value must not be empty'
    when 5 then 'context label key contains invalid characters'
    when 6 then 'context label value must not contain ''=''' end as message,
  o_orderkey % 7 in (0, 1) as aad_ok,
  case o_orderkey % 7 when 2 then 'aad must contain key=value fields'
    when 3 then 'aad key must not be empty'
    when 4 then 'aad value must not be empty'
    when 5 then 'aad key contains invalid characters'
    when 6 then 'aad must contain key=value fields' end as aad_message,
  case when o_orderkey % 7 in (0, 1, 4) then o_orderstatus end as status,
  case o_orderkey % 7 when 0 then o_orderpriority when 4 then '' end as prio
from orders
"""

_HEX = """case c_custkey % 5
  when 0 then sha2(c_name, 256)
  when 1 then upper(sha2(c_name, 256))
  when 2 then left(sha2(c_name, 256), 63)
  when 3 then left(sha2(c_name, 256), 40)
  else concat('zz', left(sha2(c_name, 256), 62)) end"""


def _hex(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.expr(_HEX).alias("h"))
    segments = ["BUILDING", "MACHINERY"]
    return c.select(
        "c_custkey",
        P.hex_ok("h").alias("hex_ok"),
        P.hash_hex_ok("h", "SHA-256").alias("hash_ok"),
        P.hash_hex_error("digest", "h", "SHA-256")["message"].alias("message"),
        P.allowed_ok("c_mktsegment", segments).alias("allowed"),
        P.allowed_error("segment", "c_mktsegment", segments)["message"].alias("why"),
    )


_HEX_SQL = """
select c_custkey, c_custkey % 5 in (0, 1, 3) as hex_ok, c_custkey % 5 in (0, 1) as hash_ok,
  case c_custkey % 5 when 2 then 'digest must have an even number of hex characters'
    when 3 then 'digest must be 64 hex characters for SHA-256, got 40'
    when 4 then 'digest must contain only hexadecimal characters' end as message,
  c_mktsegment in ('BUILDING', 'MACHINERY') as allowed,
  case when c_mktsegment not in ('BUILDING', 'MACHINERY')
    then 'segment must be one of BUILDING, MACHINERY' end as why
from customer
"""


def _envelope(spark, sf):
    d = table(spark, sf, "documents")
    cipher = X.to_base64(X.utf8("text"))
    label = X.to_base64(X.utf8(F.concat(F.lit("source="), "source")))
    nonce = X.to_base64(F.unhex(F.left(F.sha2("text", 256), F.lit(24))))
    longer = X.to_base64(F.unhex(F.left(F.sha2("text", 256), F.lit(32))))
    blank = X.to_base64(X.utf8(F.lit("  ")))
    kind = F.col("doc_id") % 6
    value = (
        F.when(kind == 0, F.concat_ws(".", cipher, nonce, label))
        .when(kind == 1, F.concat_ws(".", cipher, nonce))
        .when(kind == 2, F.concat_ws(".", cipher, longer, label))
        .when(kind == 3, F.concat_ws(".", cipher, nonce, blank))
        .when(kind == 4, F.concat_ws(".", cipher, F.concat(nonce, F.lit("!")), label))
        .otherwise(F.concat_ws(".", cipher, F.lit(""), label))
    )
    return d.select("doc_id", value.alias("v")).select(
        "doc_id",
        P.envelope_ok("v").alias("ok"),
        P.envelope_error("data", "v")["message"].alias("message"),
    )


_ENVELOPE_SQL = """
with d as (select doc_id, strlen(text) as n, doc_id % 6 as kind,
    4 * ((strlen(text) + 2) // 3) as c, 4 * ((strlen('source=' || source) + 2) // 3) as l from documents),
  m as (select doc_id, case
  when case kind when 1 then c + 17 when 2 then c + 26 + l when 3 then c + 22 when 4 then c + 19 + l
    when 5 then c + 2 + l else c + 18 + l end > 32768 then 'data exceeds maximum allowed length: 32768'
  when kind in (1, 5) or n = 0 then 'data must have ciphertext.nonce.aad base64 sections'
  when kind = 4 then 'data contains invalid base64'
  when n < 16 then 'data.ciphertext must include at least a 16-byte authentication tag'
  when kind = 2 then 'data.nonce must be 12 bytes'
  when kind = 3 then 'data.aad must not be empty' end as message from d)
select doc_id, message is null as ok, message from m
"""

_DIGITS = "0123456789"


def _alphabet(spark, sf):
    c = table(spark, sf, "customer").withColumn(
        "v",
        F.when(F.col("c_custkey") % 3 == 0, F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
        .when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("string"))
        .otherwise(F.col("c_name")),
    )
    return c.select(
        "c_custkey",
        P.alphabet_ok("v", _DIGITS, 6, 32).alias("ok"),
        P.alphabet_error("plaintext", "v", _DIGITS, 6, 32)["message"].alias("message"),
    )


_ALPHABET_SQL = """
with v as (select c_custkey, case c_custkey % 3
    when 0 then lpad(cast(c_custkey as varchar), 12, '0')
    when 1 then cast(c_custkey as varchar) else c_name end as v from customer)
select c_custkey, not regexp_matches(v, '[^0-9]') and length(v) between 6 and 32 as ok,
  case when regexp_matches(v, '[^0-9]')
    then 'plaintext contains character outside fpe profile alphabet'
    when length(v) not between 6 and 32
    then 'plaintext length is outside fpe profile bounds' end as message from v
"""

_META = """case event_id % 6
  when 5 then concat(repeat('[', 130), '"[', event_id, '"', repeat(']', 130))
  when 0 then props
  when 1 then concat('[', props, ']')
  when 2 then left(props, length(props) - 1)
  when 4 then if(event_id % 4 = 0, concat('{"$serde_json::private::Number": ', props, '}'),
    concat('{"b": ', props, ', "a": [1, {"z": 1, "y": 2}]}'))
  when 3 then concat('{"pad": "', repeat('x', 120), '", "p": ', props, '}')
  else concat('{"b": ', props, ', "a": [1, {"z": 1, "y": 2}]}') end"""


def _metadata(spark, sf):
    e = wide(spark, sf, "events", "event_id", "props")
    e = e.select("event_id", F.expr(_META).alias("m"))
    v = F.col("v")
    e = compute_once(e, {"v": F.try_parse_json("m")})
    e = compute_once(
        e,
        {"why": P.metadata_error("m", parsed=v)["message"], "canonical": F.to_json(v)},
    )
    return e.select(
        "event_id",
        F.col("why").isNull().alias("ok"),
        F.col("why").alias("message"),
        P.json_shape_ok("m", v).alias("shape_ok"),
        "canonical",
    )


_METADATA_SQL = """
select event_id, event_id % 6 in (0, 4) and event_id % 12 <> 4 as ok, case event_id % 6
    when 4 then case when event_id % 12 = 4 then 'metadata contains a reserved JSON object key' end
    when 1 then 'metadata must be a JSON object when present'
    when 2 then 'metadata contains invalid JSON'
    when 3 then 'metadata exceeds tokenization maximum length'
    when 5 then 'metadata is nested too deeply' end as message,
  event_id % 6 not in (2, 5) and event_id % 12 <> 4 as shape_ok,
  case event_id % 6 when 0 then replace(props, ' ', '')
    when 1 then '[' || replace(props, ' ', '') || ']' when 2 then null
    when 3 then '{"p":' || replace(props, ' ', '') || ',"pad":"' || repeat('x', 120) || '"}'
    when 4 then case when event_id % 12 = 4
      then '{"$serde_json::private::Number":' || replace(props, ' ', '') || '}'
      else '{"a":[1,{"y":2,"z":1}],"b":' || replace(props, ' ', '') || '}' end
    else repeat('[', 130) || '"[' || event_id || '"' || repeat(']', 130) end as canonical
from events
"""


_STATUS = (
    "case {c} % 6 when 0 then 'active' when 1 then 'retired' when 2 then 'disabled' "
    "when 3 then 'compromised' when 4 then 'destroyed' end"
)


def _usable(spark, sf):
    customers = table(spark, sf, "customer")
    keys = customers.select(
        F.col("c_custkey").cast("string").alias("kid"),
        F.expr(_STATUS.format(c="c_custkey")).alias("status"),
    ).filter("status is not null")
    asked = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("kid")
    )
    new = usable_keys(asked, keys, "new")
    return new.select(
        "o_orderkey",
        "kid",
        F.col("error.kind").alias("kind"),
        F.col("error.message").alias("message"),
    )


_USABLE_SQL = """
select o_orderkey, cast(o_custkey as varchar) as kid,
  case when c_custkey is null or o_custkey % 6 = 5 then 'not_found'
    when o_custkey % 6 = 0 then null else 'forbidden' end as kind,
  case when c_custkey is null or o_custkey % 6 = 5
      then 'key not loaded: ' || cast(o_custkey as varchar)
    else case o_custkey % 6
      when 1 then 'key is retired and can only be used for decrypt or verification'
      when 2 then 'key is currently disabled'
      when 3 then 'key is compromised and cannot be used for security reasons'
      when 4 then 'key is logically destroyed and cannot be used' end end as message
from orders left join customer on o_custkey = c_custkey
"""


def _profiles(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pos"),
        F.when(F.col("c_custkey") % 11 == 0, F.concat("c_name", F.lit(";x")))
        .otherwise(F.col("c_name"))
        .alias("name"),
        F.lit(kid_of("main")).alias("kid"),
        (F.col("c_custkey") % 4).cast("int").alias("visible_first"),
        (F.col("c_custkey") % 5).cast("int").alias("visible_last"),
        F.when(F.col("c_custkey") % 13 == 0, "**").otherwise("*").alias("mask_char"),
        (F.col("c_custkey") % 9).cast("int").alias("min_len"),
        (F.col("c_custkey") % 2000).cast("int").alias("max_len"),
    )
    checked = C.section_errors("masking_profiles", c)
    return checked.select("pos", F.col("error.message").alias("message"))


_PROFILES_SQL = """
select c_custkey as pos, case
  when c_custkey % 11 = 0 then 'masking_profiles.name must not contain '';'' or ''='''
  when c_custkey % 13 = 0 then 'masking_profiles.mask_char must be exactly one character'
  when c_custkey % 9 < 1 then 'masking_profiles.min_len must be at least 1'
  when c_custkey % 2000 > 1024 then 'masking_profiles.max_len exceeds maximum allowed value'
  when c_custkey % 2000 < c_custkey % 9
    then 'masking_profiles.max_len must be greater than or equal to min_len'
  when c_custkey % 4 > c_custkey % 2000 or c_custkey % 5 > c_custkey % 2000
    then 'masking_profiles.visible_first and visible_last must not exceed max_len'
  when c_custkey % 4 + c_custkey % 5 >= c_custkey % 9
    then 'masking_profiles.visible_first plus visible_last must be less than min_len'
  end as message from customer
"""


_CLOCK = {
    "local_start_us": "1700000000000000 + event_id * 1000",
    "local_end_us": "1700000000000000 + event_id * 1000 + cast(floor(value * 100) as bigint)",
    "offset_us": "(event_id % 2401 - 1200) * 1000",
    "round_trip_us": "cast(floor(value * 40000) as bigint)",
    "midpoint_us": "1700000000000000 + event_id * 1000 + (user_id % 11 - 5) * 300000",
    "radius_us": "(user_id % 7) * 400000",
    "max_clock_skew_ms": "1000",
    "max_round_trip_ms": "2000",
    "max_radius_ms": "2000",
}


def _clock(spark, sf):
    e = table(spark, sf, "events")
    obs = e.select("event_id", *[F.expr(x).cast("long").alias(n) for n, x in _CLOCK.items()])
    return obs.select(
        "event_id",
        P.local_within("local_start_us", "local_end_us", "midpoint_us", "radius_us").alias(
            "local_within"
        ),
        P.clock_acceptable().alias("acceptable"),
        (F.col("offset_us") / 1000.0).alias("skew_ms"),
    )


_CLOCK_SQL = f"""
with o as (select event_id, {", ".join(f"{x} as {n}" for n, x in _CLOCK.items())} from events)
select event_id,
  local_start_us <= midpoint_us + radius_us and midpoint_us - radius_us <= local_end_us
    as local_within,
  abs(offset_us) <= max_clock_skew_ms * 1000 and round_trip_us <= max_round_trip_ms * 1000
    and radius_us <= max_radius_ms * 1000
    and local_start_us <= midpoint_us + radius_us and midpoint_us - radius_us <= local_end_us
    and local_start_us + offset_us <= midpoint_us + radius_us
    and midpoint_us - radius_us <= local_end_us + offset_us as acceptable,
  offset_us / 1000.0 as skew_ms from o
"""


def _scalars(spark, sf):
    c = table(spark, sf, "customer")
    raw = X.utf8("c_name")
    label = X.aad([("name", F.col("c_name")), ("seg", F.col("c_mktsegment"))])
    return c.select(
        "c_custkey",
        X.object_json({"seg": F.col("c_mktsegment"), "name": F.col("c_name")}).alias("json"),
        label.alias("label"),
        X.context_aad(label, F.concat(F.lit("k="), "c_mktsegment", F.lit(";v=1"))).alias("ctx"),
        X.to_hex(raw).alias("hex"),
        X.to_base64(raw).alias("b64"),
        X.from_utf8(X.from_base64(X.to_base64(raw))).alias("b64_back"),
        X.to_base64url(F.unhex(F.sha2("c_name", 256))).alias("b64url"),
        X.fingerprint(F.sha2("c_name", 256)).alias("fingerprint"),
    )


_SCALARS_SQL = """
select c_custkey,
  '{"name":"' || c_name || '","seg":"' || c_mktsegment || '"}' as json,
  'name=' || c_name || ';seg=' || c_mktsegment as label,
  'name=' || c_name || ';seg=' || c_mktsegment || ';context.k=' || c_mktsegment || ';context.v=1'
    as ctx,
  lower(hex(encode(c_name))) as hex, to_base64(encode(c_name)) as b64, c_name as b64_back,
  rtrim(translate(to_base64(from_hex(sha256(c_name))), '+/', '-_'), '=') as b64url,
  left(sha256(c_name), 8) as fingerprint
from customer
"""


def _sanitize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        X.sanitize("text", 256).alias("clean"),
        D.digest_hex(X.utf8("text"), "SHA-256").alias("digest"),
    )


_SANITIZE_SQL = r"""
select doc_id,
  substr(regexp_replace(text, '[\x00-\x1F\x7F-\x{9F}]', '', 'g'), 1, 256) as clean,
  sha256(text) as digest from documents
"""


_FAMILY = {"BLAKE2b(160)": 40, "BLAKE2b(256)": 64, "BLAKE2b(512)": 128, "SHA-3(256)": 64, "SHA-3(512)": 128}


def _digest_family(spark, sf):
    """F-6: digests without a Spark expression, of every document: as many distinct ones as there
    are distinct texts, all of the right length."""
    docs = table(spark, sf, "documents").select(X.utf8("text").alias("b"))
    each = [F.struct(F.lit(a).alias("alg"), D.digest_hex("b", a).alias("d")) for a in _FAMILY]
    return (
        compute_once(docs, {"all": F.array(*each)})
        .select(F.inline("all"))
        .groupBy("alg", "d")
        .agg(F.count("*").alias("n"))
        .groupBy("alg")
        .agg(
            F.sum("n").alias("documents"),
            F.count("*").alias("digests"),
            F.min(F.length("d")).alias("least"),
            F.max(F.length("d")).alias("most"),
        )
    )


_FAMILY_SQL = " union all ".join(
    f"select '{a}' as alg, count(*) as documents, count(distinct text) as digests, {n} as least, "
    f"{n} as most from documents"
    for a, n in _FAMILY.items()
)


def _digest_udf(spark, sf):
    """U-1: the function that hashes batches in Python, for a digest that SQL has too."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.lower(F.hex(D.digest_udf("SHA-256")(X.utf8("text")))).alias("digest"))


_DIGEST_UDF_SQL = "select doc_id, sha256(text) as digest from documents"


_KINDS = [
    "invalid_input",
    "not_found",
    "forbidden",
    "storage",
    "stale_config",
    "invalid_signature",
    "remote_unreachable",
    "internal",
]


def _status(spark, sf):
    e = table(spark, sf, "events")
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    kind = F.get(kinds, (F.col("event_id") % 8).cast("int"))
    secs = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    return e.select(
        "event_id",
        X.error_status(kind).alias("status"),
        secs.alias("unix"),
        F.unix_seconds(X.from_unix_text(secs)).alias("back"),
    )


_STATUS_SQL = """
select event_id, [400, 404, 403, 500, 400, 400, 500, 500][event_id % 8 + 1] as status,
  cast(cast(floor(epoch(ts)) as bigint) as varchar) as unix,
  cast(floor(epoch(ts)) as bigint) as back from events
"""


def _gf(spark, sf):
    """F-9: inverse and division undo multiplication for every pair that occurs."""
    li = table(spark, sf, "lineitem")
    pairs = li.select(
        (F.col("l_partkey") % 256).cast("int").alias("a"),
        (F.col("l_orderkey") % 255 + 1).cast("int").alias("b"),
    ).distinct()
    made = pairs.withColumn("p", gf_mul(F.col("a"), F.col("b")))
    made = made.withColumn("back", gf_div(F.col("p"), F.col("b")))
    one = gf_mul(F.col("b"), gf_inverse(F.col("b")))
    return made.select("a", "b", F.col("p").cast("int").alias("product"), "back", one.alias("one"))


def _double(c: str) -> str:
    return f"xor(({c} << 1) & 255, case when {c} >= 128 then 27 else 0 end)"


_GF_SQL = f"""
with v0 as (select distinct cast(l_partkey % 256 as integer) as a,
    cast(l_orderkey % 255 + 1 as integer) as b from lineitem),
  {", ".join(
    f"v{i + 1} as (select *, {_double('a' if i == 0 else f'd{i}')} as d{i + 1} from v{i})" for i in range(7)
  )}
select a, b, cast({"xor(" * 7}(a * (b & 1)){"".join(f", d{i} * ((b >> {i}) & 1))" for i in range(1, 8))}
    as integer) as product, a as back, 1 as one from v7
"""


ENTRIES = {
    "validate_text_rows": Entry("P-1 P-2 validate_rows", _text, _TEXT_SQL),
    "bounded_text": Entry("P-1 P-2 P-3", _bounded, _BOUNDED_SQL),
    "profile_names": Entry("P-3", _names, _NAMES_SQL),
    "label_strings": Entry("P-4 P-5", _labels, _LABELS_SQL),
    "hex_and_lists": Entry("P-6 P-7", _hex, _HEX_SQL),
    "envelopes": Entry("P-8", _envelope, _ENVELOPE_SQL),
    "alphabets": Entry("P-9", _alphabet, _ALPHABET_SQL),
    "metadata_json": Entry("P-10 P-11 F-1", _metadata, _METADATA_SQL),
    "usable_keys": Entry("P-12", _usable, _USABLE_SQL),
    "profile_bounds": Entry("P-13", _profiles, _PROFILES_SQL),
    "clock_samples": Entry("P-14", _clock, _CLOCK_SQL),
    "text_codecs": Entry("F-1 F-2 F-3 F-4 F-7", _scalars, _SCALARS_SQL),
    "sanitize_and_digest": Entry("F-5 F-6", _sanitize, _SANITIZE_SQL),
    "digest_family": Entry("F-6", _digest_family, _FAMILY_SQL),
    "digest_udf": Entry("U-1", _digest_udf, _DIGEST_UDF_SQL),
    "error_status": Entry("F-8 F-10", _status, _STATUS_SQL),
    "field_arithmetic": Entry("F-9", _gf, _GF_SQL),
}
