"""Registered queries for access control, routes and key lifecycle (J-1..J-8, J-11, W-3, W-4,
S-3, A-2, A-6, SRC-2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.catalog.common import Entry, hmac_sql, message
from cloakframe.catalog.fixtures import demo_policy, kid_of, table
from cloakframe.functions.digests import hmac_pads
from cloakframe.functions.text import aad, to_base64, utf8
from cloakframe.operators import access as A
from cloakframe.operators import policy_checks as C
from cloakframe.plans.keys import one_row
from cloakframe.sources.policy import parse_policy, split_policy
from cloakframe.plans.runtime import cut_lineage

MAIN, OLD = kid_of("main"), kid_of("old")

# --- J-1 ------------------------------------------------------------------------------

_NAMES = ["account", "name", "paused", "leaked", "gone", "none"]
_PAUSED, _LEAKED, _GONE = kid_of("paused"), kid_of("leaked"), kid_of("gone")


def _resolve(spark, sf):
    pol = demo_policy(spark)
    names = F.array(*[F.lit(n) for n in _NAMES])
    kids = F.array(*[F.lit(k) for k in [MAIN, OLD, _PAUSED, _LEAKED, _GONE, MAIN]])
    slot = (F.col("event_id") % 6).cast("int")
    asked = table(spark, sf, "events").select(
        "event_id",
        F.get(names, slot).alias("profile"),
        F.when(F.col("user_id") % 5 == 0, F.lit(MAIN)).otherwise(F.get(kids, slot)).alias("kid"),
    )
    out = A.resolve_profile(asked, pol.tables["masking_profiles"], pol.key_frame(), "new")
    return out.select(
        "event_id", F.col("error.kind").alias("kind"), F.col("error.message").alias("message")
    )


_RESOLVE_SQL = """
with v as (select event_id, event_id % 6 as s, user_id % 5 = 0 as m from events)
select event_id,
  case when s = 5 then 'invalid_input' when s = 0 then null else 'forbidden' end as kind,
  case when s = 5 then 'masking profile not found' when s = 0 then null
    when m then 'masking profile is not authorized for this kid'
    when s = 1 then 'key is retired and can only be used for decrypt or verification'
    when s = 2 then 'key is currently disabled'
    when s = 3 then 'key is compromised and cannot be used for security reasons'
    when s = 4 then 'key is logically destroyed and cannot be used' end as message from v
"""

# --- J-2, J-3, J-4 --------------------------------------------------------------------

_IPAD, _OPAD = hmac_pads(b"api key hashing key", "SHA-256")


def _pads(spark):
    schema = T.StructType.fromDDL("ipad binary, opad binary")
    return one_row(spark, {"ipad": _IPAD, "opad": _OPAD}, schema)


def _clients(spark, sf):
    """One client per nation: nation 0 an administrator, every tenth disabled."""
    from cloakframe.functions.digests import hmac_hex

    n = table(spark, sf, "nation")
    pads = _pads(spark)
    api_key = F.sha2(F.concat(F.lit("nation-"), "n_nationkey"), 256)
    own = F.array(F.lit("mask"), F.when(F.col("n_nationkey") % 2 == 0, "sign").otherwise("keys"))

    def grant(kid, actions):
        return F.struct(F.lit(kid).alias("kid"), actions.alias("actions"))

    wild = grant("*", F.array(F.lit("metrics")))
    admin = F.array(grant(MAIN, F.array(F.lit("mask"), F.lit("admin"))))
    plain = F.when(F.col("n_nationkey") % 3 == 0, F.array(grant(MAIN, own), wild)).otherwise(
        F.array(grant(MAIN, own))
    )
    return n.select(
        F.col("n_name").alias("client"),
        hmac_hex(utf8(api_key), pads["ipad"], pads["opad"]).alias("apikey_hash"),
        F.when(F.col("n_nationkey") % 10 == 7, "disabled").otherwise("active").alias("status"),
        F.when(F.col("n_nationkey") == 0, admin).otherwise(plain).alias("permissions"),
    )


def _authenticate(spark, sf):
    key = F.sha2(F.concat(F.lit("nation-"), F.col("c_nationkey") + F.col("c_custkey") % 3), 256)
    asked = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 17 == 0, F.lit("not hex"))
        .when(F.col("c_custkey") % 19 != 0, key)
        .alias("api_key"),
    )
    return A.authenticate(asked, _clients(spark, sf), _pads(spark))


_AUTH_SQL = f"""
with r as (select c_custkey, c_nationkey + c_custkey % 3 as n,
    case when c_custkey % 17 = 0 then 'not hex' when c_custkey % 19 <> 0
      then sha256('nation-' || (c_nationkey + c_custkey % 3)) end as api_key from customer),
  j as (select r.*, n_name, case when api_key is null then 'missing api key'
      when api_key = 'not hex' then 'malformed api key'
      when n_name is null or n % 10 = 7 then 'unknown api key' end as reason,
      {hmac_sql("api_key", _IPAD, _OPAD)} as h
    from r left join nation on n = n_nationkey)
select c_custkey, case when reason is null then n_name end as client,
  case when reason is null then h end as apikey_hash,
  case when reason is null then left(h, 8) end as fingerprint, false as root,
  reason is null and n = 0 as admin, case when reason is null then 'allow' else 'deny' end as outcome,
  reason from j
"""

_ACTIONS = ["mask", "sign", "keys", "metrics", "fly"]


def _authorize(spark, sf):
    actions = F.array(*[F.lit(a) for a in _ACTIONS])
    u = F.col("user_id")
    asked = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("NATION_"), u % 27).alias("client"),
        F.lit(False).alias("root"),
        (u % 27 == 0).alias("admin"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None))
        .when(F.col("event_id") % 7 == 1, F.lit(OLD))
        .otherwise(F.lit(MAIN))
        .alias("kid"),
        F.get(actions, (F.col("event_id") % 5).cast("int")).alias("action"),
    )
    out = A.authorize(asked, A.flatten_grants(_clients(spark, sf)))
    return out.select("event_id", "client", "action", "allowed", "kind", "reason")


_AUTHORIZE_SQL = f"""
with v as (select event_id, user_id % 27 as n, event_id % 7 as k,
    ['mask', 'sign', 'keys', 'metrics', 'fly'][event_id % 5 + 1] as action from events),
  d as (select *, n < 25 and n % 10 <> 7 as known,
    action = 'mask' or (n % 2 = 0 and action = 'sign') or (n % 2 = 1 and action = 'keys') as has,
    case when action = 'fly' then 'permission action must be one of {", ".join(C.PERMISSION_ACTIONS)}'
      end as bad from v),
  e as (select *, case when bad is not null then bad when n = 0 then null
    when not known then 'api key is not authorized'
    when action = 'metrics' then case when n % 3 <> 0
      then 'api key does not have permission for this endpoint' end
    when k = 0 then 'admin permission is required for this endpoint'
    when k = 1 or not has then 'api key does not have permission for this kid' end as reason from d)
select event_id, 'NATION_' || n as client, action, reason is null as allowed,
  case when bad is not null then 'invalid_input' when reason is not null then 'forbidden' end as kind,
  reason from e
"""


def _grants(spark, sf):
    """J-4 over one client per customer."""
    c = table(spark, sf, "customer")
    acts = F.array(F.lit("mask"), F.when(F.col("c_custkey") % 6 == 0, "admin").otherwise("sign"))
    grant = F.struct(F.lit(MAIN).alias("kid"), acts.alias("actions"))
    clients = c.select(
        F.col("c_name").alias("client"),
        F.sha2("c_name", 256).alias("apikey_hash"),
        F.when(F.col("c_custkey") % 4 == 1, "revoked").otherwise("active").alias("status"),
        F.array(grant).alias("permissions"),
    )
    return A.flatten_grants(clients)


_GRANTS_SQL = f"""
select c_name as client, sha256(c_name) as apikey_hash, true as admin, '*' as kid,
  'admin' as action from customer where c_custkey % 4 <> 1 and c_custkey % 6 = 0
union all
select c_name, sha256(c_name), false, '{MAIN}', unnest(['mask', 'sign'])
from customer where c_custkey % 4 <> 1 and c_custkey % 6 <> 0
"""

# --- J-5, J-7 -------------------------------------------------------------------------


def _routes(spark, sf):
    pol = demo_policy(spark)
    kids = F.array(F.lit(MAIN), F.lit(OLD), F.lit(_PAUSED))
    asked = table(spark, sf, "events").select(
        "event_id", F.get(kids, (F.col("user_id") % 3).cast("int")).alias("kid")
    )
    out = A.route_local(asked, pol.tables["routes"], "127.0.0.1:4000", "/default")
    return out.drop("kid")


_ROUTES_SQL = """
select event_id, ['main-app', 'old-app', 'default-final-app'][user_id % 3 + 1] as route_name,
  ['127.0.0.1:3999', '127.0.0.1:3998', '127.0.0.1:4000'][user_id % 3 + 1] as final_app_addr,
  ['/message', '/archive', '/default'][user_id % 3 + 1] as final_app_path from events
"""


def _remote(spark, sf):
    pol = demo_policy(spark)
    to = F.array(*[F.lit(kid_of(k)) for k in ["next", "gone", "leaked", "paused"]])
    sender = F.array(F.lit(MAIN), F.lit(_PAUSED))
    asked = table(spark, sf, "events").select(
        "event_id",
        F.get(sender, (F.col("event_id") % 2).cast("int")).alias("sender_kid"),
        F.get(to, (F.col("user_id") % 4).cast("int")).alias("recipient_kid"),
    )
    out = A.route_remote(asked, pol.tables["remote_routes"])
    return message(out).select("event_id", "remote_addr", "message")


_REMOTE_SQL = """
select event_id, case user_id % 4 when 0 then case when event_id % 2 = 0
      then 'partner.example:443' end when 1 then 'open.example:443' end as remote_addr,
  case user_id % 4 when 0 then case when event_id % 2 = 1
      then 'sender kid is not allowed for recipient route' end
    when 2 then 'recipient route is disabled' when 3 then 'recipient route not found' end as message
from events
"""

# --- SRC-2, A-2, A-6, J-8 over policies made from the tables --------------------------


def _policies(spark, sf):
    """One policy document per customer: a mac profile, a route and a client."""
    c = table(spark, sf, "customer")
    kid = F.when(F.col("c_custkey") % 5 == 0, F.sha2("c_name", 256)).otherwise(F.lit(MAIN))
    mac = F.struct(
        F.concat(F.lit("p-"), F.col("c_custkey") % 100).alias("name"),
        kid.alias("kid"),
        F.concat(F.lit("seg="), "c_mktsegment").alias("context"),
    )
    client = F.struct(
        F.col("c_name").alias("client"),
        F.sha2("c_name", 256).alias("apikey_hash"),
        F.lit("active").alias("status"),
        F.array(
            F.struct(F.lit(MAIN).alias("kid"), F.array(F.lit("mask")).alias("actions"))
        ).alias("permissions"),
    )
    text = F.to_json(
        F.struct(
            F.lit("v1").alias("version"),
            F.array(mac).alias("mac_profiles"),
            F.array(client).alias("permissions"),
        )
    )
    return parse_policy(c.select("c_custkey", text.alias("doc")), "doc")


def _read_policies(spark, sf):
    parts = split_policy(_policies(spark, sf), ("c_custkey",))
    grants = parts["permissions"].select("c_custkey", "client", F.explode("permissions").alias("g"))
    macs = parts["mac_profiles"].select("c_custkey", "name", "kid", "context")
    return macs.join(
        grants.select("c_custkey", "client", F.col("g.actions")[0].alias("action")), "c_custkey"
    )


_POLICIES_SQL = f"""
select c_custkey, 'p-' || (c_custkey % 100) as name,
  case when c_custkey % 5 = 0 then sha256(c_name) else '{MAIN}' end as kid,
  'seg=' || c_mktsegment as context, c_name as client, 'mask' as action from customer
"""


def _duplicates(spark, sf):
    return C.duplicate_names(split_policy(_parsed_once(spark, sf))).drop("scope")


_DUPLICATES_SQL = """
select 'mac_profiles' as section, 'name' as field, 'p-' || (c_custkey % 100) as value,
  count(*) as n from customer group by all having count(*) > 1
"""


def _parsed_once(spark, sf):
    """All documents parsed and stored, because every section reads them."""
    return cut_lineage(_policies(spark, sf))


def _dangling(spark, sf):
    return C.dangling_kids(split_policy(_parsed_once(spark, sf)), demo_policy(spark).key_frame())


_DANGLING_SQL = """
select sha256(c_name) as kid, 'mac_profiles' as section, 'p-' || (c_custkey % 100) as name
from customer where c_custkey % 5 = 0
"""


def _gauges(spark, sf):
    return C.policy_gauges(split_policy(_parsed_once(spark, sf)))


_GAUGES_SQL = """
select unnest(['routes', 'remote_routes', 'permissions', 'fpe_profiles', 'tokenization_profiles',
  'mac_profiles', 'masking_profiles', 'commitment_profiles', 'sharing_profiles']) as section,
  unnest([0, 0, n, 0, 0, n, 0, 0, 0]) as n from (select count(*) as n from customer)
"""

# --- J-11, L-2 ------------------------------------------------------------------------


def _bindings(spark, sf):
    c = table(spark, sf, "customer")
    body = to_base64(F.unhex(F.sha2("c_name", 256)))
    nonce = to_base64(F.unhex(F.left(F.sha2("c_name", 224), F.lit(24))))
    kid = F.when(F.col("c_custkey") % 4 == 0, F.sha2("c_name", 256)).otherwise(F.sha2(body, 256))
    host = F.when(F.col("c_custkey") % 4 == 1, "b").otherwise("a")

    def envelope(label):
        return F.concat_ws(".", body, nonce, to_base64(utf8(label)))

    common = [("tag", F.col("c_mktsegment")), ("timestamp", F.lit("1")), ("version", F.lit("v1"))]
    keys_label = aad([*common, ("hostname", F.lit("a"))])
    props_label = aad([("kid", kid), *common, ("hostname", host)])
    rows = c.select(
        "c_custkey",
        kid.alias("kid"),
        envelope(keys_label).alias("keys"),
        envelope(props_label).alias("properties"),
    )
    return message(A.check_key_binding(rows, "SHA-256")).select("c_custkey", "message")


_BINDINGS_SQL = """
select c_custkey, case c_custkey % 4 when 0 then 'kid does not match keys payload'
  when 1 then 'keys.aad.hostname does not match expected value' end as message from customer
"""

# --- W-3, W-4, S-3 --------------------------------------------------------------------

_LIFECYCLE = ["active", "disabled", "disabled", "active", "retired"]


def _lifecycle_events(spark, sf):
    statuses = F.array(*[F.lit(s) for s in _LIFECYCLE])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("kid"),
        F.col("event_id"),
        F.get(statuses, (F.floor("value") % 5).cast("int")).alias("status"),
    )


def _transitions(spark, sf):
    return A.verify_transitions(_lifecycle_events(spark, sf), ["event_id"])


# The fold in SQL: state before an event is the last toggle, until the first accepted retirement.
_FOLD_SQL = """
with e as (select user_id as kid, event_id,
    ['active', 'disabled', 'disabled', 'active', 'retired'][cast(floor(value) as bigint) % 5 + 1]
      as status from events),
  t as (select *, coalesce(last_value(case when status <> 'retired' then status end ignore nulls)
      over (partition by kid order by event_id rows between unbounded preceding and 1 preceding),
      'active') as toggle from e),
  d as (select kid, min(event_id) as ends from t where status = 'retired' and toggle = 'active'
    group by kid),
  s as (select t.*, case when t.event_id > d.ends then 'retired' else toggle end as current
    from t left join d using (kid)),
  f as (select kid, event_id, status, current,
    (current = 'active' and status in ('disabled', 'retired')) or
    (current = 'disabled' and status = 'active') as accepted from s)
"""
_TRANSITIONS_SQL = _FOLD_SQL + """
select *, case when not accepted then 'invalid lifecycle transition: ' || current || ' -> '
  || status end as message from f
"""


def _current(spark, sf):
    return A.current_lifecycle(_transitions(spark, sf), ["event_id"])


_CURRENT_SQL = _FOLD_SQL + """
select kid, coalesce(arg_max(status, event_id) filter (accepted), 'active') as status,
  max(event_id) filter (accepted) as event_id from f group by kid
"""


def _cas(spark, sf):
    """S-3: every order tries to change its customer's segment, expecting FURNITURE."""
    keys = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("value"))
    updates = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.lit("FURNITURE").alias("expected"),
        F.concat(F.lit("order-"), "o_orderkey").alias("new"),
        F.col("o_orderkey").alias("pos"),
    )
    rows, outcomes = A.compare_and_set(keys, updates, "c_custkey", "value")
    counted = outcomes.groupBy("c_custkey").agg(
        F.count_if(F.col("outcome") == "updated").alias("updated"),
        F.count_if(F.col("outcome") == "key changed concurrently").alias("lost"),
    )
    return rows.join(counted, "c_custkey", "left")


_CAS_SQL = """
with o as (select o_custkey as k, min(o_orderkey) as first, count(*) as n from orders group by 1)
select c_custkey, case when n is not null and c_mktsegment = 'FURNITURE' then 'order-' || first
    else c_mktsegment end as value,
  case when n is not null then case when c_mktsegment = 'FURNITURE' then 1 else 0 end end as updated,
  case when c_mktsegment = 'FURNITURE' then n - 1 else n end as lost
from customer left join o on k = c_custkey
"""


ENTRIES = {
    "resolve_profile": Entry("J-1 P-12", _resolve, _RESOLVE_SQL),
    "authenticate": Entry("J-2 J-4 F-7", _authenticate, _AUTH_SQL),
    "authorize": Entry("J-3 J-4", _authorize, _AUTHORIZE_SQL),
    "flatten_grants": Entry("J-4", _grants, _GRANTS_SQL),
    "route_local": Entry("J-5", _routes, _ROUTES_SQL),
    "route_remote": Entry("J-7", _remote, _REMOTE_SQL),
    "policy_documents": Entry("SRC-2", _read_policies, _POLICIES_SQL),
    "duplicate_names": Entry("A-2", _duplicates, _DUPLICATES_SQL),
    "dangling_kids": Entry("J-8", _dangling, _DANGLING_SQL),
    "policy_gauges": Entry("A-6", _gauges, _GAUGES_SQL),
    "key_bindings": Entry("J-11", _bindings, _BINDINGS_SQL),
    "lifecycle_transitions": Entry("W-3", _transitions, _TRANSITIONS_SQL),
    "current_lifecycle": Entry("W-4", _current, _CURRENT_SQL),
    "compare_and_set": Entry("S-3", _cas, _CAS_SQL),
}
