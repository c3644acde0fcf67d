"""J-1 .. J-5, J-7, J-11, W-3, W-4, S-3, L-2: who may use which key, and where results go.

Policy tables are held by the driver with their true size, so Spark broadcasts them by its own size
check; there is no broadcast hint that a larger table could slip past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import digest_hex, hmac_hex
from cloakframe.functions.text import (
    aad_field,
    error,
    error_when,
    fingerprint,
    first_error,
    from_base64,
    utf8,
)
from cloakframe.operators.policy_checks import GLOBAL_ACTIONS, KID_HASH, PERMISSION_ACTIONS
from cloakframe.plans.jobs import lifecycle_error
from cloakframe.plans.keys import LIFECYCLE_STATUSES
from cloakframe.plans.ordering import previous_value

# Key profiles a key record may carry.
# The error texts in this module are part of its interface.
KEY_PROFILES = [
    "hybrid-performance-v1",
    "hybrid-standard-v1",
    "hybrid-high-assurance-v1",
    "hybrid-long-term-v1",
    "custom",
]

# Lifecycle transitions that are accepted.
TRANSITIONS = {
    "active": ["disabled", "retired", "compromised", "destroyed"],
    "disabled": ["active"],
}
TERMINAL = ["retired", "compromised", "destroyed"]


def key_row_error() -> Column:
    """Rules for one row of the key registry."""
    p = F.col("properties")
    return first_error(
        P.hash_hex_error("opskeys.kid", "kid", KID_HASH),
        error_when(p.isNull(), "invalid_input", "properties cannot be read"),
        P.allowed_error("properties.profile", p["profile"], KEY_PROFILES),
        P.text_error("properties.tag", p["tag"]),
        P.text_error("properties.created_at", p["created_at"]),
        P.allowed_error(
            "properties.lifecycle.status", p["lifecycle"]["status"], LIFECYCLE_STATUSES
        ),
        P.bounded_text_error(
            "properties.lifecycle.reason", p["lifecycle"]["reason"], P.REF_MAX_CHARS
        ),
        P.text_error("properties.lifecycle.changed_at", p["lifecycle"]["changed_at"]),
    )


def list_keys(keys: DataFrame) -> DataFrame:
    """L-2: ordered listing."""
    return keys.orderBy("kid")


def usable_keys(df: DataFrame, keys: DataFrame, use: str) -> DataFrame:
    """P-12: rows with a ``kid`` joined to the key registry; ``error`` says why one is blocked.

    The registry has no size bound; the join follows its actual size.
    """
    registry = keys.select("kid", F.col("status").alias("key_status"))
    joined = df.join(registry, "kid", "left")
    missing = error(
        "not_found", F.concat(F.lit("key not loaded: "), F.coalesce("kid", F.lit("")))
    )
    problem = first_error(
        F.when(F.col("key_status").isNull(), missing),
        lifecycle_error(F.col("key_status"), use),
    )
    return joined.withColumn("error", problem)


def resolve_profile(
    df: DataFrame, profiles: DataFrame, keys: DataFrame, use: str, kind: str = "masking"
) -> DataFrame:
    """J-1: request ``(kid, profile)`` to its profile and key, with the reason when refused.

    Profiles are joined to their keys first; that result is policy-sized.
    """
    packed = profiles.join(
        keys.select("kid", F.col("status").alias("key_status")), "kid", "left"
    ).select(
        F.col("name").alias("profile"),
        F.col("kid").alias("profile_kid"),
        "key_status",
    )
    joined = df.join(packed, "profile", "left")
    missing = F.concat(F.lit("key not loaded: "), F.col("profile_kid"))
    problem = first_error(
        error_when(
            F.col("profile_kid").isNull(), "invalid_input", f"{kind} profile not found"
        ),
        error_when(
            ~F.col("kid").eqNullSafe(F.col("profile_kid")),
            "forbidden",
            f"{kind} profile is not authorized for this kid",
        ),
        F.when(F.col("key_status").isNull(), error("not_found", missing)),
        lifecycle_error(F.col("key_status"), use),
    )
    return joined.withColumn("error", problem)


# --- clients and grants ---------------------------------------------------------------


def flatten_grants(clients: DataFrame) -> DataFrame:
    """J-4: ``(client, apikey_hash, admin, kid, action)`` of active clients.

    One ``admin`` action anywhere makes the client an administrator and drops its kid grants.
    """
    is_admin = F.exists("permissions", lambda p: F.array_contains(p["actions"], "admin"))
    admin_grant = F.array(
        F.struct(F.lit("*").alias("kid"), F.array(F.lit("admin")).alias("actions"))
    )
    active = clients.filter("status = 'active'").select(
        "client",
        "apikey_hash",
        is_admin.alias("admin"),
        F.when(is_admin, admin_grant).otherwise(F.col("permissions")).alias("grants"),
    )
    kids = active.select("client", "apikey_hash", "admin", F.explode_outer("grants").alias("g"))
    return kids.select(
        "client",
        "apikey_hash",
        "admin",
        F.col("g.kid").alias("kid"),
        F.explode_outer("g.actions").alias("action"),
    )


def authenticate(
    requests: DataFrame,
    clients: DataFrame,
    pads: Column,
    api_key: str = "api_key",
    root_hash: str | None = None,
) -> DataFrame:
    """J-2: presented key to client: adds ``client, apikey_hash, fingerprint, root, admin,
    outcome, reason`` and drops the key itself."""
    grants = flatten_grants(clients)
    known = grants.groupBy("apikey_hash").agg(
        F.min("client").alias("_client"), F.bool_or("admin").alias("_admin")
    )
    key = F.col(api_key)
    shaped = P.hash_hex_ok(api_key, KID_HASH)
    hashed = requests.withColumn(
        "apikey_hash", F.when(shaped, hmac_hex(utf8(F.lower(key)), pads["ipad"], pads["opad"]))
    )
    joined = hashed.join(known, "apikey_hash", "left")
    root = F.col("apikey_hash") == (root_hash or "")
    root = F.coalesce(root, F.lit(False))
    reason = (
        F.when(key.isNull(), "missing api key")
        .when(~shaped, "malformed api key")
        .when(~root & F.col("_client").isNull(), "unknown api key")
    )
    allowed = reason.isNull()
    return joined.withColumn("reason", reason).select(
        *[c for c in requests.columns if c != api_key],
        F.when(root, "root").when(allowed, F.col("_client")).alias("client"),
        F.when(allowed, F.col("apikey_hash")).alias("apikey_hash"),
        F.when(allowed, fingerprint("apikey_hash")).alias("fingerprint"),
        root.alias("root"),
        (root | F.coalesce("_admin", F.lit(False))).alias("admin"),
        F.when(F.col("reason").isNull(), "allow").otherwise("deny").alias("outcome"),
        "reason",
    )


def authorize(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """J-3: decide ``(client, kid, action)``: adds ``allowed, kind, reason``.

    ``requests`` carry ``client, root, admin, kid, action``. A global action looks for a grant
    on ``*``, any other one for its exact kid.
    """
    known = grants.groupBy("client").agg(F.lit(True).alias("_known"))
    exact = grants.select(
        "client", F.col("kid").alias("_kid"), "action", F.lit(True).alias("_granted")
    ).distinct()
    is_global = F.col("action").isin(*GLOBAL_ACTIONS)
    asked = requests.withColumn("_kid", F.when(is_global, F.lit("*")).otherwise(F.col("kid")))
    joined = asked.join(known, "client", "left").join(
        exact, ["client", "_kid", "action"], "left"
    )
    bad_kid = P.hash_hex_error("kid", "kid", KID_HASH)
    problem = first_error(
        error_when(
            ~F.coalesce(F.col("action").isin(*PERMISSION_ACTIONS), F.lit(False)),
            "invalid_input",
            f"permission action must be one of {', '.join(PERMISSION_ACTIONS)}",
        ),
        F.when(
            ~(F.col("root") | F.col("admin")),
            first_error(
                error_when(
                    F.col("_known").isNull(), "forbidden", "api key is not authorized"
                ),
                error_when(
                    is_global & F.col("_granted").isNull(),
                    "forbidden",
                    "api key does not have permission for this endpoint",
                ),
                F.when(
                    ~is_global,
                    first_error(
                        error_when(
                            F.col("kid").isNull(),
                            "forbidden",
                            "admin permission is required for this endpoint",
                        ),
                        bad_kid,
                        error_when(
                            F.col("_granted").isNull(),
                            "forbidden",
                            "api key does not have permission for this kid",
                        ),
                    ),
                ),
            ),
        ),
    )
    decided = joined.withColumn("_e", problem)
    return decided.select(
        *requests.columns,
        F.col("_e").isNull().alias("allowed"),
        F.col("_e.kind").alias("kind"),
        F.col("_e.message").alias("reason"),
    )


# --- routes ---------------------------------------------------------------------------


def route_local(
    df: DataFrame, routes: DataFrame, default_addr: str, default_path: str
) -> DataFrame:
    """J-5: the first route with this kid, else the named default."""
    first = routes.groupBy("kid").agg(
        F.min(F.struct("pos", "name", "final_app_addr", "final_app_path")).alias("_r")
    )
    joined = df.join(first, "kid", "left")
    return joined.select(
        *df.columns,
        F.coalesce("_r.name", F.lit("default-final-app")).alias("route_name"),
        F.coalesce("_r.final_app_addr", F.lit(default_addr)).alias("final_app_addr"),
        F.coalesce("_r.final_app_path", F.lit(default_path)).alias("final_app_path"),
    )


def route_remote(df: DataFrame, remote_routes: DataFrame) -> DataFrame:
    """J-7: recipient to remote address; each way of being refused has its own error."""
    table = remote_routes.select(
        F.col("remote_kid").alias("recipient_kid"),
        "remote_addr",
        "allowed_local_kids",
        F.col("status").alias("_status"),
    )
    joined = df.join(table, "recipient_kid", "left")
    allowed = F.array_contains("allowed_local_kids", F.col("sender_kid")) | F.array_contains(
        "allowed_local_kids", F.lit("*")
    )
    problem = first_error(
        error_when(F.col("_status").isNull(), "not_found", "recipient route not found"),
        error_when(F.col("_status") != "active", "forbidden", "recipient route is disabled"),
        error_when(
            ~F.coalesce(allowed, F.lit(False)),
            "forbidden",
            "sender kid is not allowed for recipient route",
        ),
    )
    out = joined.withColumn("error", problem)
    return out.select(
        *df.columns,
        F.when(F.col("error").isNull(), F.col("remote_addr")).alias("remote_addr"),
        "error",
    )


# --- key records ----------------------------------------------------------------------


def check_key_binding(keys: DataFrame, alg: str = KID_HASH) -> DataFrame:
    """J-11: the kid is the digest of the stored ciphertext and both labels agree.

    Rows: ``kid, keys, properties`` with three-part envelopes; adds ``error``.
    """

    def label(c: str) -> Column:
        return from_base64(F.get(F.split(F.col(c), "\\."), F.lit(2))).cast("string")

    cipher_text = F.get(F.split(F.col("keys"), "\\."), F.lit(0))
    made = keys.withColumns(
        {
            "_kid": digest_hex(utf8(cipher_text), alg),
            "_ka": label("keys"),
            "_pa": label("properties"),
        }
    )
    checks = [
        P.envelope_error("opskeys.keys", "keys"),
        P.envelope_error("opskeys.properties", "properties"),
        error_when(
            F.col("kid") != F.col("_kid"), "invalid_input", "kid does not match keys payload"
        ),
        error_when(
            ~F.col("kid").eqNullSafe(aad_field("_pa", "kid")),
            "invalid_input",
            "properties.aad.kid does not match expected value",
        ),
    ]
    for field in ["tag", "timestamp", "version", "hostname"]:
        checks.append(
            error_when(
                ~aad_field("_ka", field).eqNullSafe(aad_field("_pa", field)),
                "invalid_input",
                f"keys.aad.{field} does not match expected value",
            )
        )
    return made.withColumn("error", first_error(*checks)).drop("_kid", "_ka", "_pa")


# --- lifecycle ------------------------------------------------------------------------


def verify_transitions(events: DataFrame, order: list[str]) -> DataFrame:
    """W-3: ``current`` status before each event, whether it was ``accepted``, and the reason.

    Keys start active, and a refused event changes nothing, which makes this a fold. It needs
    no fold to compute: after an ``active`` or ``disabled`` event the key is in that status
    whether or not the event was accepted (as long as it is not in a terminal status), and the
    key ends with its first terminal event that finds it active.
    """
    status = F.col("status")
    toggle = F.when(status.isin("active", "disabled"), status)
    seen = previous_value(events, ["kid"], order, toggle, "_toggle")
    seen = seen.withColumn("_toggle", F.coalesce("_toggle", F.lit("active")))
    ending = status.isin(*TERMINAL) & (F.col("_toggle") == "active")
    at = F.struct(*[F.col(c) for c in order])
    death = seen.groupBy(F.col("kid").alias("_kid")).agg(
        F.min(F.when(ending, F.struct(*[F.col(c) for c in order], status))).alias("_end")
    )
    death = death.filter(F.col("_end").isNotNull())
    joined = seen.join(death, F.col("kid") == F.col("_kid"), "left")
    ended = F.struct(*[F.col(f"_end.{c}").alias(c) for c in order])
    dead = F.when(F.col("_end").isNotNull() & (at > ended), F.col("_end.status"))
    made = joined.withColumn("current", F.coalesce(dead, F.col("_toggle")))
    accepted = F.lit(False)
    for before, after in TRANSITIONS.items():
        accepted = accepted | ((F.col("current") == before) & status.isin(*after))
    made = made.withColumn("accepted", accepted)
    reason = F.concat(
        F.lit("invalid lifecycle transition: "), F.col("current"), F.lit(" -> "), status
    )
    return made.select(
        *events.columns,
        "current",
        "accepted",
        F.when(~F.col("accepted"), reason).alias("message"),
    )


def current_lifecycle(checked: DataFrame, order: list[str]) -> DataFrame:
    """W-4: latest accepted status per key (``active`` when nothing was accepted).

    Takes the output of ``verify_transitions``; ``max`` over a struct combines in each task.
    """
    latest = F.max(
        F.when(F.col("accepted"), F.struct(*[F.col(c) for c in order], F.col("status")))
    )
    return checked.groupBy("kid").agg(latest.alias("_l")).select(
        "kid",
        F.coalesce("_l.status", F.lit("active")).alias("status"),
        *[F.col(f"_l.{c}").alias(c) for c in order],
    )


def compare_and_set(
    keys: DataFrame, updates: DataFrame, key: str = "kid", value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """S-3: ``(new rows, outcome per update)``.

    ``updates`` carry ``key, expected, new, pos``. All of them compare with the present value;
    when several match, the earliest wins and the others changed concurrently.
    """
    present = keys.select(F.col(key), F.col(value).alias("_now"), F.lit(True).alias("_there"))
    judged = updates.join(present, key, "left").withColumn(
        "_match", F.col("_there").isNotNull() & F.col("_now").eqNullSafe(F.col("expected"))
    )
    winners = (
        judged.filter("_match")
        .groupBy(key)
        .agg(F.min(F.struct("pos", "new")).alias("_w"))
    )
    renamed = winners.select(F.col(key).alias("_key"), "_w")
    outcome = (
        F.when(F.col("_there").isNull(), "key not found")
        .when(F.col("_match") & (F.col("pos") == F.col("_w.pos")), "updated")
        .otherwise("key changed concurrently")
    )
    outcomes = judged.join(renamed, F.col(key) == F.col("_key"), "left").select(
        *updates.columns, outcome.alias("outcome")
    )
    rows = keys.join(renamed, F.col(key) == F.col("_key"), "left").select(
        *[
            F.when(F.col("_w").isNotNull(), F.col("_w.new")).otherwise(F.col(c)).alias(c)
            if c == value
            else F.col(c)
            for c in keys.columns
        ]
    )
    return rows, outcomes
