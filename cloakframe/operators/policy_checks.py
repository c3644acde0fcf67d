"""P-13, A-2, J-8, A-6: rules over policy tables.

A policy is bounded by the size limit of its document; frames made from many policies work too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.text import error_when, first_error

# Bounds of the profile fields.
MASK_MAX_LEN = 1024
FPE_VERSION = "fpe-ff1-2025"
FPE_MIN_LEN = 6
FPE_MAX_LEN = 1024
FPE_MIN_DOMAIN = 1_000_000
FPE_MAX_RADIX = 65_536
TOKEN_MIN_BYTES = 32
TOKEN_PREFIX_MAX_CHARS = 16
TOKEN_PLAINTEXT_MAX = 1024
COMMIT_PLAINTEXT_MAX = 1024
OPENING_MIN_BYTES = 32
OPENING_MAX_BYTES = 64
SHARE_MIN_THRESHOLD = 2
SHARE_MAX = 32
SECRET_MAX_BYTES = 4096

# Permission actions; the global ones need a wildcard grant.
PERMISSION_ACTIONS = [
    "admin",
    "keys",
    "lifecycle",
    "self-test",
    "sign",
    "message",
    "fpe-encrypt",
    "fpe-decrypt",
    "token-encode",
    "token-decode",
    "mac-create",
    "mac-verify",
    "index-create",
    "index-verify",
    "mask",
    "commit-create",
    "commit-verify",
    "share-split",
    "share-combine",
    "time-attest",
    "metrics",
]
GLOBAL_ACTIONS = ["metrics", "time-attest"]
CLIENT_STATUSES = ["active", "disabled", "revoked"]
ROUTE_STATUSES = ["active", "disabled"]
KID_HASH = "BLAKE2b(256)"


def _need(ok: Column, message: str) -> Column:
    return error_when(~ok, "invalid_input", message)


def _kid(section: str) -> Column:
    return P.hash_hex_error(f"{section}.kid", "kid", KID_HASH)


def mask_profile_error() -> Column:
    s, c = "masking_profiles", F.col
    return first_error(
        P.name_error(f"{s}.name", "name"),
        _kid(s),
        P.text_error(f"{s}.mask_char", "mask_char"),
        _need(F.char_length("mask_char") == 1, f"{s}.mask_char must be exactly one character"),
        _need(c("min_len") >= 1, f"{s}.min_len must be at least 1"),
        _need(c("max_len") <= MASK_MAX_LEN, f"{s}.max_len exceeds maximum allowed value"),
        _need(
            c("max_len") >= c("min_len"),
            f"{s}.max_len must be greater than or equal to min_len",
        ),
        _need(
            (c("visible_first") <= c("max_len")) & (c("visible_last") <= c("max_len")),
            f"{s}.visible_first and visible_last must not exceed max_len",
        ),
        _need(
            c("visible_first") + c("visible_last") < c("min_len"),
            f"{s}.visible_first plus visible_last must be less than min_len",
        ),
    )


def _symbols(c: str) -> Column:
    return F.filter(F.split(F.col(c), ""), lambda x: x != "")


def fpe_profile_error() -> Column:
    s, c = "fpe_profiles", F.col
    radix = F.char_length("alphabet")
    return first_error(
        P.name_error(f"{s}.name", "name"),
        P.allowed_error(f"{s}.fpe_version", "fpe_version", [FPE_VERSION]),
        P.text_error(f"{s}.alphabet", "alphabet"),
        _need(
            F.size(F.array_distinct(_symbols("alphabet"))) == radix,
            f"{s}.alphabet must not contain duplicate characters",
        ),
        _need(
            radix.between(2, FPE_MAX_RADIX),
            f"{s}.alphabet length must be between 2 and {FPE_MAX_RADIX}",
        ),
        _need(c("min_len") >= FPE_MIN_LEN, f"{s}.min_len must be at least {FPE_MIN_LEN}"),
        _need(c("max_len") <= FPE_MAX_LEN, f"{s}.max_len exceeds maximum allowed value"),
        _need(
            c("max_len") >= c("min_len"),
            f"{s}.max_len must be greater than or equal to min_len",
        ),
        _need(
            F.pow(radix.cast("double"), F.least(c("min_len"), F.lit(20))) >= FPE_MIN_DOMAIN,
            "fpe profile domain is too small for FF1",
        ),
        P.labels_error(f"{s}.tweak_aad", "tweak_aad"),
    )


def token_profile_error() -> Column:
    s, c = "tokenization_profiles", F.col
    return first_error(
        P.name_error(f"{s}.name", "name"),
        P.bounded_text_error(f"{s}.token_prefix", "token_prefix", TOKEN_PREFIX_MAX_CHARS),
        _need(
            ~c("token_prefix").rlike("(?U)\\s"), f"{s}.token_prefix must not contain whitespace"
        ),
        _need(
            P.no_delimiters("token_prefix"), f"{s}.token_prefix must not contain ';' or '='"
        ),
        _need(
            c("token_len") >= TOKEN_MIN_BYTES, f"{s}.token_len must be at least {TOKEN_MIN_BYTES}"
        ),
        _need(
            c("max_plaintext_len").between(1, TOKEN_PLAINTEXT_MAX),
            f"{s}.max_plaintext_len must be between 1 and {TOKEN_PLAINTEXT_MAX}",
        ),
    )


def mac_profile_error() -> Column:
    s = "mac_profiles"
    return first_error(
        P.name_error(f"{s}.name", "name"), P.labels_error(f"{s}.context", "context")
    )


def commit_profile_error() -> Column:
    s, c = "commitment_profiles", F.col
    return first_error(
        P.name_error(f"{s}.name", "name"),
        P.labels_error(f"{s}.context", "context"),
        _need(c("max_plaintext_len") >= 1, f"{s}.max_plaintext_len must be at least 1"),
        _need(
            c("max_plaintext_len") <= COMMIT_PLAINTEXT_MAX,
            f"{s}.max_plaintext_len exceeds maximum allowed value: {COMMIT_PLAINTEXT_MAX}",
        ),
        _need(
            c("opening_len") >= OPENING_MIN_BYTES,
            f"{s}.opening_len must be at least {OPENING_MIN_BYTES}",
        ),
        _need(
            c("opening_len") <= OPENING_MAX_BYTES,
            f"{s}.opening_len exceeds maximum allowed value: {OPENING_MAX_BYTES}",
        ),
    )


def share_profile_error() -> Column:
    s, c = "sharing_profiles", F.col
    return first_error(
        P.name_error(f"{s}.name", "name"),
        P.labels_error(f"{s}.context", "context"),
        _need(
            c("threshold") >= SHARE_MIN_THRESHOLD,
            f"{s}.threshold must be at least {SHARE_MIN_THRESHOLD}",
        ),
        _need(
            c("shares") <= SHARE_MAX, f"{s}.shares exceeds maximum allowed value: {SHARE_MAX}"
        ),
        _need(
            c("threshold") <= c("shares"), f"{s}.threshold must be less than or equal to shares"
        ),
        _need(c("max_secret_len") >= 1, f"{s}.max_secret_len must be at least 1"),
        _need(
            c("max_secret_len") <= SECRET_MAX_BYTES,
            f"{s}.max_secret_len exceeds maximum allowed value: {SECRET_MAX_BYTES}",
        ),
    )


def route_error() -> Column:
    return first_error(
        P.hash_hex_error("routes.kid", "kid", KID_HASH),
        P.bounded_text_error("routes.name", "name", P.NAME_MAX_CHARS),
    )


def remote_route_error() -> Column:
    s = "remote_routes"
    return first_error(
        P.hash_hex_error(f"{s}.remote_kid", "remote_kid", KID_HASH),
        P.bounded_text_error(f"{s}.name", "name", P.NAME_MAX_CHARS),
        P.allowed_error(f"{s}.status", "status", ROUTE_STATUSES),
    )


def client_error() -> Column:
    s = "permissions"
    actions = F.flatten(F.transform(F.col("permissions"), lambda p: p["actions"]))
    wild = F.filter(F.col("permissions"), lambda p: p["kid"] == "*")
    wild_actions = F.flatten(F.transform(wild, lambda p: p["actions"]))
    bad_wild = F.get(F.filter(wild_actions, lambda a: ~a.isin(*GLOBAL_ACTIONS)), F.lit(0))
    admin = F.array_contains(actions, "admin")
    return first_error(
        P.bounded_text_error(f"{s}.client", "client", P.NAME_MAX_CHARS),
        P.hash_hex_error(f"{s}.apikey_hash", "apikey_hash", KID_HASH),
        P.allowed_error(f"{s}.status", "status", CLIENT_STATUSES),
        _need(
            F.forall("permissions", lambda p: F.size(p["actions"]) > 0),
            f"{s}.actions must not be empty",
        ),
        _need(
            F.forall(actions, lambda a: a.isin(*PERMISSION_ACTIONS)),
            f"{s}.actions must be one of {', '.join(PERMISSION_ACTIONS)}",
        ),
        error_when(
            ~admin & bad_wild.isNotNull(),
            "invalid_input",
            F.concat(F.lit("permission action "), bad_wild, F.lit(" cannot use wildcard kid")),
        ),
    )


PROFILE_ERRORS = {
    "routes": route_error,
    "remote_routes": remote_route_error,
    "permissions": client_error,
    "fpe_profiles": fpe_profile_error,
    "tokenization_profiles": token_profile_error,
    "mac_profiles": mac_profile_error,
    "masking_profiles": mask_profile_error,
    "commitment_profiles": commit_profile_error,
    "sharing_profiles": share_profile_error,
}


def section_errors(section: str, frame: DataFrame) -> DataFrame:
    """P-13: the frame with an ``error`` column holding the first broken bound."""
    return frame.withColumn("error", PROFILE_ERRORS[section]())


# What must be unique in each section.
UNIQUE_FIELDS = {
    "routes": ["kid", "name"],
    "remote_routes": ["remote_kid", "name"],
    "permissions": ["client", "apikey_hash"],
    "fpe_profiles": ["name"],
    "tokenization_profiles": ["name"],
    "mac_profiles": ["name"],
    "masking_profiles": ["name"],
    "commitment_profiles": ["name"],
    "sharing_profiles": ["name"],
}


def duplicate_names(policy: dict[str, DataFrame]) -> DataFrame:
    """A-2: every value used twice within its scope: ``(section, field, scope, value, n)``.

    All fields of all sections go through one aggregate.
    """

    def values(frame: DataFrame, section: str, field: str, scope: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"),
            F.lit(field).alias("field"),
            scope.alias("scope"),
            F.col(field).alias("value"),
        )

    parts = [
        values(policy[section], section, field, F.lit(""))
        for section, fields in UNIQUE_FIELDS.items()
        for field in fields
    ]
    grants = policy["permissions"].select("client", F.explode("permissions").alias("p"))
    grants = grants.select("client", F.col("p.kid").alias("kid"), F.col("p.actions").alias("acts"))
    parts.append(values(grants, "permissions", "kid", F.col("client")))
    actions = grants.select("client", "kid", F.explode("acts").alias("action"))
    parts.append(values(actions, "permissions", "action", F.concat_ws("/", "client", "kid")))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("section", "field", "scope", "value")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def referenced_kids(policy: dict[str, DataFrame]) -> DataFrame:
    """Every key name used by the policy: ``(section, name, kid)``."""
    rows = []
    for section, frame in policy.items():
        if section == "remote_routes":
            part = frame.select("name", F.explode("allowed_local_kids").alias("kid"))
        elif section == "permissions":
            part = frame.filter("status = 'active'").select(
                F.col("client").alias("name"),
                F.explode(F.transform("permissions", lambda p: p["kid"])).alias("kid"),
            )
        else:
            part = frame.select("name", "kid")
        rows.append(
            part.filter("kid <> '*'").select(F.lit(section).alias("section"), "name", "kid")
        )
    return reduce(DataFrame.unionByName, rows)


def dangling_kids(policy: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """J-8: policy rows naming a key that is not loaded."""
    return referenced_kids(policy).join(keys.select("kid"), "kid", "left_anti")


def policy_gauges(policy: dict[str, DataFrame]) -> DataFrame:
    """A-6: rows loaded per policy section."""
    parts = [
        frame.agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "n")
        for section, frame in policy.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def policy_errors(policy: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """All reasons a policy is refused: ``(rank, pos, section, message)``, lowest rank first.

    Bounds of the sections rank first, then repeated names, then keys that are not loaded.
    """
    parts = []
    for rank, (section, frame) in enumerate(policy.items()):
        bad = section_errors(section, frame).filter("error is not null")
        parts.append(_ranked(bad, rank, section, F.col("pos"), F.col("error.message")))
    text = F.concat(F.lit("duplicated "), "field", F.lit(": "), "value")
    parts.append(_ranked(duplicate_names(policy), 100, None, F.lit(0), text))
    text = F.concat(F.lit("references kid not loaded: "), "kid")
    parts.append(_ranked(dangling_kids(policy, keys), 200, None, F.lit(0), text))
    return reduce(DataFrame.unionByName, parts)


def _ranked(
    frame: DataFrame, rank: int, section: str | None, pos: Column, message: Column
) -> DataFrame:
    return frame.select(
        F.lit(rank).alias("rank"),
        pos.cast("long").alias("pos"),
        (F.lit(section) if section else F.col("section")).alias("section"),
        message.alias("message"),
    )


def first_policy_error(policy: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """The reason a policy is refused, or one row of NULLs."""
    found = policy_errors(policy, keys)
    first = F.min(F.struct("rank", "pos", "section", "message"))
    return found.agg(first.alias("f")).select("f.section", "f.message")
