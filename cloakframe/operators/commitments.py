"""X-6, X-7: hiding commitments to values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import hmac_hex, keyed_random
from cloakframe.functions.text import (
    base64url_ok,
    base64url_size,
    error_when,
    first_error,
    object_json,
    to_base64url,
    utf8,
)
from cloakframe.plans.jobs import finish, lifecycle_error, require_unique_refs
from cloakframe.plans.policy import Policy


def commitment_column(plain: Column, opening: Column, profile: Column, alg: str) -> Column:
    """Tag over canonical JSON of everything the commitment is bound to."""
    payload = object_json(
        {
            "kid": profile["kid"],
            "opening": opening,
            "plaintext": plain,
            "profile": profile["name"],
            "version": F.lit("v1"),
        }
    )
    return hmac_hex(utf8(payload), profile["ipad"], profile["opad"], alg)


def commit_plain_error(col: str, profile: Column, use: str) -> Column:
    return first_error(
        lifecycle_error(profile["key_status"], use),
        P.text_error("plaintext", col),
        error_when(
            F.char_length(F.col(col)) > profile["max_plaintext_len"],
            "invalid_input",
            "plaintext exceeds commitment profile maximum length",
        ),
    )


def commit(
    df: DataFrame,
    col: str,
    profile: str,
    policy: Policy,
    ref: str,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Adds ``opening`` and ``commitment``; equal values under different refs differ."""
    require_unique_refs(df, ref)
    spec, secret = policy.profile("commit", profile), policy.column("commit", profile)
    run = policy.random_column()
    raw = keyed_random(run, f"opening|{profile}|{col}", spec["opening_len"], ref, col)
    opening = to_base64url(raw)
    problem = first_error(P.ref_error(F.col(ref).cast("string")), commit_plain_error(col, secret, "new"))
    made = df.withColumn("opening", opening)
    outputs = {
        "opening": F.col("opening"),
        "commitment": commitment_column(
            F.col(col), F.col("opening"), secret, spec["algorithm"]
        ),
    }
    return finish(made, outputs, problem, on_error, pos)


def verify_commitment(
    df: DataFrame,
    value: str,
    opening: str,
    commitment: str,
    profile: str,
    policy: Policy,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Adds ``valid``. A malformed opening is an error, a wrong one is ``valid = false``."""
    spec, secret = policy.profile("commit", profile), policy.column("commit", profile)
    problem = first_error(
        commit_plain_error(value, secret, "verify"),
        error_when(
            ~base64url_ok(opening),
            "invalid_input",
            "opening contains invalid commitment encoding",
        ),
        error_when(
            base64url_size(opening) != spec["opening_len"],
            "invalid_input",
            "opening length does not match commitment profile",
        ),
        P.hash_hex_error("commitment", commitment, spec["algorithm"]),
    )
    expected = commitment_column(F.col(value), F.col(opening), secret, spec["algorithm"])
    return finish(
        df, {"valid": expected == F.lower(F.col(commitment))}, problem, on_error, pos
    )
