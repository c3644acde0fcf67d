"""X-8, X-9, X-10: authenticated encryption of a column, and moving it to another key."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import keyed_random
from cloakframe.functions.gcm import NONCE_BYTES, gcm_decrypt, gcm_encrypt
from cloakframe.functions.text import (
    aad,
    aad_field,
    error_when,
    first_error,
    from_utf8,
    to_hex,
    utf8,
)
from cloakframe.plans.jobs import compute_once, finish, lifecycle_error, require_unique_refs
from cloakframe.plans.policy import Policy

AUTH_FAILED = "message authentication failed"


def _now() -> str:
    return str(int(time.time()))


def _record_aad(kid: Column, timestamp: Column, cipher: Column) -> Column:
    return aad(
        [
            ("version", F.lit("v1")),
            ("type", F.lit("record")),
            ("kid", kid),
            ("timestamp", timestamp),
            ("cipher_alg", cipher),
        ]
    )


def _moved_aad(source: Column, source_time: Column, kid: Column, ts: Column, cipher: Column):
    return aad(
        [
            ("version", F.lit("v1")),
            ("type", F.lit("moved-record")),
            ("sender_kid", source),
            ("source_created_at", source_time),
            ("kid", kid),
            ("timestamp", ts),
            ("cipher_alg", cipher),
        ]
    )


def _seal(plain: Column, secret: Column, nonce: Column, label: Column, ts: Column) -> Column:
    return F.struct(
        to_hex(gcm_encrypt(utf8(plain), secret["key"], nonce, utf8(label))).alias("ctx"),
        to_hex(nonce).alias("nonce"),
        label.alias("aad"),
        secret["cipher_alg"].alias("variant"),
        secret["kid"].alias("kid"),
        ts.alias("timestamp"),
    )


def record_label(kid: str, policy: Policy, ts: Column) -> Column:
    secret = policy.cipher_column(kid)
    return _record_aad(secret["kid"], ts, secret["cipher_alg"])


def record_nonce(col: str, kid: str, policy: Policy, ref: str, label: Column) -> Column:
    return keyed_random(policy.random_column(), f"record|{kid}|{col}", NONCE_BYTES, ref, col, label)


def sealed_record(col: str, kid: str, policy: Policy, nonce: Column, label: Column, ts: Column) -> Column:
    return _seal(F.col(col), policy.cipher_column(kid), nonce, label, ts)


def record_errors(col: str, kid: str, policy: Policy) -> list[Column]:
    return [lifecycle_error(policy.cipher_column(kid)["key_status"], "new"), P.text_error("plaintext", col)]


def encrypt_column(
    df: DataFrame,
    col: str,
    kid: str,
    policy: Policy,
    ref: str,
    as_col: str = "sealed",
    timestamp: str | None = None,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """AES-GCM into ``struct<ctx, nonce, aad, variant, kid, timestamp>``.

    The nonce depends on the run key, the column, the ref, the value and the label, that is on
    all that is sealed: recomputing a task repeats it, and no two inputs share one. A ref used
    twice refuses the frame.
    """
    require_unique_refs(df, ref)
    secret, run = policy.cipher_column(kid), policy.random_column()
    ts = F.lit(timestamp or _now())
    label = _record_aad(secret["kid"], ts, secret["cipher_alg"])
    made = df.withColumn(
        "_nonce", keyed_random(run, f"record|{kid}|{col}", NONCE_BYTES, ref, col, label)
    )
    problem = first_error(
        lifecycle_error(secret["key_status"], "new"), P.text_error("plaintext", col)
    )
    sealed = _seal(F.col(col), secret, F.col("_nonce"), label, ts)
    return _drop(finish(made, {as_col: sealed}, problem, on_error, pos), "_nonce")


def _drop(done, *names: str):
    if isinstance(done, tuple):
        return tuple(f.drop(*names) for f in done)
    return done.drop(*names)


def _open_error(sealed: Column, secret: Column) -> Column:
    """Label fields must equal row fields before anything is opened."""
    label = sealed["aad"]
    checks = [
        lifecycle_error(secret["key_status"], "verify"),
        P.aad_error(label),
    ]
    for field in ["kid", "timestamp", "cipher_alg"]:
        checks.append(
            error_when(
                label.isNotNull() & aad_field(label, field).isNull(),
                "invalid_input",
                f"aad missing {field}",
            )
        )
    for field, own in [("kid", "kid"), ("timestamp", "timestamp"), ("cipher_alg", "variant")]:
        checks.append(
            error_when(
                aad_field(label, field) != sealed[own],
                "invalid_input",
                f"{own} does not match message aad",
            )
        )
    checks.append(
        error_when(
            (sealed["variant"] != secret["cipher_alg"]) | (sealed["kid"] != secret["kid"]),
            "invalid_input",
            "message does not match the key",
        )
    )
    checks.append(P.hex_error("message.ctx", sealed["ctx"]))
    checks.append(P.hex_error("message.nonce", sealed["nonce"]))
    checks.append(
        error_when(
            F.length(sealed["nonce"]) != 2 * NONCE_BYTES,
            "invalid_input",
            f"message.nonce must be {NONCE_BYTES} bytes",
        )
    )
    return first_error(*checks)


def _open(sealed: Column, secret: Column) -> Column:
    raw = gcm_decrypt(
        F.unhex(sealed["ctx"]), secret["key"], F.unhex(sealed["nonce"]), utf8(sealed["aad"])
    )
    return from_utf8(raw)


def _opened(df: DataFrame, col: str, secret: Column) -> tuple[DataFrame, Column]:
    """Frame with ``_shape`` and ``_plain``; the second value is the full error column."""
    made = df.withColumn("_shape", _open_error(F.col(col), secret))
    plain = F.when(F.col("_shape").isNull(), _open(F.col(col), secret))
    made = compute_once(made, {"_plain": plain})
    failed = F.col(col).isNotNull() & F.col("_plain").isNull()
    problem = first_error(
        F.col("_shape"), error_when(failed, "invalid_input", AUTH_FAILED)
    )
    return made, problem


def decrypt_column(
    df: DataFrame,
    col: str,
    kid: str,
    policy: Policy,
    as_col: str = "plaintext",
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Every authentication failure has one fixed error, whatever its cause."""
    secret = policy.cipher_column(kid)
    made, problem = _opened(df, col, secret)
    done = finish(made, {as_col: F.col("_plain")}, problem, on_error, pos)
    return _drop(done, "_shape", "_plain")


def reencrypt_column(
    df: DataFrame,
    col: str,
    from_kid: str,
    to_kid: str,
    policy: Policy,
    ref: str,
    timestamp: str | None = None,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Open under one key and close under another in one narrow stage (key rotation).

    The new label records the source key and time. The plaintext never leaves the stage.
    """
    require_unique_refs(df, ref)
    old, new, run = (
        policy.cipher_column(from_kid),
        policy.cipher_column(to_kid),
        policy.random_column(),
    )
    made, problem = _opened(df, col, old)
    ts = F.lit(timestamp or _now())
    label = _moved_aad(
        old["kid"], F.col(col)["timestamp"], new["kid"], ts, new["cipher_alg"]
    )
    made = made.withColumn(
        "_nonce", keyed_random(run, f"moved|{to_kid}|{col}", NONCE_BYTES, ref, "_plain", label)
    )
    sealed = _seal(F.col("_plain"), new, F.col("_nonce"), label, ts)
    full = first_error(lifecycle_error(new["key_status"], "new"), problem)
    done = finish(made, {col: sealed}, full, on_error, pos)
    return _drop(done, "_shape", "_plain", "_nonce")
