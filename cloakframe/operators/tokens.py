"""X-11, X-12, X-13, J-6: reversible random tokens backed by the vault."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import hmac_hex, keyed_random
from cloakframe.functions.gcm import NONCE_BYTES, gcm_decrypt, gcm_encrypt
from cloakframe.functions.text import (
    aad,
    base64url_ok,
    base64url_size,
    error_when,
    first_error,
    from_base64,
    from_utf8,
    object_json,
    to_base64,
    to_base64url,
    utf8,
)
from cloakframe.operators.batches import duplicate_refs
from cloakframe.plans.jobs import (
    JobError,
    compute_once,
    finish,
    first_failure,
    lifecycle_error,
    require_unique_refs,
)
from cloakframe.plans.policy import Policy
from cloakframe.sources.tables import SnapshotTable, consume

PAYLOAD = "created_at string, metadata string, plaintext string, profile string"
# The error texts in this module are part of its interface.
NOT_FOUND = "token not found"
ONE_TIME = "tokens of a one-time profile can only be redeemed"


def token_hash(token: Column, profile: Column) -> Column:
    message = aad([("profile", profile["name"]), ("token", token)])
    return hmac_hex(utf8(message), profile["hash_ipad"], profile["hash_opad"])


def _data_aad(profile: Column, hashid: Column) -> Column:
    return aad(
        [
            ("version", F.lit("v1")),
            ("type", F.lit("token-data")),
            ("kid", profile["kid"]),
            ("profile", profile["name"]),
            ("tokenization_version", F.lit("random-v1")),
            ("hashid", hashid),
            ("cipher", profile["cipher_alg"]),
        ]
    )


def token_error(token: str, spec: dict, profile: Column) -> Column:
    """Shape of a presented token: prefix, encoding, byte length."""
    c = F.col(token)
    prefix = spec["token_prefix"] + "_"
    code = F.substr(c, F.lit(len(prefix) + 1))
    return first_error(
        lifecycle_error(profile["key_status"], "verify"),
        P.text_error("token", token),
        error_when(
            ~F.startswith(c, F.lit(prefix)),
            "invalid_input",
            "token prefix does not match tokenization profile",
        ),
        error_when(
            ~base64url_ok(code),
            "invalid_input",
            "token contains invalid tokenization encoding",
        ),
        error_when(
            base64url_size(code) != spec["token_len"],
            "invalid_input",
            "token length does not match tokenization profile",
        ),
    )


def tokenize(
    df: DataFrame,
    col: str,
    profile: str,
    policy: Policy,
    ref: str,
    metadata: str | None = None,
    created_at: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(rows with a token column, vault rows)``.

    A ref used twice refuses the frame. Token and nonce are functions of the run key and of all
    that is sealed (ref, value, metadata, time, label), so one nonce never seals two payloads.
    Both frames derive every random byte from the run key and the row, so they agree however
    often and wherever they are computed, and nothing has to be cached. Write the vault rows
    first: a crash then leaves vault rows without a token, never the other way round.
    """
    secret = policy.column("token", profile)
    require_unique_refs(df, ref)
    meta = F.lit(None).cast("string")
    if metadata:  # parsed once; checks and canonical form both read the variant
        df = compute_once(df, {"_variant": F.try_parse_json(metadata)})
        meta = F.to_json("_variant")
    problem = first_error(
        *token_plain_errors(col, profile, policy, ref),
        *([P.metadata_error(metadata, parsed=F.col("_variant"))] if metadata else []),
    )
    token = new_token(col, profile, policy, ref, F.coalesce(meta, F.lit("")))
    done = compute_once(df, {"error": problem})
    done = done.withColumn("token", F.when(F.col("error").isNull(), token))
    done = done.select(*[c for c in done.columns if c != "error"], "error")

    stored = done.filter(F.col("error").isNull() & F.col(col).isNotNull())
    stored = with_vault_data(stored, "token", col, profile, policy, ref, meta, created_at)
    data = F.col("data")
    vault = stored.select(secret["kid"].alias("kid"), "hashid", data.alias("data"))
    return done.drop("_variant"), vault


def with_vault_data(
    rows: DataFrame,
    token_col: str,
    col: str,
    profile: str,
    policy: Policy,
    ref: str,
    meta: Column | None = None,
    created_at: str | None = None,
) -> DataFrame:
    """Adds ``hashid`` and ``data``, what the vault stores for a token; NULL without a token."""
    secret, run = policy.column("token", profile), policy.random_column()
    payload = object_json(
        {
            "created_at": F.lit(created_at or str(int(time.time()))),
            "metadata": F.lit(None).cast("string") if meta is None else meta,
            "plaintext": F.col(col),
            "profile": secret["name"],
        }
    )
    hashid = F.when(F.col(token_col).isNotNull(), token_hash(F.col(token_col), secret))
    made = compute_once(rows, {"hashid": hashid, "_payload": payload})
    made = made.withColumn("_aad", _data_aad(secret, F.col("hashid")))
    nonce = keyed_random(run, f"vault|{profile}|{col}", NONCE_BYTES, ref, "_payload", "_aad")
    made = compute_once(made, {"_nonce": nonce})
    sealed = gcm_encrypt(utf8("_payload"), secret["data_key"], F.col("_nonce"), utf8(F.col("_aad")))
    data = F.concat_ws(
        ".", to_base64(sealed), to_base64(F.col("_nonce")), to_base64(utf8(F.col("_aad")))
    )
    data = F.when(F.col("hashid").isNotNull(), data)
    return made.withColumn("data", data).drop("_payload", "_aad", "_nonce")


def new_token(col: str, profile: str, policy: Policy, ref: str, said: Column | None = None) -> Column:
    """A random token; a function of the run key and of all that is sealed."""
    spec, run = policy.profile("token", profile), policy.random_column()
    said = F.lit("") if said is None else said
    raw = keyed_random(run, f"token|{profile}|{col}", spec["token_len"], ref, col, said)
    return F.concat(F.lit(spec["token_prefix"] + "_"), to_base64url(raw))


def token_plain_errors(col: str, profile: str, policy: Policy, ref: str) -> list[Column]:
    secret = policy.column("token", profile)
    return [
        lifecycle_error(secret["key_status"], "new"),
        P.ref_error(F.col(ref).cast("string")),
        P.text_error("plaintext", col),
        error_when(
            F.char_length(F.col(col)) > secret["max_plaintext_len"],
            "invalid_input",
            "plaintext exceeds tokenization profile maximum length",
        ),
    ]


def _hashed(df: DataFrame, token_col: str, spec: dict, secret: Column) -> DataFrame:
    """Add ``_shape`` (what is wrong with the token), ``hashid`` and ``kid``."""
    made = compute_once(df, {"_shape": token_error(token_col, spec, secret)})
    hashid = F.when(F.col("_shape").isNull(), token_hash(F.col(token_col), secret))
    return compute_once(made, {"hashid": hashid}).withColumn("kid", F.lit(spec["kid"]))


def vault_lookup(df: DataFrame, table: SnapshotTable, version: int | None = None) -> DataFrame:
    """J-6: left join of ``(kid, hashid)`` rows with the vault; ``data`` is NULL when missing.

    One snapshot is used throughout. The shards of the probe are looked up first, a bounded
    number, and only their folders are read.
    """
    version = table.version() if version is None else version
    state = table.state(version)
    probe = df.withColumn("shard", table.shard(F.col("hashid"), state))
    stored = table.read(version, shards=table.shards_of(probe))
    return probe.join(stored, ["kid", "shard", "hashid"], "left").drop("shard")


def detokenize(
    df: DataFrame,
    token_col: str,
    profile: str,
    policy: Policy,
    table: SnapshotTable,
    on_error: str = "quarantine",
    pos: str | None = None,
    version: int | None = None,
):
    """Adds ``plaintext`` and ``metadata``. Rows with a malformed token skip the vault.

    Tokens of a one-time profile are only opened by ``redeem_once`` and ``redeem_stream``, which
    delete them.
    """
    if policy.profile("token", profile)["one_time"]:
        raise JobError(ONE_TIME)
    return _decode(df, token_col, profile, policy, table, on_error, pos, version)


def _decode(df, token_col, profile, policy, table, on_error, pos=None, version=None):
    found = looked_up(df, token_col, profile, policy, table, version)
    return opened(found, df.columns, profile, policy, on_error, pos)


def looked_up(df, token_col, profile, policy, table, version=None) -> DataFrame:
    """``df`` with what the vault holds for its tokens, still sealed: _shape, kid, hashid, data."""
    spec, secret = policy.profile("token", profile), policy.column("token", profile)
    return vault_lookup(_hashed(df, token_col, spec, secret), table, version)


def opened(found: DataFrame, columns: list[str], profile, policy, on_error, pos=None):
    """``columns`` of ``found`` (see ``looked_up``) with plaintext and metadata."""
    secret = policy.column("token", profile)
    parts = F.split("data", "\\.")
    raw = [from_base64(F.get(parts, F.lit(i))) for i in range(3)]
    plain = from_utf8(gcm_decrypt(raw[0], secret["data_key"], raw[1], raw[2]))
    aad_ok = from_utf8(raw[2]) == _data_aad(secret, F.col("hashid"))
    found = found.withColumn("_aad_ok", aad_ok)
    found = compute_once(
        found, {"_payload": F.from_json(F.when(F.col("_aad_ok"), plain), PAYLOAD)}
    )
    asked = F.col("hashid").isNotNull()
    stored = F.col("data").isNotNull()
    problem = first_error(
        F.col("_shape"),
        error_when(asked & F.col("data").isNull(), "not_found", NOT_FOUND),
        error_when(
            stored & ~F.coalesce("_aad_ok", F.lit(False)),
            "invalid_input",
            "token data aad does not match request",
        ),
        error_when(
            stored & F.col("_payload.plaintext").isNull(),
            "invalid_input",
            "token data payload is not valid JSON",
        ),
        error_when(
            F.col("_payload.profile") != secret["name"],
            "invalid_input",
            "token data payload profile does not match request",
        ),
    )
    outputs = {
        "plaintext": F.col("_payload.plaintext"),
        "metadata": F.col("_payload.metadata"),
    }
    keep = [*columns, *[c for c in outputs if c not in columns]]
    done = finish(found, outputs, problem, on_error, pos)
    if isinstance(done, tuple):
        return done[0].select(*keep), done[1].select(*keep, "error")
    return done.select(*keep, *[c for c in done.columns if c == "error"])


def stored_tokens(
    df: DataFrame,
    token_col: str,
    profile: str,
    policy: Policy,
    table: SnapshotTable,
    version: int | None = None,
) -> DataFrame:
    """Adds ``stored``: whether the vault holds the token. Opens nothing and uses nothing up."""
    spec, secret = policy.profile("token", profile), policy.column("token", profile)
    found = vault_lookup(_hashed(df, token_col, spec, secret), table, version)
    return found.select(*df.columns, F.col("data").isNotNull().alias("stored"))


def redeem_once(
    df: DataFrame,
    token_col: str,
    profile: str,
    policy: Policy,
    table: SnapshotTable,
    pos: str,
) -> tuple[DataFrame, int]:
    """Decode one-time tokens and delete them: ``(decoded rows, new vault snapshot)``.

    A token repeated in the batch is refused before any lookup; a missing or damaged token
    fails the whole batch; otherwise all rows go in one commit, which has one winner.
    The decoded frame reads the snapshot from before the deletion.
    """
    spec, secret = policy.profile("token", profile), policy.column("token", profile)
    if not spec["one_time"]:
        raise JobError("tokenization profile is not one-time")
    version = table.version()
    hashed = _hashed(df, token_col, spec, secret).select(
        F.lit(0).alias("_batch"), F.col(pos).cast("long").alias("_pos"), "kid", "hashid"
    )
    repeat = duplicate_refs(hashed, "hashid", ["_batch"], "_pos").first()
    if repeat is not None:
        raise JobError(
            f"batch item {repeat['_pos']} failed: token batch contains duplicated token"
        )
    decoded = _decode(df, token_col, profile, policy, table, "null", version=version)
    failed = first_failure(decoded, pos).first()
    if failed["message"] is not None:
        raise JobError(failed["message"])
    new_version = consume(table, hashed.filter("hashid is not null"), version)
    return decoded.drop("error"), new_version
