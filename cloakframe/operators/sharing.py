"""X-14, X-15: threshold secret sharing over GF(2^8).

Share bytes are computed for a whole Arrow batch at a time: the byte buffers of a binary column
are one flat numpy array, so evaluating the polynomials is a few table lookups per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import hmac_hex, keyed_random, keyed_random_sized
from cloakframe.functions.gf256 import lagrange_at, product_table
from cloakframe.functions.text import (
    base64url_ok,
    base64url_size,
    error_when,
    first_error,
    from_base64url,
    object_json,
    to_base64url,
    utf8,
)
from cloakframe.plans.jobs import (
    JobError,
    compute_once,
    first_failure,
    lifecycle_error,
    require_unique_refs,
)
from cloakframe.plans.policy import Policy
from cloakframe.plans.runtime import ship_package

# The error texts in this module are part of its interface.
SET_ID_BYTES = 16
SHARE_PREFIX = "cfs1."
SHARE_VERSION = "share-v1"
SHARE_MAX_CHARS = 16_384

ENVELOPE = (
    "index int, kid string, profile string, set_id string, share string, shares int, "
    "tag string, threshold int, version string"
)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and row lengths of a binary array (NULL counts as empty)."""
    rows = values.to_pylist()
    lengths = np.array([0 if r is None else len(r) for r in rows], np.int64)
    return np.frombuffer(b"".join(r for r in rows if r is not None), np.uint8), lengths


def _cut(flat: np.ndarray, lengths: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Binary array from flat bytes; rows flagged in ``empty`` become NULL."""
    raw, ends = flat.tobytes(), np.cumsum(lengths)
    rows = [
        None if skip else raw[end - size : end]
        for end, size, skip in zip(ends.tolist(), lengths.tolist(), empty.tolist())
    ]
    return pa.array(rows, type=pa.binary())


def share_bytes_udf(threshold: int, shares: int):
    """``(secret, coefficients) -> all shares, by index``: one polynomial per secret byte.

    ``coefficients`` holds the k-1 random bytes of each position, one degree after the other.
    """
    ship_package()

    @F.arrow_udf("array<binary>")
    def run(secrets: pa.Array, coefficients: pa.Array) -> pa.Array:
        mul = product_table()
        secret, lengths = _flat(secrets)
        noise, _ = _flat(coefficients)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        within = np.arange(len(secret)) - starts
        size = np.repeat(lengths, lengths)
        degrees = [noise[starts * (threshold - 1) + d * size + within] for d in range(threshold - 1)]
        empty = np.asarray(secrets.is_null())
        columns = []
        for x in range(1, shares + 1):
            value = np.zeros(len(secret), np.uint8)
            for degree in reversed(degrees):
                value = mul[x][value] ^ degree
            columns.append(_cut(mul[x][value] ^ secret, lengths, empty).to_pylist())
        rows = [None if skip else list(row) for skip, *row in zip(empty.tolist(), *columns)]
        return pa.array(rows, pa.list_(pa.binary()))

    return run


def combine_bytes_udf(threshold: int):
    """``(indexes, values) -> struct<secret, consistent>`` for the shares of one set per row.

    Sets of one index pattern and length are interpolated together, with one weight per share.
    """
    ship_package()

    @F.arrow_udf("struct<secret:binary,consistent:boolean>")
    def run(indexes: pa.Array, values: pa.Array) -> pa.Array:
        mul = product_table()
        points, shares = indexes.to_pylist(), values.to_pylist()
        alike: dict[tuple, list[int]] = {}
        for i, (at, held) in enumerate(zip(points, shares)):
            if at is not None:
                alike.setdefault((tuple(at), len(held[0])), []).append(i)
        secrets: list[bytes | None] = [None] * len(points)
        agree: list[bool | None] = [None] * len(points)
        for (pattern, size), rows in alike.items():
            y = np.frombuffer(b"".join(s for i in rows for s in shares[i]), np.uint8)
            y = y.reshape(len(rows), len(pattern), size)

            def value_at(target: int) -> np.ndarray:
                total = np.zeros((len(rows), size), np.uint8)
                for j, weight in enumerate(lagrange_at(list(pattern[:threshold]), target)):
                    total ^= mul[weight][y[:, j]]
                return total

            same = np.ones(len(rows), bool)
            for j in range(threshold, len(pattern)):
                same &= (value_at(pattern[j]) == y[:, j]).all(1)
            for i, secret, ok in zip(rows, value_at(0), same.tolist()):
                secrets[i], agree[i] = secret.tobytes(), ok
        return pa.StructArray.from_arrays(
            [pa.array(secrets, pa.binary()), pa.array(agree, pa.bool_())],
            names=["secret", "consistent"],
        )

    return run


def _unsigned(profile: Column, set_id: Column, index: Column, share: Column) -> dict:
    return {
        "index": index,
        "kid": profile["kid"],
        "profile": profile["name"],
        "set_id": set_id,
        "share": share,
        "shares": profile["shares"],
        "threshold": profile["threshold"],
        "version": F.lit(SHARE_VERSION),
    }


def _tag(fields: dict, profile: Column, alg: str) -> Column:
    return hmac_hex(utf8(object_json(fields)), profile["ipad"], profile["opad"], alg)


def secret_errors(col: str, profile: str, policy: Policy, ref: str) -> list[Column]:
    spec, secret = policy.profile("share", profile), policy.column("share", profile)
    size = F.octet_length(F.col(col))
    return [
        lifecycle_error(secret["key_status"], "new"),
        P.ref_error(F.col(ref).cast("string")),
        error_when(size == 0, "invalid_input", "plaintext must not be empty"),
        error_when(
            size > spec["max_secret_len"],
            "invalid_input",
            "plaintext exceeds sharing profile maximum length",
        ),
    ]


def with_share_bytes(
    rows: DataFrame, col: str, profile: str, policy: Policy, ref: str, ok: Column
) -> DataFrame:
    """Adds ``set_id`` and ``share_bytes``, all shares of the secret in order of their indexes."""
    spec, run = policy.profile("share", profile), policy.random_column()
    k, n = spec["threshold"], spec["shares"]
    ok = ok & F.col(col).isNotNull()
    set_id = to_base64url(keyed_random(run, f"set|{profile}", SET_ID_BYTES, ref, col))
    made = rows.withColumn("set_id", F.when(ok, set_id)).withColumn("_secret", F.when(ok, utf8(col)))
    # The run key sits in a column here: Spark allows no subquery inside a lambda.
    made = made.withColumn("_run", run)
    size = F.octet_length(F.col("_secret")) * (k - 1)
    noise = keyed_random_sized(F.col("_run"), f"coefficients|{profile}", size, ref, col)
    made = made.withColumn("_noise", noise)
    made = made.withColumn("share_bytes", share_bytes_udf(k, n)(F.col("_secret"), F.col("_noise")))
    return made.drop("_run", "_secret", "_noise")


def exploded_shares(rows: DataFrame, set_id: str, values: str, profile: str, policy: Policy) -> DataFrame:
    """One row per share with ``index`` and the sealed ``share``; rows without shares stay, once."""
    spec, secret = policy.profile("share", profile), policy.column("share", profile)
    kept = [c for c in rows.columns if c != values]
    spread = rows.select(*kept, F.posexplode_outer(values).alias("_at", "_value"))
    spread = spread.withColumn("index", F.col("_at") + 1).withColumn("_share", to_base64url(F.col("_value")))
    fields = _unsigned(secret, F.col(set_id), F.col("index"), F.col("_share"))
    spread = spread.withColumn("_tag", _tag(fields, secret, spec["algorithm"]))
    envelope = object_json({**fields, "tag": F.col("_tag")})
    share = F.when(
        F.col("index").isNotNull(), F.concat(F.lit(SHARE_PREFIX), to_base64url(utf8(envelope)))
    )
    return spread.withColumn("share", share).select(*kept, "index", "share")


def split_secret(
    df: DataFrame,
    col: str,
    profile: str,
    policy: Policy,
    ref: str,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """One row per share: the input columns without the secret, ``set_id, index, share``.

    Rows that fail a check come back once, without a share and with their ``error``; with
    ``on_error='fail'`` the first of them in ``pos`` order refuses the frame.
    """
    if on_error not in ("null", "quarantine", "fail"):
        raise ValueError(f"unknown on_error: {on_error}")
    require_unique_refs(df, ref)
    made = compute_once(df, {"error": first_error(*secret_errors(col, profile, policy, ref))})
    made = with_share_bytes(made, col, profile, policy, ref, F.col("error").isNull())
    spread = exploded_shares(made, "set_id", "share_bytes", profile, policy)
    keep = [c for c in df.columns if c != col]
    out = spread.select(*keep, "set_id", "index", "share", "error")
    if on_error == "null":
        return out
    if on_error == "fail":
        if pos is None:
            raise ValueError("on_error='fail' needs the position column")
        failed = first_failure(made, pos).first()
        if failed["message"] is not None:
            raise JobError(failed["message"])
        return out.drop("error")
    good = out.filter(F.col("error").isNull()).drop("error")
    return good, out.filter(F.col("error").isNotNull())


def decode_share(df: DataFrame, col: str, profile: str, policy: Policy) -> DataFrame:
    """Open and authenticate share envelopes: adds ``_e`` (the envelope), ``_y``, ``error``."""
    spec, secret = policy.profile("share", profile), policy.column("share", profile)
    c = F.col(col)
    raw = from_base64url(F.substr(c, F.lit(len(SHARE_PREFIX) + 1)))
    e = F.col("_e")
    made = df.withColumn("_raw", raw)
    made = compute_once(made, {"_e": F.from_json(F.col("_raw").cast("string"), ENVELOPE)})
    made = made.withColumn("_y", from_base64url(e["share"]))
    fields = {
        "index": e["index"],
        "kid": e["kid"],
        "profile": e["profile"],
        "set_id": e["set_id"],
        "share": e["share"],
        "shares": e["shares"],
        "threshold": e["threshold"],
        "version": F.lit(SHARE_VERSION),
    }
    expected = _tag(fields, secret, spec["algorithm"])

    def need(ok: Column, message: str) -> Column:
        return error_when(~F.coalesce(ok, F.lit(False)), "invalid_input", message)

    problem = first_error(
        lifecycle_error(secret["key_status"], "verify"),
        need(F.octet_length(c) <= SHARE_MAX_CHARS, "share exceeds maximum allowed length"),
        need(F.startswith(c, F.lit(SHARE_PREFIX)), "share has an unknown encoding"),
        need(F.col("_raw").isNotNull(), "share contains invalid encoding"),
        need(e["tag"].isNotNull() & e["set_id"].isNotNull(), "share contains invalid envelope"),
        need(e["version"] == SHARE_VERSION, "share version is not supported"),
        need(
            base64url_ok(e["set_id"]) & (base64url_size(e["set_id"]) == SET_ID_BYTES),
            "set_id length does not match sharing format",
        ),
        need(e["profile"] == secret["name"], "share profile does not match sharing profile"),
        need(e["kid"] == secret["kid"], "share kid does not match sharing profile"),
        need(
            (e["threshold"] == spec["threshold"]) & (e["shares"] == spec["shares"]),
            "share threshold does not match sharing profile",
        ),
        need(
            e["index"].between(1, spec["shares"]), "share index is outside sharing profile range"
        ),
        need(F.lower(e["tag"]) == expected, "share authentication failed"),
        need(
            F.octet_length("_y").between(1, spec["max_secret_len"]),
            "share payload length does not match sharing profile",
        ),
    )
    return compute_once(made, {"error": problem})


def combine_shares(
    df: DataFrame,
    share_col: str,
    profile: str,
    policy: Policy,
    group: list[str] | None = None,
) -> DataFrame:
    """One row per group of presented shares: ``set_id, plaintext, error``.

    ``group`` says which shares were presented together (default: by set id). A group is
    reduced to its counts and to one slot per share index, so the buffer of a group never
    exceeds the shares of one secret, however many rows claim to belong to it, and the
    reduction starts inside each task. Repeated indexes show as a count above the slots.
    """
    spec = policy.profile("share", profile)
    k, n = spec["threshold"], spec["shares"]
    shares = decode_share(df, share_col, profile, policy)
    shares = shares.withColumn("set_id", F.col("_e.set_id")).withColumn(
        "_point", F.when(F.col("error").isNull(), F.col("_e.index"))
    )
    keys = group or ["set_id"]
    facts = shares.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min("set_id").alias("_set"),
        F.max("set_id").alias("_set_max"),
        F.min(F.octet_length("_y")).alias("_len"),
        F.max(F.octet_length("_y")).alias("_len_max"),
        F.min("error.message").alias("_share_error"),
        *[F.max(F.when(F.col("_point") == i, F.col("_y"))).alias(f"_y{i}") for i in range(1, n + 1)],
    )
    slots = F.array(
        *[F.struct(F.lit(i).alias("x"), F.col(f"_y{i}").alias("y")) for i in range(1, n + 1)]
    )
    facts = facts.withColumn("_s", F.filter(slots, lambda s: s["y"].isNotNull()))
    need = first_error(
        error_when(
            F.col("_share_error").isNotNull(),
            "invalid_input",
            F.concat(F.lit("share failed: "), F.col("_share_error")),
        ),
        error_when(
            F.col("_set") != F.col("_set_max"),
            "invalid_input",
            "shares do not belong to the same sharing set",
        ),
        error_when(
            F.col("_n") < k, "invalid_input", "not enough shares to meet sharing profile threshold"
        ),
        error_when(
            F.size("_s") != F.col("_n"), "invalid_input", "share indexes must be unique"
        ),
        error_when(
            F.col("_len") != F.col("_len_max"),
            "invalid_input",
            "share payload lengths must match",
        ),
    )
    facts = facts.withColumn("_bad", need)
    usable = F.when(F.col("_bad").isNull(), F.col("_s"))
    joined = facts.withColumn(
        "_r",
        combine_bytes_udf(k)(
            F.transform(usable, lambda s: s["x"]), F.transform(usable, lambda s: s["y"])
        ),
    )
    text = F.col("_r.secret").cast("string")
    problem = first_error(
        F.col("_bad"),
        error_when(
            ~F.col("_r.consistent"),
            "invalid_input",
            "shares are inconsistent with the sharing set",
        ),
        error_when(
            ~F.is_valid_utf8(text), "invalid_input", "reconstructed secret is not valid UTF-8"
        ),
    )
    out = joined.withColumn("error", problem)
    set_id = [] if "set_id" in keys else [F.col("_set").alias("set_id")]
    return out.select(
        *keys, *set_id, F.when(F.col("error").isNull(), text).alias("plaintext"), "error"
    )
