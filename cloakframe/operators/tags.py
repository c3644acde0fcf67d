"""X-4, X-5, J-9, J-10, A-8: keyed digests and what they make possible without plaintext."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import hmac_hex
from cloakframe.functions.text import ColumnLike, first_error, utf8
from cloakframe.plans.jobs import compute_once, finish, lifecycle_error
from cloakframe.plans.policy import Policy


def tag_column(c: ColumnLike, profile: Column, alg: str) -> Column:
    """HMAC tag, lower hex."""
    return hmac_hex(utf8(c), profile["ipad"], profile["opad"], alg)


def keyed_digest(
    df: DataFrame,
    col: str,
    profile: str,
    policy: Policy,
    as_col: str = "digest",
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Deterministic tag bound to the profile, its key and its context labels."""
    spec, secret = policy.profile("mac", profile), policy.column("mac", profile)
    problem = first_error(
        lifecycle_error(secret["key_status"], "new"), P.text_error("plaintext", col)
    )
    return finish(
        df, {as_col: tag_column(col, secret, spec["algorithm"])}, problem, on_error, pos
    )


def verify_digest(
    df: DataFrame,
    col: str,
    digest_col: str,
    profile: str,
    policy: Policy,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Recompute and compare; a mismatch is ``valid = false``, never an error."""
    spec, secret = policy.profile("mac", profile), policy.column("mac", profile)
    problem = first_error(
        lifecycle_error(secret["key_status"], "verify"),
        P.text_error("plaintext", col),
        P.hash_hex_error("digest", digest_col, spec["algorithm"]),
    )
    expected = tag_column(col, secret, spec["algorithm"])
    valid = expected == F.lower(F.col(digest_col))
    return finish(df, {"valid": valid}, problem, on_error, pos)


def _with_tag(df: DataFrame, col: str, profile: str, policy: Policy, name: str) -> DataFrame:
    """Add the digest and its ``_refused`` reason, each computed once per row.

    The digest is NULL where the value is NULL or blank or the key may not be used.
    """
    spec, secret = policy.profile("mac", profile), policy.column("mac", profile)
    problem = first_error(
        lifecycle_error(secret["key_status"], "new"), P.text_error("plaintext", col)
    )
    checked = compute_once(df, {"_refused": problem})
    tag = tag_column(col, secret, spec["algorithm"])
    return compute_once(checked, {name: F.when(F.col("_refused").isNull(), tag)})


def index_membership(
    df: DataFrame, col: str, profile: str, policy: Policy, index: DataFrame
) -> DataFrame:
    """J-9: digest each value and flag whether ``(kid, digest)`` is stored in the blind index.

    The index is a set (primary key ``(kid, digest)``), so the left join never multiplies rows.
    The filter on ``kid`` reaches the index scan as a partition filter.
    """
    kid = policy.profile("mac", profile)["kid"]
    checked = keyed_digest(df, col, profile, policy, "digest", on_error="null")
    stored = index.filter(F.col("kid") == kid).select(
        F.col("digest").alias("_stored"), F.lit(True).alias("_hit")
    )
    joined = checked.join(stored, F.col("digest") == F.col("_stored"), "left")
    matched = F.when(F.col("error").isNull(), F.coalesce("_hit", F.lit(False)))
    return joined.select(
        *df.columns, "digest", matched.alias("matched"), "error"
    )


def index_hits(
    df: DataFrame, col: str, profile: str, policy: Policy, index: DataFrame
) -> DataFrame:
    """Only the rows whose digest is stored; refused values have no digest and no hit."""
    kid = policy.profile("mac", profile)["kid"]
    tagged = _with_tag(df, col, profile, policy, "digest")
    stored = index.filter(F.col("kid") == kid).select("digest")
    return tagged.join(stored, "digest", "left_semi").select(*df.columns, "digest")


def protected_join(
    left: DataFrame,
    right: DataFrame,
    left_col: str,
    right_col: str,
    profile: str,
    policy: Policy,
    how: str = "inner",
) -> DataFrame:
    """J-10: equality join on digests; both plaintext key columns are dropped first.

    NULL and blank values, and all values under a key that may not be used, have no digest:
    they match nothing, and outer joins keep their rows with a NULL digest.
    """
    lhs = _with_tag(left, left_col, profile, policy, "digest").drop(left_col, "_refused")
    rhs = _with_tag(right, right_col, profile, policy, "digest").drop(right_col, "_refused")
    return lhs.join(rhs, "digest", how)


def dedupe_by_digest(
    df: DataFrame, col: str, profile: str, policy: Policy, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """A-8: ``(kept, apart)``: one row per sensitive value, the first in ``order`` (unique per
    value), with the digest as its key; and the rows that have no digest, with their ``error``.

    Only digests and order columns are aggregated, in each task first, so a value held by a
    third of all rows leaves each task as one narrow row; whole rows are looked up afterwards.
    """
    tagged = _with_tag(df, col, profile, policy, "digest")
    has = tagged.filter(F.col("digest").isNotNull()).drop("_refused")
    if len(order) == 1:
        first = F.min(order[0]).alias("_first")
    else:
        first = F.min(F.struct(*order)).alias("_first")
    least = has.groupBy("digest").agg(first)
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rest = [c for c in df.columns if c != col]
    kept = has.join(least, "digest").filter(at.eqNullSafe(F.col("_first"))).select("digest", *rest)
    apart = tagged.filter(F.col("digest").isNull()).drop("digest")
    return kept, apart.withColumnRenamed("_refused", "error")
