"""Shared pieces of the registered queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.catalog.fixtures import key_ring, policy_document
from cloakframe.plans.policy import KINDS, profile_material

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    """A registered query: what it covers, how to run it, and the SQL it must agree with."""

    covers: str
    run: Query
    sql: str | None = None


def account(c: str, width: int = 12) -> Column:
    """Account-like digits made from a key column."""
    return F.lpad(F.col(c).cast("string"), width, "0")


def account_sql(c: str, width: int = 12) -> str:
    return f"lpad(cast({c} as varchar), {width}, '0')"


def public_profile(kind: str, name: str) -> dict:
    for entry in policy_document()[KINDS[kind]]:
        if entry["name"] == name:
            key = key_ring().keys[entry["kid"]]
            return {**entry, "algorithm": key.hash_alg}
    raise KeyError(name)


def hmac_sql(message: str, ipad: bytes, opad: bytes) -> str:
    """HMAC-SHA-256 of a text expression in SQL."""
    inner = f"sha256(from_hex('{ipad.hex()}') || encode({message}))"
    return f"sha256(from_hex('{opad.hex()}') || from_hex({inner}))"


def tag_sql(profile: str, message: str) -> str:
    """The keyed digest of a mac profile in SQL."""
    p = public_profile("mac", profile)
    pads = profile_material("mac", p, key_ring().keys[p["kid"]].secret)
    return hmac_sql(message, pads["ipad"], pads["opad"])


def message(df: DataFrame) -> DataFrame:
    """Replace the error struct by its message."""
    return df.withColumn("message", F.col("error.message")).drop("error")


# White space and control characters, as classes the SQL side understands.
SPACES_SQL = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}]*"
)


def blank_sql(c: str) -> str:
    return rf"regexp_matches({c}, '^{SPACES_SQL}\z')"


def control_sql(c: str) -> str:
    return rf"regexp_matches({c}, '[\x00-\x1F\x7F-\x{{9F}}]')"


def text_message_sql(field: str, c: str) -> str:
    return (
        f"case when {blank_sql(c)} then '{field} must not be empty' "
        f"when {control_sql(c)} then '{field} must not contain control characters' end"
    )
