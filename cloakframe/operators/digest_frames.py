"""X-16, X-17: digests of records and of whole tables."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.digests import digest_hex, hmac_hex, keyed_random
from cloakframe.functions.predicates import HASH_BYTES
from cloakframe.functions.text import record_json, to_hex, utf8
from cloakframe.plans.policy import Policy

# Row digests are added up in limbs of five hex characters, three limbs to a parsed number.
_LIMB_HEX = 5


def row_digest(
    df: DataFrame,
    cols: list[str],
    alg: str = "SHA-256",
    as_col: str = "digest",
    policy: Policy | None = None,
    kid: str | None = None,
    ref: str | None = None,
    created_at: str | None = None,
) -> DataFrame:
    """Digest of the canonical JSON of a record.

    With a policy, ``kid``, ``created_at`` and a random ``serial`` are stamped next to it.
    """
    out = df.withColumn(as_col, digest_hex(utf8(record_json(df, cols)), alg))
    if policy is None:
        return out
    serial = keyed_random(policy.random_column(), "serial", 32, ref, as_col)
    return out.withColumns(
        {
            "kid": F.lit(kid),
            "created_at": F.lit(created_at or str(int(time.time()))),
            "serial": to_hex(serial),
        }
    )


def _fold(df: DataFrame, row_hex: Column, chars: int, alg: str) -> DataFrame:
    """Digest of the multiset of row digests: exact sums of their limbs, then one hash.

    Sums commute, so row order and partitioning do not matter, and they combine inside each
    task: one row per task is shuffled, however large the table and however often a row
    repeats. A 20-bit limb leaves room for 2^43 rows.
    """
    triple = 3 * _LIMB_HEX
    words = {
        f"_w{at}": F.conv(F.substring("_h", at + 1, min(triple, chars - at)), 16, 10).cast("long")
        for at in range(0, chars, triple)
    }
    parsed = df.select(row_hex.alias("_h")).select(
        "_h", *[word.alias(name) for name, word in words.items()]
    )
    limbs = []
    for at in range(0, chars, triple):
        width = min(triple, chars - at)
        ends = [min(end, width) for end in range(_LIMB_HEX, width + _LIMB_HEX, _LIMB_HEX)]
        start = 0
        for end in ends:
            shifted = F.shiftright(F.col(f"_w{at}"), 4 * (width - end))
            limbs.append(shifted.bitwiseAND(F.lit((1 << 4 * (end - start)) - 1)))
            start = end
    sums = parsed.agg(
        F.count("_h").alias("rows"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(limbs)]
    )
    totals = [F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(len(limbs))]
    text = F.concat_ws(",", F.col("rows").cast("string"), *totals)
    return sums.select("rows", digest_hex(utf8(text), alg).alias("digest"))


def table_digest(df: DataFrame, cols: list[str], alg: str = "SHA-256") -> DataFrame:
    """``(rows, digest)`` of a table, independent of row order.

    Good against accidents. Against somebody who picks rows to collide, use ``seal_table``,
    where row digests are keyed.
    """
    row_hex = digest_hex(utf8(record_json(df, cols)), alg)
    return _fold(df, row_hex, 2 * HASH_BYTES[alg], alg)


def seal_table(df: DataFrame, cols: list[str], kid: str, policy: Policy) -> DataFrame:
    """``(rows, digest, kid, seal)``: a keyed digest of the table and its seal."""
    rows_key = policy.seal_column(kid, "table-rows")
    seal_key = policy.seal_column(kid, "table-seal")
    row_hex = hmac_hex(utf8(record_json(df, cols)), rows_key["ipad"], rows_key["opad"])
    folded = _fold(df, row_hex, 64, "SHA-256")
    body = F.concat_ws(";", F.lit(kid), F.col("rows").cast("string"), F.col("digest"))
    seal = hmac_hex(utf8(body), seal_key["ipad"], seal_key["opad"])
    return folded.select("rows", "digest", F.lit(kid).alias("kid"), seal.alias("seal"))


def verify_table_digest(
    df: DataFrame, cols: list[str], expected: dict, policy: Policy
) -> DataFrame:
    """One row ``(rows, valid)``; any difference gives ``valid = false``."""
    now = seal_table(df, cols, expected["kid"], policy)
    same = [F.col(c) == F.lit(expected[c]) for c in ["rows", "digest", "seal"]]
    return now.select("rows", reduce(lambda a, b: a & b, same).alias("valid"))
