"""X-2, X-3: format-preserving encryption and decryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.ff1 import ff1
from cloakframe.functions.text import ColumnLike, as_col, first_error
from cloakframe.plans.jobs import finish, lifecycle_error
from cloakframe.plans.policy import Policy


def fpe_error(c: ColumnLike, spec: dict, profile: Column, field: str, use: str) -> Column:
    return first_error(
        lifecycle_error(profile["key_status"], use),
        P.alphabet_error(field, c, spec["alphabet"], spec["min_len"], spec["max_len"]),
    )


def fpe_column(c: ColumnLike, spec: dict, profile: Column, ok: Column, encrypt: bool) -> Column:
    """Python UDFs run on every row, so rows that failed a check are passed in as NULL."""
    return ff1(
        F.when(ok, as_col(c)),
        profile["key"],
        alphabet=spec["alphabet"],
        tweak=spec["tweak_aad"],
        encrypt=encrypt,
    )


def _run(df, col, profile, policy, encrypt, on_error, pos):
    spec = policy.profile("fpe", profile)
    secret = policy.column("fpe", profile)
    field, use = ("plaintext", "new") if encrypt else ("ciphertext", "verify")
    problem = fpe_error(col, spec, secret, field, use)
    output = fpe_column(col, spec, secret, F.col("error").isNull(), encrypt)
    return finish(df, {col: output}, problem, on_error, pos)


def fpe_encrypt(
    df: DataFrame,
    col: str,
    profile: str,
    policy: Policy,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Deterministic: equal values give equal ciphertexts of the same length and alphabet."""
    return _run(df, col, profile, policy, True, on_error, pos)


def fpe_decrypt(
    df: DataFrame,
    col: str,
    profile: str,
    policy: Policy,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    return _run(df, col, profile, policy, False, on_error, pos)


def fpe_encrypt_distinct(df: DataFrame, col: str, profile: str, policy: Policy) -> DataFrame:
    """Encrypt each distinct value once and join back, for columns that repeat heavily.

    Worth it only when values repeat; the join is on the value, where adaptive execution may
    broadcast the distinct side or split a hot value. Failed rows keep their ``error``.
    """
    values = df.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    done = fpe_encrypt(values.withColumn("_c", F.col("_v")), "_c", profile, policy, "null")
    joined = df.join(done, df[col] == done["_v"], "left")
    keep = [F.col("_c").alias(col) if c == col else df[c] for c in df.columns]
    return joined.select(*keep, "error")
