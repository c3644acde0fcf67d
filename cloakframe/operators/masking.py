"""X-1: partial masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.text import ColumnLike, as_col, error_when, first_error
from cloakframe.plans.jobs import finish, lifecycle_error
from cloakframe.plans.policy import Policy


def mask_value(c: ColumnLike, first: Column, last: Column, mask_char: Column) -> Column:
    """Keep the first and last code points, repeat one character between them."""
    c = as_col(c)
    n = F.char_length(c)
    return F.concat(
        F.left(c, first), F.repeat(mask_char, n - first - last), F.substr(c, n - last + 1)
    )


def mask_error(c: ColumnLike, profile: Column) -> Column:
    n = F.char_length(as_col(c))
    return first_error(
        lifecycle_error(profile["key_status"], "verify"),
        P.text_error("plaintext", c),
        error_when(
            (n < profile["min_len"]) | (n > profile["max_len"]),
            "invalid_input",
            "plaintext length is outside masking profile bounds",
        ),
    )


def mask_column(c: ColumnLike, profile: Column) -> Column:
    return mask_value(
        c, profile["visible_first"], profile["visible_last"], profile["mask_char"]
    )


def mask_columns(
    df: DataFrame,
    columns: dict[str, str],
    policy: Policy,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Mask several columns in one projection; ``columns`` maps a column to its profile."""
    profiles = {name: policy.column("mask", used) for name, used in columns.items()}
    problem = first_error(*[mask_error(name, p) for name, p in profiles.items()])
    outputs = {name: mask_column(name, p) for name, p in profiles.items()}
    return finish(df, outputs, problem, on_error, pos)


def mask_by_profile(
    df: DataFrame,
    col: str,
    profile_col: str,
    policy: Policy,
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Mask with a profile named per row; the profile table has the size of a policy."""
    profiles = policy.tables["masking_profiles"].join(
        policy.key_frame().select("kid", F.col("status").alias("key_status")),
        "kid",
        "left",
    )
    packed = profiles.select(
        F.col("name").alias("_name"), F.struct(*profiles.columns).alias("_mask")
    )
    joined = df.join(packed, F.col(profile_col) == F.col("_name"), "left")
    problem = first_error(
        error_when(F.col("_name").isNull(), "invalid_input", "masking profile not found"),
        mask_error(col, F.col("_mask")),
    )
    done = finish(joined, {col: mask_column(col, F.col("_mask"))}, problem, on_error, pos)
    frames = done if isinstance(done, tuple) else (done,)
    cleaned = tuple(f.drop("_name", "_mask") for f in frames)
    return cleaned if isinstance(done, tuple) else cleaned[0]
