"""Scalar text helpers: canonical JSON, label strings, codecs, error values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str

# Error kinds and the response class each one maps to.
ERROR_STATUS = {
    "invalid_input": 400,
    "invalid_signature": 400,
    "stale_config": 400,
    "not_found": 404,
    "forbidden": 403,
    "remote_unreachable": 500,
    "storage": 500,
    "internal": 500,
}

ERROR_TYPE = "struct<kind:string,message:string>"


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def error(kind: str, message: Column | str) -> Column:
    if isinstance(message, str):
        # One SQL text instead of five function calls: rules hold many fixed messages.
        quoted = message.replace("\\", "\\\\").replace("'", "\\'")
        return F.expr(f"named_struct('kind', '{kind}', 'message', '{quoted}')")
    return F.struct(F.lit(kind).alias("kind"), message.alias("message"))


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def first_error(*errors: Column) -> Column:
    """The earliest non-null error; NULL when every check passed."""
    return F.coalesce(*errors, no_error())


def error_when(failed: Column, kind: str, message: Column | str) -> Column:
    return F.when(failed, error(kind, message))


def error_status(kind: ColumnLike) -> Column:
    pairs = [F.lit(v) for item in ERROR_STATUS.items() for v in item]
    return F.create_map(*pairs)[as_col(kind)]


# --- canonical JSON -------------------------------------------------------------------


def canonical_json(c: ColumnLike) -> Column:
    """Compact JSON with keys sorted at every level; NULL when the text is not JSON.

    Goes through the variant type, so ``1.0`` becomes ``1`` and an object with a repeated
    key counts as invalid.
    """
    return F.to_json(F.try_parse_json(as_col(c)))


def _sorted_value(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StructType):
        fields = sorted(dt.fields, key=lambda f: f.name)
        made = F.struct(*[_sorted_value(c[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNotNull(), made)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _sorted_value(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def record_json(df: DataFrame, cols: Iterable[str]) -> Column:
    """Canonical JSON of the named columns of ``df`` (keys sorted, NULL fields kept)."""
    parts = [_sorted_value(F.col(n), df.schema[n].dataType).alias(n) for n in sorted(cols)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def object_json(fields: Mapping[str, Column]) -> Column:
    """Canonical JSON object built from scalar columns."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]),
        {"ignoreNullFields": "false"},
    )


# --- label strings --------------------------------------------------------------------


def aad(pairs: Sequence[tuple[str, Column]]) -> Column:
    """``k=v;k=v`` in the given order."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v) for k, v in pairs])


def context_aad(base: Column, context: ColumnLike) -> Column:
    """Base fields followed by each context label as ``context.k=v``."""
    labels = F.transform(
        F.split(as_col(context), ";"), lambda x: F.concat(F.lit("context."), x)
    )
    return F.concat_ws(";", base, F.array_join(labels, ";"))


def aad_field(c: ColumnLike, key: str) -> Column:
    """First value stored under ``key`` in a ``k=v;k=v`` string, else NULL."""
    hits = F.filter(F.split(as_col(c), ";"), lambda x: F.startswith(x, F.lit(f"{key}=")))
    return F.substr(F.get(hits, F.lit(0)), F.lit(len(key) + 2))


# --- codecs ---------------------------------------------------------------------------


def utf8(c: ColumnLike) -> Column:
    """UTF-8 bytes of a string."""
    return as_col(c).cast("binary")


def from_utf8(c: ColumnLike) -> Column:
    return as_col(c).cast("string")


def to_hex(c: ColumnLike) -> Column:
    return F.lower(F.hex(as_col(c)))


def from_hex(c: ColumnLike) -> Column:
    return F.unhex(as_col(c))


def to_base64url(c: ColumnLike) -> Column:
    """base64url without padding. Spark's ``base64`` wraps lines at 76 characters."""
    flat = F.regexp_replace(F.base64(as_col(c)), "[\\r\\n=]", "")
    return F.translate(flat, "+/", "-_")


# Canonical encodings only: the unused bits of the last character must be zero.
_BASE64URL = (
    "^(?:[A-Za-z0-9_-]{4})*+"
    "(?:[A-Za-z0-9_-][AQgw]|[A-Za-z0-9_-]{2}[AEIMQUYcgkosw048])?\\z"
)
_BASE64 = (
    "^(?:[A-Za-z0-9+/]{4})*"
    "(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\\z"
)


def base64url_ok(c: ColumnLike) -> Column:
    return as_col(c).rlike(_BASE64URL)


def base64url_size(c: ColumnLike) -> Column:
    """Number of bytes an unpadded base64url text stands for, without decoding it."""
    return F.floor(F.length(as_col(c)) * 3 / 4).cast("int")


def from_base64url(c: ColumnLike) -> Column:
    """Bytes of an unpadded base64url text, NULL unless it is the canonical encoding."""
    text = as_col(c)
    return F.unbase64(F.when(base64url_ok(text), F.translate(text, "-_", "+/")))


def to_base64(c: ColumnLike) -> Column:
    return F.regexp_replace(F.base64(as_col(c)), "[\\r\\n]", "")


def base64_ok(c: ColumnLike) -> Column:
    return as_col(c).rlike(_BASE64)


def base64_size(c: ColumnLike) -> Column:
    """Number of bytes a padded base64 text stands for, without decoding it."""
    text = as_col(c)
    return F.floor(F.length(F.rtrim(text, F.lit("="))) * 3 / 4).cast("int")


def from_base64(c: ColumnLike) -> Column:
    """Bytes of a padded standard base64 text, NULL unless it is the canonical encoding."""
    text = as_col(c)
    return F.unbase64(F.when(base64_ok(text), text))


# --- small text functions -------------------------------------------------------------


def sanitize(c: ColumnLike, max_chars: int) -> Column:
    """Drop control characters, then keep the first ``max_chars`` code points."""
    return F.left(F.regexp_replace(as_col(c), "\\p{Cc}", ""), F.lit(max_chars))


def fingerprint(c: ColumnLike) -> Column:
    return F.left(as_col(c), F.lit(8))


def unix_now() -> Column:
    """Current time as a decimal string of Unix seconds."""
    return F.unix_timestamp().cast("string")


def unix_text(ts: ColumnLike) -> Column:
    """Timestamp to a decimal string of Unix seconds."""
    return F.unix_timestamp(as_col(ts)).cast("string")


def from_unix_text(c: ColumnLike) -> Column:
    return F.timestamp_seconds(as_col(c).cast("long"))
