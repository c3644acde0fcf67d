"""Row predicates. Each family has a boolean form (``*_ok``) and an error form (``*_error``).

The error form names the first rule that failed, in a fixed order. SQL NULL passes every rule:
a missing value is not an error, a blank one is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.text import (
    ColumnLike,
    as_col,
    base64_ok,
    base64_size,
    error_when,
    first_error,
    from_base64,
)

# Limits that are part of the semantics.
REF_MAX_CHARS = 128
NAME_MAX_CHARS = 128
LABELS_MAX_CHARS = 128
ENVELOPE_MAX_CHARS = 32_768
METADATA_MAX_CHARS = 128
JSON_MAX_DEPTH = 128
GCM_TAG_BYTES = 16

# Digest names and their sizes in bytes.
HASH_BYTES = {
    "BLAKE2b(160)": 20,
    "BLAKE2b(224)": 28,
    "BLAKE2b(256)": 32,
    "BLAKE2b(384)": 48,
    "BLAKE2b(512)": 64,
    "SHA-224": 28,
    "SHA-256": 32,
    "SHA-384": 48,
    "SHA-512": 64,
    "SHA-512-256": 32,
    "SHA-3(224)": 28,
    "SHA-3(256)": 32,
    "SHA-3(384)": 48,
    "SHA-3(512)": 64,
    "Whirlpool": 64,
}

# Key prefix reserved by the JSON layer; no user object may use it.
RESERVED_JSON_KEY_PREFIX = "$serde_json::private::"

# The error texts in this module are part of its interface.
_BLANK = "(?U)^\\s*\\z"
_CONTROL = "\\p{Cc}"
_LABEL_KEY = "^[A-Za-z0-9_.-]+\\z"


def _bad(kind_ok: Column, message: str) -> Column:
    return error_when(~kind_ok, "invalid_input", message)


# --- P-1 .. P-3: text -----------------------------------------------------------------


def not_blank(c: ColumnLike) -> Column:
    return ~as_col(c).rlike(_BLANK)


def no_control(c: ColumnLike) -> Column:
    return ~as_col(c).rlike(_CONTROL)


def text_ok(c: ColumnLike) -> Column:
    return not_blank(c) & no_control(c)


def text_error(field: str, c: ColumnLike) -> Column:
    return first_error(
        _bad(not_blank(c), f"{field} must not be empty"),
        _bad(no_control(c), f"{field} must not contain control characters"),
    )


def bounded_text_ok(c: ColumnLike, max_chars: int) -> Column:
    return text_ok(c) & (F.char_length(as_col(c)) <= max_chars)


def bounded_text_error(field: str, c: ColumnLike, max_chars: int) -> Column:
    return first_error(
        text_error(field, c),
        _bad(
            F.char_length(as_col(c)) <= max_chars,
            f"{field} exceeds maximum allowed length: {max_chars}",
        ),
    )


def ref_error(c: ColumnLike, field: str = "ref") -> Column:
    return bounded_text_error(field, c, REF_MAX_CHARS)


def no_delimiters(c: ColumnLike) -> Column:
    return ~as_col(c).rlike("[;=]")


def name_ok(c: ColumnLike) -> Column:
    return bounded_text_ok(c, NAME_MAX_CHARS) & no_delimiters(c)


def name_error(field: str, c: ColumnLike) -> Column:
    return first_error(
        bounded_text_error(field, c, NAME_MAX_CHARS),
        _bad(no_delimiters(c), f"{field} must not contain ';' or '='"),
    )


# --- P-4, P-5: label strings ----------------------------------------------------------


def _label_key(x: Column) -> Column:
    return F.substring_index(x, "=", 1)


def _label_value(x: Column) -> Column:
    return F.substr(x, F.char_length(_label_key(x)) + 2)


def labels_error(field: str, c: ColumnLike, max_chars: int = LABELS_MAX_CHARS) -> Column:
    """Checks run label by label; only key uniqueness needs the labels seen before."""
    parts = F.split(as_col(c), ";")

    def label_problem(x: Column) -> Column:
        return (
            F.when(~F.contains(x, F.lit("=")), F.lit("labels must use key=value format"))
            .when(_label_key(x) == "", F.lit("label key must not be empty"))
            .when(_label_value(x) == "", F.lit("label value must not be empty"))
            .when(F.contains(_label_value(x), F.lit("=")), F.lit("label value must not contain '='"))
            .when(~_label_key(x).rlike(_LABEL_KEY), F.lit("label key contains invalid characters"))
        )

    keys = F.transform(parts, _label_key)
    problems = F.transform(
        parts,
        lambda x, i: F.coalesce(
            label_problem(x),
            F.when(
                F.array_position(keys, _label_key(x)) < i + 1,
                F.lit("label keys must be unique"),
            ),
        ),
    )
    first = F.get(F.filter(problems, lambda m: m.isNotNull()), F.lit(0))
    return first_error(
        bounded_text_error(field, c, max_chars),
        error_when(first.isNotNull(), "invalid_input", F.concat(F.lit(f"{field} "), first)),
    )


def labels_ok(c: ColumnLike, max_chars: int = LABELS_MAX_CHARS) -> Column:
    parts = F.split(as_col(c), ";")
    keys = F.transform(parts, _label_key)
    return (
        bounded_text_ok(c, max_chars)
        & F.forall(parts, lambda x: x.rlike("^[A-Za-z0-9_.-]+=[^=]+\\z"))
        & (F.size(F.array_distinct(keys)) == F.size(keys))
    )


def aad_error(c: ColumnLike, field: str = "aad") -> Column:
    parts = F.split(as_col(c), ";")

    def problem(x: Column) -> Column:
        key, value = _label_key(x), _label_value(x)
        return (
            F.when(
                F.size(F.split(x, "=")) != 2, F.lit(f"{field} must contain key=value fields")
            )
            .when(~not_blank(key), F.lit(f"{field} key must not be empty"))
            .when(~key.rlike(_LABEL_KEY), F.lit(f"{field} key contains invalid characters"))
            .when(~not_blank(value), F.lit(f"{field} value must not be empty"))
        )

    first = F.get(F.filter(F.transform(parts, problem), lambda m: m.isNotNull()), F.lit(0))
    return first_error(
        text_error(field, c), error_when(first.isNotNull(), "invalid_input", first)
    )


def aad_ok(c: ColumnLike) -> Column:
    return text_ok(c) & F.forall(
        F.split(as_col(c), ";"),
        lambda x: x.rlike("^[A-Za-z0-9_.-]+=[^=]+\\z") & not_blank(_label_value(x)),
    )


# --- P-6, P-7: hex and fixed lists ----------------------------------------------------


def hex_error(field: str, c: ColumnLike) -> Column:
    c = as_col(c)
    return first_error(
        _bad(c != "", f"{field} must not be empty"),
        _bad(F.octet_length(c) % 2 == 0, f"{field} must have an even number of hex characters"),
        _bad(c.rlike("^[0-9A-Fa-f]*\\z"), f"{field} must contain only hexadecimal characters"),
    )


def hex_ok(c: ColumnLike) -> Column:
    return as_col(c).rlike("^([0-9A-Fa-f]{2})+\\z")


def hash_hex_error(field: str, c: ColumnLike, alg: str) -> Column:
    want = HASH_BYTES[alg] * 2
    return first_error(
        hex_error(field, c),
        error_when(
            F.length(as_col(c)) != want,
            "invalid_input",
            F.concat(
                F.lit(f"{field} must be {want} hex characters for {alg}, got "),
                F.length(as_col(c)).cast("string"),
            ),
        ),
    )


def hash_hex_ok(c: ColumnLike, alg: str) -> Column:
    return hex_ok(c) & (F.length(as_col(c)) == HASH_BYTES[alg] * 2)


def allowed_error(field: str, c: ColumnLike, values: Sequence[str]) -> Column:
    return first_error(
        text_error(field, c),
        _bad(as_col(c).isin(*values), f"{field} must be one of {', '.join(values)}"),
    )


def allowed_ok(c: ColumnLike, values: Sequence[str]) -> Column:
    return text_ok(c) & as_col(c).isin(*values)


# --- P-8: three-part envelope ---------------------------------------------------------


def envelope_error(
    field: str, c: ColumnLike, nonce_len: int = 12, max_chars: int = ENVELOPE_MAX_CHARS
) -> Column:
    c = as_col(c)
    parts = F.split(c, "\\.")
    part = [F.get(parts, F.lit(i)) for i in range(3)]
    label = from_base64(part[2])
    return first_error(
        _bad(c != "", f"{field} must not be empty"),
        _bad(
            F.octet_length(c) <= max_chars,
            f"{field} exceeds maximum allowed length: {max_chars}",
        ),
        _bad(c.rlike("^[\\x21-\\x7e]*\\z"), f"{field} contains invalid base64"),
        _bad(
            (F.size(parts) == 3) & F.forall(parts, lambda x: x != ""),
            f"{field} must have ciphertext.nonce.aad base64 sections",
        ),
        _bad(
            base64_ok(part[0]) & base64_ok(part[1]) & base64_ok(part[2]),
            f"{field} contains invalid base64",
        ),
        _bad(
            base64_size(part[0]) >= GCM_TAG_BYTES,
            f"{field}.ciphertext must include at least a 16-byte authentication tag",
        ),
        _bad(base64_size(part[1]) == nonce_len, f"{field}.nonce must be {nonce_len} bytes"),
        _bad(F.is_valid_utf8(label.cast("string")), f"{field}.aad is not valid UTF-8"),
        _bad(not_blank(label.cast("string")), f"{field}.aad must not be empty"),
    )


def envelope_ok(
    c: ColumnLike, nonce_len: int = 12, max_chars: int = ENVELOPE_MAX_CHARS
) -> Column:
    return F.when(
        as_col(c).isNotNull(), envelope_error("value", c, nonce_len, max_chars).isNull()
    )


# --- P-9: alphabets -------------------------------------------------------------------


def outside_alphabet(c: ColumnLike, alphabet: str) -> Column:
    return F.translate(as_col(c), alphabet, "") != ""


def alphabet_error(
    field: str, c: ColumnLike, alphabet: str, min_len: int, max_len: int
) -> Column:
    n = F.char_length(as_col(c))
    return first_error(
        text_error(field, c),
        error_when(
            outside_alphabet(c, alphabet),
            "invalid_input",
            f"{field} contains character outside fpe profile alphabet",
        ),
        _bad(
            (n >= min_len) & (n <= max_len), f"{field} length is outside fpe profile bounds"
        ),
    )


def alphabet_ok(c: ColumnLike, alphabet: str, min_len: int, max_len: int) -> Column:
    n = F.char_length(as_col(c))
    return text_ok(c) & ~outside_alphabet(c, alphabet) & (n >= min_len) & (n <= max_len)


# --- P-10, P-11: JSON -----------------------------------------------------------------


def _json_strings_removed(c: Column) -> Column:
    return F.regexp_replace(c, '"(?:[^"\\\\]|\\\\.)*+"', '""')


def json_depth(c: ColumnLike) -> Column:
    """Deepest nesting of brackets outside string literals."""
    brackets = F.split(F.regexp_replace(_json_strings_removed(as_col(c)), "[^\\[\\]{}]", ""), "")
    step = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, b: _depth_step(acc, b),
    )
    return step["top"]


def _depth_step(acc: Column, bracket: Column) -> Column:
    now = (
        acc["now"]
        + F.when(bracket.isin("{", "["), 1).when(bracket.isin("}", "]"), -1).otherwise(0)
    )
    return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))


def too_deep(c: ColumnLike, limit: int = JSON_MAX_DEPTH) -> Column:
    """Nested deeper than ``limit``. The walk is needed only by texts with that many brackets."""
    opened = F.length(F.regexp_replace(as_col(c), "[^\\[{]", ""))
    return F.when(opened <= limit, F.lit(False)).otherwise(json_depth(c) > limit)


def reserved_json_key(c: ColumnLike) -> Column:
    return as_col(c).rlike('"\\$serde_json::private::(?:[^"\\\\]|\\\\.)*"\\s*:')


def json_shape_error(field: str, c: ColumnLike, parsed: Column | None = None) -> Column:
    """``parsed`` is the variant of ``c``, if the caller has it already."""
    c = as_col(c)
    parsed = F.try_parse_json(c) if parsed is None else parsed
    return first_error(
        _bad(c.isNull() | parsed.isNotNull(), f"{field} contains invalid JSON"),
        error_when(too_deep(c), "invalid_input", f"{field} is nested too deeply"),
        error_when(
            reserved_json_key(c),
            "invalid_input",
            f"{field} contains a reserved JSON object key",
        ),
    )


def json_shape_ok(c: ColumnLike, parsed: Column | None = None) -> Column:
    return F.when(as_col(c).isNotNull(), json_shape_error("value", c, parsed).isNull())


def metadata_error(
    c: ColumnLike, field: str = "metadata", parsed: Column | None = None
) -> Column:
    c = as_col(c)
    parsed = F.try_parse_json(c) if parsed is None else parsed
    return first_error(
        json_shape_error(field, c, parsed),
        _bad(
            F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")),
            f"{field} must be a JSON object when present",
        ),
        _bad(
            F.char_length(F.to_json(parsed)) <= METADATA_MAX_CHARS,
            f"{field} exceeds tokenization maximum length",
        ),
    )


def metadata_ok(c: ColumnLike) -> Column:
    return F.when(as_col(c).isNotNull(), metadata_error(c).isNull())


# --- P-14: clock samples --------------------------------------------------------------


def _shift(at: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0), at + offset)


def clock_interval(midpoint_us: ColumnLike, radius_us: ColumnLike) -> tuple[Column, Column]:
    mid, rad = as_col(midpoint_us), as_col(radius_us)
    return F.greatest(F.lit(0), mid - rad), mid + rad


def local_within(start: ColumnLike, end: ColumnLike, mid: ColumnLike, rad: ColumnLike) -> Column:
    lo, hi = clock_interval(mid, rad)
    return (as_col(start) <= hi) & (lo <= as_col(end))


def shifted_within(
    start: ColumnLike, end: ColumnLike, offset: ColumnLike, mid: ColumnLike, rad: ColumnLike
) -> Column:
    lo, hi = clock_interval(mid, rad)
    off = as_col(offset)
    return (_shift(as_col(start), off) <= hi) & (lo <= _shift(as_col(end), off))


def clock_acceptable() -> Column:
    """Accept a clock sample; reads the observation columns by their fixed names."""
    c = F.col
    return (
        (F.abs(c("offset_us")) <= c("max_clock_skew_ms") * 1000)
        & (c("round_trip_us") <= c("max_round_trip_ms") * 1000)
        & (c("radius_us") <= c("max_radius_ms") * 1000)
        & local_within("local_start_us", "local_end_us", "midpoint_us", "radius_us")
        & shifted_within(
            "local_start_us", "local_end_us", "offset_us", "midpoint_us", "radius_us"
        )
    )
