"""SRC-3: batch request documents as rows, one row per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.text import error_when, first_error

# Fixed value: items per batch request.
BATCH_MAX = 128

# Item fields of each request kind; a trailing ? marks an optional field.
ITEM_FIELDS = {
    "mask": ["ref", "plaintext"],
    "fpe_encrypt": ["ref", "plaintext"],
    "fpe_decrypt": ["ref", "ciphertext"],
    "digest": ["ref", "plaintext"],
    "index": ["ref", "plaintext"],
    "verify_digest": ["ref", "plaintext", "digest"],
    "commit": ["ref", "plaintext"],
    "verify_commitment": ["ref", "plaintext", "opening", "commitment"],
    "tokenize": ["ref", "plaintext", "metadata?"],
    "detokenize": ["ref", "token"],
}


def _unknown(keys: Column, allowed: list[str]) -> Column:
    extra = F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))
    return F.coalesce(F.size(extra) > 0, F.lit(False))


def read_request_batches(df: DataFrame, kind: str, column: str = "doc") -> DataFrame:
    """Parse ``{kid?, profile, items: [...]}`` documents.

    Adds ``kid, profile, pos, <item fields>`` and ``error``. A document that is refused as a
    whole comes back as one row without an item. A document holds at most 128 items, so
    exploding it is bounded.
    """
    fields = ITEM_FIELDS[kind]
    names = [f.rstrip("?") for f in fields]
    required = [f for f in fields if not f.endswith("?")]
    text = F.col(column)
    item_type = ", ".join(f"{n}: string" for n in names)
    made = df.withColumns(
        {
            "_raw": F.from_json(text, "kid string, profile string, items array<string>"),
            "_doc": F.from_json(
                text, f"kid string, profile string, items array<struct<{item_type}>>"
            ),
            "_json": F.try_parse_json(text).isNotNull(),
        }
    )
    raw_items = F.col("_raw.items")
    item_keys = F.transform(raw_items, F.json_object_keys)
    count = F.size(raw_items)
    present = F.forall(
        F.col("_doc.items"),
        lambda i: F.forall(
            F.array(*[i[n].isNotNull() for n in required]), lambda x: x
        ),
    )
    document = first_error(
        error_when(~F.col("_json"), "invalid_input", f"{kind} request contains invalid JSON"),
        error_when(
            _unknown(F.json_object_keys(text), ["kid", "profile", "items"]),
            "invalid_input",
            f"{kind} request contains an unknown field",
        ),
        error_when(
            F.col("_doc.profile").isNull() | raw_items.isNull(),
            "invalid_input",
            f"{kind} request misses a field",
        ),
        error_when(
            count > BATCH_MAX,
            "invalid_input",
            f"{kind} batch items exceeds maximum allowed value: {BATCH_MAX}",
        ),
        error_when(count == 0, "invalid_input", f"{kind} batch items must not be empty"),
        error_when(
            F.exists(item_keys, lambda k: k.isNull() | _unknown(k, names)) | ~present,
            "invalid_input",
            f"{kind} request contains an unknown or missing item field",
        ),
        P.name_error("profile", F.col("_doc.profile")),
    )
    made = made.withColumn("_bad", document)
    refs = F.transform("_doc.items", lambda i: i["ref"])
    made = made.withColumn("_refs", F.when(F.col("_bad").isNull(), refs))
    items = F.when(F.col("_bad").isNull(), F.col("_doc.items"))
    keep = [c for c in df.columns if c != column]
    rows = made.select(
        *keep,
        F.col("_doc.kid").alias("kid"),
        F.col("_doc.profile").alias("profile"),
        "_bad",
        "_refs",
        F.posexplode_outer(items).alias("pos", "_item"),
    )
    first_seen = F.array_position("_refs", F.col("_item.ref")) - 1
    item = first_error(
        F.col("_bad"),
        P.ref_error(F.col("_item.ref")),
        *[P.text_error(n, F.col(f"_item.{n}")) for n in required if n != "ref"],
        error_when(
            first_seen < F.col("pos"), "invalid_input", f"{kind} batch ref must be unique"
        ),
    )
    return rows.select(
        *keep,
        "kid",
        "profile",
        "pos",
        *[F.col(f"_item.{n}").alias(n) for n in names],
        item.alias("error"),
    )
