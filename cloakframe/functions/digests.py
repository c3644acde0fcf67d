"""Digests, keyed tags and retry-stable random bytes as Columns.

The SHA-2 family is composed from built-in expressions and stays inside code generation.
BLAKE2b, SHA-3 and SHA-512/256 have no Spark expression; they run as one Arrow UDF per family.
Keys always arrive as columns, never as literals, so they cannot show up in a query plan.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.predicates import HASH_BYTES
from cloakframe.functions.text import ColumnLike, as_col, utf8
from cloakframe.plans.runtime import ship_package

# SHA-2 digests that Spark computes natively, and their sizes in bits.
NATIVE_BITS = {"SHA-224": 224, "SHA-256": 256, "SHA-384": 384, "SHA-512": 512}


def hash_block_bytes(alg: str) -> int:
    """Input block size of a digest, needed for HMAC padding."""
    if alg in NATIVE_BITS:
        return 64 if NATIVE_BITS[alg] <= 256 else 128
    return python_hash(alg)().block_size


def python_hash(alg: str):
    """hashlib constructor for a digest name."""
    if alg.startswith("BLAKE2b("):
        size = HASH_BYTES[alg]
        return lambda data=b"": hashlib.blake2b(data, digest_size=size)
    names = {
        "SHA-224": "sha224",
        "SHA-256": "sha256",
        "SHA-384": "sha384",
        "SHA-512": "sha512",
        "SHA-512-256": "sha512_256",
        "SHA-3(224)": "sha3_224",
        "SHA-3(256)": "sha3_256",
        "SHA-3(384)": "sha3_384",
        "SHA-3(512)": "sha3_512",
    }
    if alg not in names:
        raise ValueError(f"digest is not supported: {alg}")
    name = names[alg]
    return lambda data=b"": hashlib.new(name, data)


def hmac_pads(key: bytes, alg: str) -> tuple[bytes, bytes]:
    """Inner and outer HMAC pads of a key, computed once on the driver."""
    block = hash_block_bytes(alg)
    if len(key) > block:
        key = python_hash(alg)(key).digest()
    key = key.ljust(block, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


# --- U-1: Arrow digest family ---------------------------------------------------------


def digest_udf(alg: str):
    """Arrow scalar UDF hashing a whole batch of byte strings."""
    ship_package()
    make = python_hash(alg)

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(
            [None if v is None else make(v).digest() for v in values.to_pylist()],
            type=pa.binary(),
        )

    return run


def hmac_udf(alg: str):
    """Arrow scalar UDF for HMAC; the pads arrive as a column next to the message."""
    ship_package()
    make = python_hash(alg)

    @F.arrow_udf("binary")
    def run(ipad: pa.Array, opad: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for i, o, v in zip(ipad.to_pylist(), opad.to_pylist(), values.to_pylist()):
            if v is None or i is None:
                out.append(None)
            else:
                out.append(make(o + make(i + v).digest()).digest())
        return pa.array(out, type=pa.binary())

    return run


def register_udfs(spark: SparkSession) -> list[str]:
    """Make the digest family callable from SQL as ``digest_<name>``."""
    names = []
    for alg in HASH_BYTES:
        if alg == "Whirlpool" or alg in NATIVE_BITS:
            continue
        name = "digest_" + alg.lower().replace("(", "_").replace(")", "").replace("-", "_")
        spark.udf.register(name, digest_udf(alg))
        names.append(name)
    return names


# --- F-6: digests ---------------------------------------------------------------------


def digest(c: ColumnLike, alg: str = "SHA-256") -> Column:
    """Digest of a binary column, as bytes."""
    if alg in NATIVE_BITS:
        return F.unhex(F.sha2(as_col(c), NATIVE_BITS[alg]))
    return digest_udf(alg)(as_col(c))


def digest_hex(c: ColumnLike, alg: str = "SHA-256") -> Column:
    if alg in NATIVE_BITS:
        return F.sha2(as_col(c), NATIVE_BITS[alg])
    return F.lower(F.hex(digest(c, alg)))


# --- keyed tags -----------------------------------------------------------------------


def hmac_hex(message: Column, ipad: Column, opad: Column, alg: str = "SHA-256") -> Column:
    """HMAC tag in lower hex; ``message`` is binary, the pads come from a key table."""
    if alg in NATIVE_BITS:
        bits = NATIVE_BITS[alg]
        inner = F.unhex(F.sha2(F.concat(ipad, message), bits))
        return F.sha2(F.concat(opad, inner), bits)
    return F.lower(F.hex(hmac_udf(alg)(ipad, opad, message)))


def python_hmac(key: bytes, message: bytes, alg: str = "SHA-256") -> bytes:
    """Driver-side HMAC, for key derivation and for seals over one value."""
    if alg in NATIVE_BITS:
        return hmac.new(key, message, f"sha{NATIVE_BITS[alg]}").digest()
    ipad, opad = hmac_pads(key, alg)
    make = python_hash(alg)
    return make(opad + make(ipad + message).digest()).digest()


# --- R-1: random bytes that survive recomputation -------------------------------------


def _random_block(run: Column, head: Column, counter: Column) -> Column:
    message = F.concat(head, utf8(F.concat(F.lit("|"), counter.cast("string"))))
    return hmac_hex(message, run["ipad"], run["opad"])


def keyed_random(
    run: Column, purpose: str, n: int, ref: ColumnLike, *bind: ColumnLike
) -> Column:
    """``n`` random bytes that are a function of the run key, the purpose and the row.

    ``run`` is the struct from ``RunKey.column``. A retried task repeats the same bytes. Values
    given as ``bind`` (usually the plaintext) are mixed in, so two rows that wrongly share a
    ``ref`` still get unrelated bytes unless they are equal in every bound value.
    """
    head = _random_head(purpose, ref, bind)
    blocks = [_random_block(run, head, F.lit(i)) for i in range(-(-n // 32))]
    return F.substring(F.unhex(F.concat(*blocks)), 1, n)


def keyed_random_sized(
    run: Column, purpose: str, n: Column, ref: ColumnLike, *bind: ColumnLike
) -> Column:
    """Like ``keyed_random`` for a length that differs from row to row."""
    head = _random_head(purpose, ref, bind)
    count = F.ceil(n / 32).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: _random_block(run, head, i),
    )
    return F.substring(F.unhex(F.array_join(blocks, "")), F.lit(1), n)


def _random_head(purpose: str, ref: ColumnLike, bind: tuple[ColumnLike, ...]) -> Column:
    """Length-prefixed, so that no two different field lists read the same."""
    fields = [as_col(ref).cast("string"), *[as_col(b).cast("string") for b in bind]]
    parts = [F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields]
    return utf8(F.concat(F.lit(f"{purpose}|"), *parts))
