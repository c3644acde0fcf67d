"""Driver-side key handling: derivation, key ring, run key.

Only a handful of values pass through here (one per profile). They reach executors as one-row
key tables read through a scalar subquery, so a plan shows ``scalar-subquery`` and never a key.
"""

from __future__ import annotations

import json
import secrets
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.digests import hmac_pads, python_hmac
from cloakframe.plans.runtime import write_once

# Key lifecycle statuses.
LIFECYCLE_STATUSES = ("active", "disabled", "retired", "compromised", "destroyed")


def hkdf(key: bytes, salt: bytes, info: bytes, size: int) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    prk = python_hmac(salt or b"\0" * 32, key)
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = python_hmac(prk, block + info + bytes([i]))
        out += block
        i += 1
    return out[:size]


@dataclass(frozen=True)
class Key:
    kid: str
    secret: bytes = field(repr=False)
    status: str = "active"
    hash_alg: str = "SHA-256"
    cipher_alg: str = "AES-256/GCM"


@dataclass
class KeyRing:
    """The keys a job may use. Secrets stay on the driver."""

    keys: dict[str, Key]

    @classmethod
    def from_seed(cls, seed: bytes, statuses: dict[str, str], **kw) -> KeyRing:
        """Deterministic development ring: one key per name, kid = digest of the name."""
        keys = {}
        for name, status in statuses.items():
            secret = hkdf(seed, b"cloakframe/dev-key", name.encode(), 32)
            kid = hkdf(seed, b"cloakframe/dev-kid", name.encode(), 32).hex()
            keys[kid] = Key(kid, secret, status, **kw)
        return cls(keys)

    def kid(self, index: int) -> str:
        return list(self.keys)[index]

    def public_frame(self, spark: SparkSession) -> DataFrame:
        """The key registry without secrets."""
        names = ["kid", "status", "hash_alg", "cipher_alg"]
        rows = {n: [getattr(k, n) for k in self.keys.values()] for n in names}
        schema = pa.schema([(n, pa.string()) for n in names])
        return spark.createDataFrame(pa.table(rows, schema=schema))


def one_row(spark: SparkSession, values: dict, schema: T.StructType) -> Column:
    """A struct Column backed by a one-row table; usable in batch and streaming plans."""
    row = [tuple(values[f.name] for f in schema.fields)]
    table = spark.createDataFrame(spark.sparkContext.parallelize(row, 1), schema)
    return table.select(F.struct(*[F.col(f.name) for f in schema.fields])).scalar()


class RunKey:
    """Source of retry-stable randomness: 32 random bytes drawn once per run."""

    _SCHEMA = T.StructType(
        [T.StructField("ipad", T.BinaryType()), T.StructField("opad", T.BinaryType())]
    )

    def __init__(self, key: bytes | None = None) -> None:
        ipad, opad = hmac_pads(key or secrets.token_bytes(32), "SHA-256")
        self._pads = {"ipad": ipad, "opad": opad}

    def column(self, spark: SparkSession) -> Column:
        return one_row(spark, self._pads, self._SCHEMA)

    @classmethod
    def kept(cls, spark: SparkSession, folder: str, key: Key) -> RunKey:
        """A run key that survives restarts: the same for all who name this folder and this key.

        The folder, best the checkpoint folder of a stream, gets a file with a random salt and the id
        of the key, neither of them secret. The run key is derived from both the salt and the secret,
        so a replayed micro-batch mints the same nonces, openings and shares, and whoever
        has only the folder learns nothing. Of two that start at once one writes the file.
        """
        text = write_once(spark, f"{folder.rstrip('/')}/run-key.json", json.dumps({"kid": key.kid, "salt": secrets.token_hex(32)}))
        kept = json.loads(text)
        if kept["kid"] != key.kid:
            raise ValueError("the run key of this folder belongs to another key")
        return cls(hkdf(key.secret, bytes.fromhex(kept["salt"]), b"cloakframe/run-key", 32))
