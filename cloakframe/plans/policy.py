"""A compiled policy: profiles joined with their derived keys, ready for column jobs.

Compilation runs on the driver over data bounded by the policy size limit. Each profile becomes
a one-row table with its public fields and derived key material; jobs read it as a struct
through a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from cloakframe.functions.digests import hmac_pads
from cloakframe.operators.policy_checks import first_policy_error
from cloakframe.plans.keys import KeyRing, RunKey, hkdf, one_row
from cloakframe.sources.policy import SECTIONS, policy_from_text, read_policy

# Profile kinds and the policy section each one lives in.
KINDS = {
    "mask": "masking_profiles",
    "fpe": "fpe_profiles",
    "token": "tokenization_profiles",
    "mac": "mac_profiles",
    "commit": "commitment_profiles",
    "share": "sharing_profiles",
}

_BINARY_FIELDS = {
    "fpe": ["key"],
    "token": ["hash_ipad", "hash_opad", "data_key"],
    "mac": ["ipad", "opad"],
    "commit": ["ipad", "opad"],
    "share": ["ipad", "opad"],
}


class PolicyError(ValueError):
    """The policy is not valid, or a job asks for something it does not allow."""


class Policy:
    """Profiles of one policy together with the keys they use."""

    def __init__(
        self,
        spark: SparkSession,
        tables: dict[str, DataFrame],
        keys: KeyRing,
        run_key: RunKey | None = None,
        check: bool = True,
    ) -> None:
        self.spark = spark
        self.tables = tables
        self.keys = keys
        self.run_key = run_key or RunKey()
        if check:
            problem = first_policy_error(tables, keys.public_frame(spark)).first()
            if problem["message"] is not None:
                raise PolicyError(f"{problem['section']}: {problem['message']}")
        self._profiles = {
            kind: {row["name"]: row.asDict() for row in tables[section].collect()}
            for kind, section in KINDS.items()
        }

    @classmethod
    def load(cls, spark: SparkSession, path: str, keys: KeyRing, **kw) -> Policy:
        return cls(spark, read_policy(spark, path), keys, **kw)

    @classmethod
    def parse(cls, spark: SparkSession, text: str, keys: KeyRing, **kw) -> Policy:
        return cls(spark, policy_from_text(spark, text), keys, **kw)

    def key_frame(self) -> DataFrame:
        return self.keys.public_frame(self.spark)

    def profile(self, kind: str, name: str) -> dict:
        """Public fields of a profile plus the status and algorithms of its key."""
        if name not in self._profiles[kind]:
            raise PolicyError(f"{kind} profile not found: {name}")
        fields = dict(self._profiles[kind][name])
        key = self.keys.keys[fields["kid"]]
        fields.update(key_status=key.status, algorithm=key.hash_alg, cipher_alg=key.cipher_alg)
        return fields

    def column(self, kind: str, name: str) -> Column:
        """The profile as a struct column, key material included."""
        values = self.profile(kind, name)
        values.update(self.derived(kind, name))
        schema = T.StructType.fromDDL(SECTIONS[KINDS[kind]])
        for extra in ["key_status", "algorithm", "cipher_alg"]:
            schema = schema.add(extra, T.StringType())
        for extra in _BINARY_FIELDS.get(kind, []):
            schema = schema.add(extra, T.BinaryType())
        return one_row(self.spark, values, schema)

    def derived(self, kind: str, name: str) -> dict[str, bytes]:
        p = self.profile(kind, name)
        return profile_material(kind, p, self.keys.keys[p["kid"]].secret)

    def cipher_column(self, kid: str) -> Column:
        """Struct with the record encryption key of ``kid`` and the key status."""
        if kid not in self.keys.keys:
            raise PolicyError(f"key is not loaded: {kid}")
        key = self.keys.keys[kid]
        values = {
            "kid": kid,
            "key": hkdf(key.secret, b"cloakframe/record-key/v1", f"kid={kid}".encode(), 32),
            "key_status": key.status,
            "cipher_alg": key.cipher_alg,
        }
        schema = T.StructType.fromDDL(
            "kid string, key binary, key_status string, cipher_alg string"
        )
        return one_row(self.spark, values, schema)

    def seal_column(self, kid: str, purpose: str) -> Column:
        """HMAC pads for sealing audit checkpoints and table digests."""
        info = f"purpose={purpose};kid={kid}".encode()
        key = hkdf(self.keys.keys[kid].secret, b"cloakframe/seal-key/v1", info, 32)
        ipad, opad = hmac_pads(key, "SHA-256")
        schema = T.StructType.fromDDL("ipad binary, opad binary")
        return one_row(self.spark, {"ipad": ipad, "opad": opad}, schema)

    def random_column(self) -> Column:
        return self.run_key.column(self.spark)


def profile_material(kind: str, p: dict, secret: bytes) -> dict[str, bytes]:
    """Key material of a profile, bound to its name, key, algorithm and context."""

    def derive(purpose: str, *extra: str) -> bytes:
        info = ";".join(
            [f"purpose={purpose}", f"profile={p['name']}", f"kid={p['kid']}", *extra]
        )
        return hkdf(secret, b"cloakframe/profile-key/v1", info.encode(), 32)

    if kind == "mask":
        return {}
    if kind == "fpe":
        return {"key": derive("fpe", f"version={p['fpe_version']}")}
    if kind == "token":
        ipad, opad = hmac_pads(derive("token-hash"), "SHA-256")
        return {"hash_ipad": ipad, "hash_opad": opad, "data_key": derive("token-data")}
    context = [f"context.{label}" for label in p["context"].split(";")]
    key = derive(kind, f"algorithm={p['algorithm']}", *context)
    ipad, opad = hmac_pads(key, p["algorithm"])
    return {"ipad": ipad, "opad": opad}
