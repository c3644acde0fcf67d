"""Development key ring and policy used by the registered queries and the tests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from cloakframe.plans.keys import KeyRing, RunKey
from cloakframe.plans.policy import Policy
from cloakframe.plans.runtime import ship_package

SEED = b"development seed, not for production"
STATUSES = {
    "main": "active",
    "old": "retired",
    "paused": "disabled",
    "leaked": "compromised",
    "gone": "destroyed",
    "next": "active",
}


def key_ring() -> KeyRing:
    return KeyRing.from_seed(SEED, STATUSES)


def kid_of(name: str) -> str:
    return key_ring().kid(list(STATUSES).index(name))


def policy_document() -> dict:
    main, old, paused = kid_of("main"), kid_of("old"), kid_of("paused")
    leaked, gone, following = kid_of("leaked"), kid_of("gone"), kid_of("next")

    def mask(name, kid, first, last, lo, hi):
        return {
            "name": name,
            "kid": kid,
            "visible_first": first,
            "visible_last": last,
            "mask_char": "*",
            "min_len": lo,
            "max_len": hi,
        }

    def fpe(name, alphabet, lo, hi, tweak, kid=main):
        return {
            "name": name,
            "fpe_version": "fpe-ff1-2025",
            "alphabet": alphabet,
            "min_len": lo,
            "max_len": hi,
            "tweak_aad": tweak,
            "kid": kid,
        }

    def token(name, prefix, one_time):
        return {
            "name": name,
            "kid": main,
            "token_prefix": prefix,
            "token_len": 32,
            "max_plaintext_len": 128,
            "one_time": one_time,
        }

    return {
        "version": "v1",
        "routes": [
            {
                "kid": main,
                "name": "main-app",
                "final_app_addr": "127.0.0.1:3999",
                "final_app_path": "/message",
            },
            {
                "kid": old,
                "name": "old-app",
                "final_app_addr": "127.0.0.1:3998",
                "final_app_path": "/archive",
            },
        ],
        "remote_routes": [
            {
                "remote_kid": following,
                "name": "partner",
                "remote_addr": "partner.example:443",
                "allowed_local_kids": [main, old],
                "status": "active",
            },
            {
                "remote_kid": gone,
                "name": "anyone",
                "remote_addr": "open.example:443",
                "allowed_local_kids": ["*"],
                "status": "active",
            },
            {
                "remote_kid": leaked,
                "name": "closed",
                "remote_addr": "closed.example:443",
                "allowed_local_kids": [main],
                "status": "disabled",
            },
        ],
        "permissions": [],
        "masking_profiles": [
            mask("account", main, 0, 4, 6, 32),
            mask("card", main, 6, 4, 16, 16),
            mask("name", old, 1, 0, 3, 64),
            mask("paused", paused, 0, 4, 6, 32),
            mask("leaked", leaked, 0, 4, 6, 32),
            mask("gone", gone, 0, 4, 6, 32),
        ],
        "fpe_profiles": [
            fpe("card", "0123456789", 16, 16, "tenant=demo;field=card;version=1"),
            fpe("account", "0123456789", 6, 32, "tenant=demo;field=account;version=1"),
            fpe(
                "code",
                "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789#_ ",
                6,
                64,
                "tenant=demo;field=code;version=1",
            ),
            fpe("retired", "0123456789", 6, 32, "tenant=demo;field=old;version=1", old),
        ],
        "tokenization_profiles": [
            token("account", "tok_acct", False),
            token("once", "tok_once", True),
        ],
        "mac_profiles": [
            {"name": "account", "kid": main, "context": "tenant=demo;field=account;version=1"},
            {"name": "customer", "kid": main, "context": "tenant=demo;field=customer;version=1"},
            {"name": "retired", "kid": old, "context": "tenant=demo;field=account;version=1"},
        ],
        "commitment_profiles": [
            {
                "name": "account",
                "kid": main,
                "context": "tenant=demo;field=account;purpose=commitment;version=1",
                "max_plaintext_len": 128,
                "opening_len": 32,
            }
        ],
        "sharing_profiles": [
            {
                "name": "secret",
                "kid": main,
                "threshold": 3,
                "shares": 5,
                "max_secret_len": 4096,
                "context": "tenant=demo;purpose=sharing;version=1",
            }
        ],
    }


_POLICIES: dict[str, Policy] = {}


def demo_policy(spark: SparkSession) -> Policy:
    """One compiled policy per application, with a fixed run key so that results repeat."""
    app = spark.sparkContext.applicationId
    if app not in _POLICIES:
        ship_package()
        _POLICIES[app] = Policy.parse(
            spark, json.dumps(policy_document()), key_ring(), run_key=RunKey(b"run key of the demo")
        )
    return _POLICIES[app]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for the jobs that encrypt or hash every row, dealt to all cores.

    A table of one row group would otherwise run on one core, whatever its number of rows. The
    session may ask for a number of partitions.
    """
    rows = table(spark, sf_dir, name).select(*columns)
    wanted = spark.conf.get("cloakframe.scan.partitions", None)
    return rows.repartition(int(wanted) if wanted else spark.sparkContext.defaultParallelism)
