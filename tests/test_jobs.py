"""Column jobs: profiles, errors, tampering, recomputation, secrets in plans."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cloakframe.catalog.fixtures import key_ring, kid_of, policy_document
from cloakframe.functions.digests import keyed_random, keyed_random_sized
from cloakframe.operators import commitments, encryption, fpe, masking, sharing, tags
from cloakframe.operators import tokens as tok
from cloakframe.plans.jobs import JobError
from cloakframe.plans.keys import RunKey
from cloakframe.plans.policy import Policy, PolicyError, profile_material
from cloakframe.plans.protect import Step, protect_frame
from cloakframe.sources import tables as T
from cloakframe.sources.policy import read_policy


@pytest.fixture(scope="module")
def cards(spark):
    rows = [("r1", "4111111111111111"), ("r2", "5555555555554444"), ("r3", "12"), ("r4", None)]
    return spark.createDataFrame(rows, "ref string, v string")


def by_ref(df, col):
    return {r["ref"]: r[col] for r in df.collect()}


def test_mask_examples(spark, policy, cards):
    good, bad = masking.mask_columns(cards, {"v": "card"}, policy)
    assert by_ref(good, "v") == {
        "r1": "411111******1111", "r2": "555555******4444", "r4": None,
    }
    assert [r["error"]["message"] for r in bad.collect()] == [
        "plaintext length is outside masking profile bounds"
    ]
    with pytest.raises(JobError, match="batch item 2 failed: plaintext length"):
        placed = cards.withColumn("pos", F.substr("ref", F.lit(2)).cast("int") - 1)
        masking.mask_columns(placed, {"v": "card"}, policy, "fail", "pos")


def test_fpe_properties(spark, policy, cards):
    good, bad = fpe.fpe_encrypt(cards, "v", "card", policy)
    again, _ = fpe.fpe_encrypt(cards.repartition(3), "v", "card", policy)
    other, _ = fpe.fpe_encrypt(cards, "v", "account", policy)
    assert by_ref(good, "v") == by_ref(again, "v") != by_ref(other, "v")
    assert bad.count() == 1
    back, _ = fpe.fpe_decrypt(good, "v", "card", policy)
    assert by_ref(back, "v")["r1"] == "4111111111111111"


def test_retired_key_only_verifies(spark, policy, cards):
    _, bad = fpe.fpe_encrypt(cards, "v", "retired", policy)
    assert {r["error"]["kind"] for r in bad.collect()} == {"forbidden"}
    good, _ = fpe.fpe_decrypt(cards.filter("ref = 'r1'"), "v", "retired", policy)
    assert good.count() == 1
    _, bad = tags.keyed_digest(cards, "v", "retired", policy)
    assert bad.count() == 4


def test_random_bytes(spark, policy):
    run = policy.random_column()
    df = spark.range(50).select(F.col("id").cast("string").alias("ref"))
    long = keyed_random_sized(F.col("run"), "p", F.lit(70), "ref")
    got = df.withColumn("run", run).select(
        "ref",
        keyed_random(run, "p", 70, "ref").alias("a"),
        long.alias("b"),
        keyed_random(run, "q", 70, "ref").alias("c"),
        keyed_random(run, "p", 70, "ref", "ref").alias("d"),
    ).collect()
    assert all(r["a"] == r["b"] and len(r["a"]) == 70 for r in got)
    assert len({bytes(r[c]) for r in got for c in "acd"}) == 150


def test_recomputation_repeats_tokens(spark, policy, cards):
    """Tokens, openings and nonces depend on the row, not on the task that computes it."""
    def once(df):
        done, vault = tok.tokenize(df, "v", "account", policy, "ref", created_at="1")
        return set(map(tuple, done.select("ref", "token").collect())), set(map(tuple, vault.collect()))

    assert once(cards) == once(cards.repartition(4)) == once(cards.orderBy(F.desc("ref")))
    fresh = Policy(spark, policy.tables, policy.keys, RunKey(), check=False)
    done, _ = tok.tokenize(cards, "v", "account", fresh, "ref")
    assert by_ref(done, "token")["r1"] != dict(once(cards)[0])["r1"]


def test_commitment_hides_and_binds(spark, policy):
    df = spark.createDataFrame([("a", "same"), ("b", "same")], "ref string, v string")
    made, _ = commitments.commit(df, "v", "account", policy, "ref")
    assert made.select("commitment").distinct().count() == 2
    for change, want in [
        (F.col("v"), True), (F.lit("other"), False),
    ]:
        good, _ = commitments.verify_commitment(
            made.withColumn("v", change), "v", "opening", "commitment", "account", policy
        )
        assert {r["valid"] for r in good.collect()} == {want}
    short = made.withColumn("opening", F.lit("AAAA"))
    _, bad = commitments.verify_commitment(short, "v", "opening", "commitment", "account", policy)
    assert bad.first()["error"]["message"] == "opening length does not match commitment profile"


def test_tampered_ciphertext_never_opens(spark, policy, cards):
    kid = kid_of("main")
    sealed, _ = encryption.encrypt_column(cards, "v", kid, policy, "ref", timestamp="7")
    sealed = sealed.drop("v").filter("sealed is not null")
    s = F.col("sealed")
    aad = s["aad"]
    changes = {
        "ctx": (s.withField("ctx", F.concat(F.lit("ff"), F.substr(s["ctx"], F.lit(3)))), "message authentication failed"),
        "nonce": (s.withField("nonce", F.repeat(F.lit("0"), F.lit(24))), "message authentication failed"),
        "kid": (s.withField("kid", F.lit(kid_of("next"))), "kid does not match message aad"),
        "both": (
            s.withField("timestamp", F.lit("8")).withField("aad", F.replace(aad, F.lit("timestamp=7"), F.lit("timestamp=8"))),
            "message authentication failed",
        ),
        "aad": (s.withField("aad", F.lit("version=v1")), "aad missing kid"),
    }
    for name, (changed, message) in changes.items():
        good, bad = encryption.decrypt_column(sealed.withColumn("sealed", changed), "sealed", kid, policy)
        assert good.count() == 0, name
        assert {r["error"]["message"] for r in bad.collect()} == {message}, name
    good, _ = encryption.decrypt_column(sealed, "sealed", kid, policy)
    assert by_ref(good, "plaintext")["r3"] == "12"


def test_share_errors(spark, policy):
    df = spark.createDataFrame([(f"s{i}", f"secret {i} é") for i in range(6)], "ref string, v string")
    good, _ = sharing.split_secret(df, "v", "secret", policy, "ref")
    rows = {(r["ref"], r["index"]): r["share"] for r in good.collect()}
    shown = [
        *[("ok", rows["s0", i]) for i in (2, 3, 5)],
        *[("repeat", rows["s1", i]) for i in (1, 2, 2)],
        *[("mixed", x) for x in (rows["s2", 1], rows["s2", 2], rows["s3", 3])],
        *[("broken", x) for x in (rows["s4", 1], rows["s4", 2], rows["s4", 3][:-4] + "AAAA")],
        *[("few", rows["s5", i]) for i in (1, 2)],
        *[("flood", rows["s5", 1])] * 500,
    ]
    asked = spark.createDataFrame(shown, "g string, share string")
    got = {r["g"]: (r["plaintext"], r["error"]["message"] if r["error"] else None)
           for r in sharing.combine_shares(asked, "share", "secret", policy, ["g"]).collect()}
    assert got["ok"] == ("secret 0 é", None)
    assert got["repeat"] == (None, "share indexes must be unique")
    assert got["mixed"] == (None, "shares do not belong to the same sharing set")
    assert got["broken"][1].startswith("share failed: ")
    assert got["few"] == (None, "not enough shares to meet sharing profile threshold")
    assert got["flood"] == (None, "share indexes must be unique")


def test_vault_rules(spark, policy, scratch):
    df = spark.createDataFrame([("a", "one"), ("b", "two")], "ref string, v string")
    done, rows = tok.tokenize(df, "v", "once", policy, "ref", created_at="1")
    vault = T.create_vault(spark, scratch("vault"))
    T.append_vault(rows, vault)
    with pytest.raises(T.TableError, match="already exists"):
        T.append_vault(rows.limit(1), vault)
    assert vault.version() == 1 and vault.read().count() == 2
    twice = done.select("ref", "token", F.monotonically_increasing_id().alias("pos"))
    repeated = twice.unionByName(twice.withColumn("pos", F.col("pos") + 10**12))
    with pytest.raises(JobError, match="duplicated token"):
        tok.redeem_once(repeated, "token", "once", policy, vault, "pos")
    token = F.concat(F.lit("tok_once_"), F.repeat(F.lit("A"), F.lit(43)))
    unknown = twice.withColumn("token", F.when(F.col("ref") == "b", token).otherwise(F.col("token")))
    with pytest.raises(JobError, match="token not found"):
        tok.redeem_once(unknown, "token", "once", policy, vault, "pos")
    assert vault.read().count() == 2
    decoded, _ = tok.redeem_once(twice, "token", "once", policy, vault, "pos")
    assert by_ref(decoded, "plaintext") == {"a": "one", "b": "two"}
    assert vault.read().count() == 0
    with pytest.raises(JobError, match="token not found"):
        tok.redeem_once(twice, "token", "once", policy, vault, "pos")


def test_one_writer_wins(spark, scratch):
    index = T.create_index(spark, scratch("index"))
    rows = spark.createDataFrame([(kid_of("main"), "ab" * 32)], "kid string, digest string")
    version = index.version()
    a, b = index.stage(rows), index.stage(rows)
    index.publish(a, version)
    with pytest.raises(T.ConcurrentWrite):
        index.publish(b, version)
    assert index.read().count() == 1
    before = index.version()
    assert T.upsert_index(rows, index) == before


def test_metadata_round_trip(spark, policy, scratch):
    df = spark.createDataFrame(
        [("a", "one", '{"b": 1, "a": "x"}'), ("b", "two", "[1]"), ("c", "three", None)],
        "ref string, v string, m string",
    )
    done, rows = tok.tokenize(df, "v", "account", policy, "ref", metadata="m")
    assert by_ref(done, "error")["b"]["message"] == "metadata must be a JSON object when present"
    vault = T.create_vault(spark, scratch("vault"))
    T.append_vault(rows, vault)
    good, _ = tok.detokenize(done.filter("token is not null").select("ref", "token"), "token", "account", policy, vault)
    assert by_ref(good, "metadata") == {"a": '{"a":"x","b":1}', "c": None}


def test_no_key_in_plans(spark, policy, cards):
    """Plans of every job, in every form Spark can print, hold no key material."""
    secrets = []
    for kind, names in {"fpe": ["card"], "mac": ["account"], "commit": ["account"], "share": ["secret"], "token": ["account"]}.items():
        for name in names:
            p = policy.profile(kind, name)
            secrets += profile_material(kind, p, key_ring().keys[p["kid"]].secret).values()
    steps = [Step("fpe", "v", "card", "a"), Step("digest", "v", "account", "b"), Step("mask", "v", "card", "c"),
             Step("commit", "v", "account", "d", ref="ref")]
    frames = [
        protect_frame(cards, steps, policy, on_error="null"),
        tok.tokenize(cards, "v", "account", policy, "ref")[1],
        sharing.split_secret(cards, "v", "secret", policy, "ref", "null"),
        encryption.encrypt_column(cards, "v", kid_of("main"), policy, "ref", on_error="null"),
    ]
    for frame in frames:
        frame.collect()
        query = frame._jdf.queryExecution()
        text = "".join(
            spark._jvm.PythonSQLUtils.explainString(query, mode) for mode in ("extended", "formatted", "codegen")
        ).lower()
        for secret in secrets:
            for form in (secret.hex(), secret.decode("latin-1").lower(), ", ".join(str(b) for b in secret[:8])):
                assert form not in text


def test_policy_problems(spark, scratch):
    def problem(change):
        doc = policy_document()
        change(doc)
        with pytest.raises(PolicyError) as caught:
            Policy.parse(spark, json.dumps(doc), key_ring())
        return str(caught.value)

    assert "visible_first plus visible_last" in problem(lambda d: d["masking_profiles"][0].update(visible_last=6))
    assert "too small for FF1" in problem(lambda d: d["fpe_profiles"][0].update(alphabet="01", min_len=6))
    assert "duplicate characters" in problem(lambda d: d["fpe_profiles"][0].update(alphabet="011"))
    assert "duplicated name: card" in problem(lambda d: d["fpe_profiles"][1].update(name="card"))
    assert "not loaded" in problem(lambda d: d["mac_profiles"][0].update(kid="ab" * 32))
    assert "threshold must be at least 2" in problem(lambda d: d["sharing_profiles"][0].update(threshold=1))
    assert "wildcard kid" in problem(lambda d: d["permissions"].append({
        "client": "c", "apikey_hash": "ab" * 32, "status": "active",
        "permissions": [{"kid": "*", "actions": ["mask"]}],
    }))
    empty = read_policy(spark, scratch("missing.json"))
    assert all(frame.count() == 0 for frame in empty.values())


def test_policy_from_file(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({**policy_document(), "later_section": [1]}, indent=2))
    loaded = Policy.load(spark, str(path), key_ring())
    assert loaded.profile("share", "secret")["threshold"] == 3
    with pytest.raises(PolicyError, match="not found"):
        loaded.profile("mask", "nothing")
