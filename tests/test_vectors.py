"""Published test vectors."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions import digests as D
from cloakframe.functions import gf256
from cloakframe.functions.aes_blocks import encrypt_blocks, round_keys
from cloakframe.functions.ff1 import ff1_texts
from cloakframe.functions.gcm import gcm_decrypt, gcm_encrypt
from cloakframe.plans.keys import hkdf

DIGITS36 = "0123456789abcdefghijklmnopqrstuvwxyz"
K128 = "2B7E151628AED2A6ABF7158809CF4F3C"
K192 = K128 + "EF4359D8D580AA4F"
K256 = K128 + "EF4359D8D580AA4F7F036D6F04FC6A94"
T10 = b"9876543210"
T36 = b"7777pqrs777"

# NIST FF1 samples 1 to 9.
FF1_SAMPLES = [
    (K128, 10, b"", "0123456789", "2433477484"),
    (K128, 10, T10, "0123456789", "6124200773"),
    (K128, 36, T36, "0123456789abcdefghi", "a9tv40mll9kdu509eum"),
    (K192, 10, b"", "0123456789", "2830668132"),
    (K192, 10, T10, "0123456789", "2496655549"),
    (K192, 36, T36, "0123456789abcdefghi", "xbj3kv35jrawxv32ysr"),
    (K256, 10, b"", "0123456789", "6657667009"),
    (K256, 10, T10, "0123456789", "1001623463"),
    (K256, 36, T36, "0123456789abcdefghi", "xs8a0azh2avyalyzuwd"),
]


@pytest.mark.parametrize("key,radix,tweak,plain,cipher", FF1_SAMPLES)
def test_ff1_samples(key, radix, tweak, plain, cipher):
    args = (bytes.fromhex(key), DIGITS36[:radix], tweak)
    assert ff1_texts(np.array([plain], object), *args, True)[0] == cipher
    assert ff1_texts(np.array([cipher], object), *args, False)[0] == plain


@settings(max_examples=60, deadline=None)
@given(st.data(), st.sampled_from([2, 10, 26, 36, 62, 256, 5000]), st.integers(6, 90))
def test_ff1_round_trip(data, radix, n):
    alphabet = "".join(chr(0x4E00 + i) for i in range(radix))
    text = "".join(data.draw(st.lists(st.sampled_from(alphabet), min_size=n, max_size=n)))
    rows = np.array([text, text[::-1]], object)
    key = bytes(range(32))
    sealed = ff1_texts(rows, key, alphabet, b"a=b", True)
    assert all(len(c) == n and set(c) <= set(alphabet) for c in sealed)
    assert list(ff1_texts(np.array(list(sealed), object), key, alphabet, b"a=b", False)) == list(rows)
    other = ff1_texts(rows, key, alphabet, b"a=c", True)
    if radix**n > 10**20:
        assert list(other) != list(sealed)


def test_ff1_longest_value():
    alphabet = "".join(chr(0x10000 + i) for i in range(65_536))
    text = "".join(alphabet[(i * 7919) % 65_536] for i in range(1024))
    key = bytes(range(32))
    sealed = ff1_texts(np.array([text], object), key, alphabet, b"t=1", True)
    assert ff1_texts(np.array([sealed[0]], object), key, alphabet, b"t=1", False)[0] == text


def test_aes_blocks():
    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)
    for size, want in [
        (16, "69c4e0d86a7b0430d8cdb78070b4c55a"),
        (24, "dda97ca4864cdfe06eaf70a0ec0d7191"),
        (32, "8ea2b7ca516745bfeafc49904b496089"),
    ]:
        out = encrypt_blocks(round_keys(bytes(range(size))), plain.reshape(1, 16))
        assert out.tobytes().hex() == want


def test_hkdf_rfc5869():
    okm = hkdf(b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert okm.hex() == (
        "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    )


RFC4231 = [
    (b"\x0b" * 20, b"Hi There"),
    (b"Jefe", b"what do ya want for nothing?"),
    (b"\xaa" * 20, b"\xdd" * 50),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First"),
]


@pytest.mark.parametrize("alg,name", [
    ("SHA-224", "sha224"), ("SHA-256", "sha256"), ("SHA-384", "sha384"), ("SHA-512", "sha512"),
    ("SHA-3(256)", "sha3_256"), ("SHA-512-256", "sha512_256"),
])
def test_hmac(spark, alg, name):
    rows = [(*D.hmac_pads(k, alg), m) for k, m in RFC4231]
    df = spark.createDataFrame(rows, "i binary, o binary, m binary")
    got = [r[0] for r in df.select(D.hmac_hex(F.col("m"), F.col("i"), F.col("o"), alg)).collect()]
    assert got == [hmac.new(k, m, name).hexdigest() for k, m in RFC4231]


@pytest.mark.parametrize("size", [160, 224, 256, 384, 512])
def test_blake2b(spark, size):
    texts = ["", "abc", "é" * 300, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(D.digest_hex(F.col("t").cast("binary"), f"BLAKE2b({size})")).collect()]
    want = [
        None if t is None else hashlib.blake2b(t.encode(), digest_size=size // 8).hexdigest()
        for t in texts
    ]
    assert got == want


def test_gcm_vector(spark):
    row = ("feffe9928665731c6d6a8f9467308308", "cafebabefacedbaddecaf888")
    plain = (
        "d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a72"
        "1c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b39"
    )
    label = "feedfacedeadbeeffeedfacedeadbeefabaddad2"
    want = (
        "42831ec2217774244b7221b784d0d49ce3aa212f2c02a4e035c17e2329aca12e21d514b25466931c7d8f6a5"
        "aac84aa051ba30b396a0aac973d58e0915bc94fbc3221a5db94fae95ae7121a47"
    )
    df = spark.createDataFrame([(*row, plain, label)], "k string, n string, p string, a string")
    k, n, p, a = (F.unhex(c) for c in "knpa")
    sealed = df.withColumn("c", gcm_encrypt(p, k, n, a))
    opened = gcm_decrypt(F.col("c"), k, n, a)
    wrong = gcm_decrypt(F.col("c"), k, n, p)
    got = sealed.select(F.lower(F.hex("c")), F.lower(F.hex(opened)), wrong).first()
    assert tuple(got) == (want, plain, None)


def test_field_tables(spark):
    mul, inv = gf256.product_table(), gf256.inverse_table()
    assert mul[0x57, 0x83] == 0xC1 and mul[0x53, 0xCA] == 1 and inv[0x53] == 0xCA
    pairs = [(a, b) for a in range(256) for b in (0, 1, 2, 3, 87, 131, 254, 255)]
    df = spark.createDataFrame(pairs, "a int, b int")
    got = df.select(
        "a", "b", gf256.gf_mul(F.col("a"), F.col("b")), gf256.gf_inverse(F.col("a"))
    ).collect()
    assert all(r[2] == mul[r[0], r[1]] and r[3] == inv[r[0]] for r in got)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.binary(min_size=80, max_size=80), st.permutations(range(1, 8)))
def test_any_three_points_interpolate(secret, noise, points):
    mul = gf256.product_table()
    chosen = list(points)[:3]

    def share(x):
        return [
            s ^ mul[x, noise[i]] ^ mul[mul[x, x], noise[40 + i]] for i, s in enumerate(secret)
        ]

    weights = gf256.lagrange_at(chosen, 0)
    back = []
    for i in range(len(secret)):
        total = 0
        for w, x in zip(weights, chosen):
            total ^= int(mul[w, share(x)[i]])
        back.append(total)
    assert bytes(back) == secret


def test_digests_from_sql(spark):
    names = D.register_udfs(spark)
    assert "digest_blake2b_256" in names
    got = spark.sql("select hex(digest_blake2b_256(cast('abc' as binary)))").first()[0]
    assert got.lower() == hashlib.blake2b(b"abc", digest_size=32).hexdigest()
