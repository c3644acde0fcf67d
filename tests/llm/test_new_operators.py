"""Hard negatives, the Merkle manifest and packing against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakframe.llm import hard_negatives, merkle, packing

# --- 11 hard negatives ------------------------------------------------------------------


def mined(rows):
    """All pairs, in plain Python; of repeated ids the least row."""
    taken: dict = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if i % 7 == 0:
            label = (label + 1) % 10
        row = (label, [math.floor(256 * v) for v in x])
        taken[i] = min(taken.get(i, row), row)
    out = []
    for a, (label, x) in taken.items():
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, other) for b, (other, y) in taken.items() if b != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            good = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, positive, r + 1, b, -p, -n) for r, (n, b, _) in enumerate(good[:3])]
    return sorted(out)


@pytest.fixture(scope="module")
def embedded():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(6)], rng.randrange(4)) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0, 0.0, 1.0], i % 3) for i in range(120)]  # ties
    odd = [(50, None, 1), (150, [0.1, None, 0.1, 0, 0, 0], 1), (250, [float("nan")] * 6, 1), (300, [math.inf] * 6, 2),
           (None, [0.1] * 6, 1), (350, [0.4] * 6, None), (2000, [1.0, 2.0], 1), (2050, [], 2), (7, [3.0] * 6, 0)]
    return rows + odd + rows[:3]


SCHEMA = "vec_id long, embedding array<float>, label int, page long, block long, score double"


def test_hard_negatives(spark, embedded, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PAGE", 64)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "RANGE_PAGES", 2)
    rows = [(i, x and [np.float32(v).item() if v is not None else None for v in x], n) for i, x, n in embedded]
    table = spark.createDataFrame([(*r, 1, 2, 0.5) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, hard_negatives.mine(table).collect()))
    assert got == mined(rows) and len(got) > 50
    assert hard_negatives.mine(table.limit(0)).count() == 0
    assert hard_negatives.mine(table.where("vec_id = 1")).count() == 0


def test_bounds_hold_all_products():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-300, 300, (20, 5)), rng.integers(-300, 300, (90, 5))
    parts = hard_negatives.tiles(x, np.arange(3), 16)
    assert sorted(np.concatenate(parts).tolist()) == list(range(90))
    low, high = (np.stack([f(x[p]) for p in parts]) for f in (lambda v: v.min(0), lambda v: v.max(0)))
    least, most = hard_negatives.bounds(a, low, high)
    for k, p in enumerate(parts):
        scores = a @ x[p].T
        assert (least[:, k] <= scores.min(1)).all() and (scores.max(1) <= most[:, k]).all()


def test_large_numbers_are_exact():
    a, b = np.array([[2**30, 2**30 + 1]]), np.array([[2**31 - 1, 2**31 - 3]])
    assert hard_negatives._dot(a, b).tolist() == [[2**30 * (2**31 - 1) + (2**30 + 1) * (2**31 - 3)]]


# --- 12 Merkle manifest -----------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_of(nodes):
    """The root, and the siblings (left, right) of every leaf on each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            lo = i - i % 16
            paths[leaf].append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 16])))
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], paths


def manifest_of(rows):
    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, kept = [], {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree_of([leaf(r) for r in members])
        subroots.append(root)
        kept[s] = members, paths
    root, above = tree_of(subroots)
    out = []
    for k, s in enumerate(order):
        for row, path in zip(*kept[s]):
            whole = path + above[k]
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                node = leaf((*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])))
            for a, b in whole:
                node = h(a + node + b)
            out.append((row[0], leaf(row), subroots[k], root, h("".join(a + b for a, b in whole)), node, node == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf string, block long"


def same_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], DOCS).repartition(4)
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, manifest_of(rows)))


def test_manifest_rows(spark):
    same_manifest(spark, [
        (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", "en", None, "other"), (None, "a", None, None, None),
        (5, None, "de", 0, ""), (7, "é", None, 1, "Ü"), (8, "", "en", 9, "X" * 100_000), (9, "z", "en", 2, None),
        *[(i, "b", "en", i, f"Text {i}") for i in range(17)],
    ])
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    same_manifest(spark, [(3, "only", "en", 1, "One row")])


def test_manifest_of_a_large_source(spark):
    """Two rounds of exchange, with a last subtree that is not full; and many sources."""
    rows = [(i, "hot", "en", i % 50, f"Document {i}") for i in range(18 * 256 + 5)]
    same_manifest(spark, rows + [(i, f"site {i}", None, None, f"T{i}") for i in range(300)])


# --- 13 packing -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 9)))
    texts = [None, "", " \n ", "one", "Ünï cödé <|endoftext|>", "x" * 3000, " ".join(word() for _ in range(9000))]
    texts += [" ".join(word() for _ in range(rng.choice([5, 60, 600, 1500, 2000]))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(3, "one"), (3, "one"), (None, "no id")]
    return rows


def test_packing(spark, documents):
    docs = spark.createDataFrame([(*r, 1, 2) for r in documents], "doc_id long, text string, piece int, part long")
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    want = []
    for i, t in documents:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    # one partition; five of 40 pieces, with rounds of exchange, that would lose one sequence each
    for part, beyond in ((packing.PART, 1), (40, 3)):
        placed = packing.pack(packing.pieces(docs.repartition(3)), part=part)
        got = placed.collect()
        assert sorted(map(repr, [tuple(r)[:5] for r in got])) == sorted(map(repr, want))
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        for inside in held.values():
            at = 0
            for offset, length in sorted(inside):
                assert offset == at
                at += length
            assert at <= 4096
        used, least = packing.certificate(placed)
        assert used == len(held) and used <= 1.03 * least + beyond
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def fewest(lengths, size):
    """By trying everything."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in sorted({x: i for i, x in enumerate(bins)}.values()):
            if bins[b] + lengths[k] <= size:
                place(k + 1, [*bins[:b], bins[b] + lengths[k], *bins[b + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_bounds_and_best_fit():
    rng = random.Random(4)
    for size in (10, 12, 30):
        for _ in range(60):
            lengths = sorted((rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
            count = np.bincount(lengths, minlength=size + 1)
            least, best = packing.least_bins(count, size), fewest(lengths, size)
            bins, offset = packing.best_fit(np.array(lengths), size)
            assert least <= best <= bins.max() + 1
            for b in set(bins.tolist()):
                assert sum(n for n, x in zip(lengths, bins) if x == b) <= size
    assert packing.least_bins(np.bincount([2100] * 50, minlength=4097)) == 50
    assert packing.least_bins(np.bincount([1400] * 50, minlength=4097)) == 25
    assert packing.least_bins(np.zeros(4097, int)) == 0
