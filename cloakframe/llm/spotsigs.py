"""Document fingerprints by SpotSigs.

Common words are anchors. A signature is an anchor with the ``CHAIN`` content words that follow
it (fewer at the end of a text), so it mostly covers running prose and skips menus and lists. The
fingerprint is the set of signatures, as 32-bit hashes in order. A text without anchors takes every
content word as an anchor, one without content words every word; a text without words has the
empty fingerprint.

Likeness is the Jaccard similarity of two sets. Where a caller asks for a likeness of ``at_least`` so
much, sets whose partitions by length are too far apart to reach it are not compared and count
as 0; the registered query needs exact values for all pairs and asks for none.

Comparing each document with the next in order needs no global sort: ranges of ids are buckets,
each gets a copy of the first row of the next one, and tasks walk through their buckets. Texts are
shuffled once, compressed.

Definite results: null is an empty text; null ids come last in descending order; of equal ids the
one with the smaller text hash comes first; two empty fingerprints have likeness 1. An empty
table has no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import texts
from cloakframe.llm.words import BLOCK_BYTES, LETTERS_DIGITS, blocks, buffer_of, find_words, mix
from cloakframe.llm.words import LOWER, text_arrays

CHAIN = 3
BUCKETS_PER_PARTITION = 8
#: Anchors: frequent words of English, German, French and Spanish.
COMMON = (
    "a an the and of to in is was for that with on as by at from it be are this or not have has had "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les et de du un une que est pour qui dans par sur pas au en "
    "el los las y se del por con no su para lo como más o pero una"
).split()


def hashes_of(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    offsets = np.append(0, np.cumsum([len(w) for w in data]))
    return np.sort(find_words(np.frombuffer(b"".join(data), np.uint8), offsets, LETTERS_DIGITS).hashes())


_ANCHORS = hashes_of(sorted(set(COMMON)))


def _chains(h, anchor, chain, first) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of each anchor position with the chain words after it in its row."""
    row = np.searchsorted(first, anchor, "right") - 1
    at = np.searchsorted(chain, anchor, "right")
    sig = h[anchor]
    some = np.zeros(len(anchor), bool)
    for k in range(CHAIN):
        place = np.minimum(at + k, max(len(chain) - 1, 0))
        ours = (at + k < len(chain)) & (chain[place] < first[row + 1]) if len(chain) else some
        word = h[chain[place]] if len(chain) else sig
        sig = np.where(ours, mix(sig * np.uint64(0x9E3779B97F4A7C15) + word), sig)
        some |= ours & (k == 0)
    return row[some], sig[some]


def signature_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The fingerprint of each text of a block: sorted distinct 32-bit hashes."""
    w = find_words(LOWER[data], offsets, LETTERS_DIGITS)
    h = w.hashes()
    every = np.arange(len(h))
    common = _ANCHORS[np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)] == h
    content = np.flatnonzero(~common)
    row, sig = _chains(h, np.flatnonzero(common), content, w.first)
    for chain in (content, every):  # texts that have no signature so far
        without = np.bincount(row, minlength=w.rows) == 0
        word_row = np.searchsorted(w.first, chain, "right") - 1
        starts = chain[without[word_row]] if len(chain) else chain
        if len(starts):
            # a chain that begins with the word itself; the last word stands alone
            more = _chains(h, starts, chain, w.first)
            alone = starts[~np.isin(starts, _followed(starts, chain, w.first))]
            row = np.concatenate([row, more[0], np.searchsorted(w.first, alone, "right") - 1])
            sig = np.concatenate([sig, more[1], mix(h[alone])])
    small = (sig >> np.uint64(32)).astype(np.int64)
    keys = np.unique((row.astype(np.int64) << np.int64(32)) | small)
    cut = np.searchsorted(keys, np.arange(w.rows + 1, dtype=np.int64) << np.int64(32))
    values = (keys & np.int64(0xFFFFFFFF)).astype(np.uint32)
    return [values[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _followed(starts, chain, first) -> np.ndarray:
    at = np.searchsorted(chain, starts, "right")
    row = np.searchsorted(first, starts, "right") - 1
    ok = (at < len(chain)) & (chain[np.minimum(at, len(chain) - 1)] < first[row + 1])
    return starts[ok]


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def length_partition(n: int, at_least: float) -> int:
    """Sets whose partitions differ by more than one cannot reach ``at_least``."""
    return int(np.log(max(n, 1)) / -np.log(at_least))


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity; 0 where the lengths alone rule out ``at_least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if 0 < at_least < 1:
        apart = abs(length_partition(len(a), at_least) - length_partition(len(b), at_least))
        if apart > 1 or min(len(a), len(b)) < at_least * max(len(a), len(b)):
            return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sets(values: list[str]) -> list[np.ndarray]:
    """Fingerprints of many texts, in blocks of bounded size."""
    out: list[np.ndarray] = []
    for block in blocks([pa.record_batch([pa.array(values, pa.string())], ["text"])], "text"):
        out += signature_sets(*buffer_of(block.column("text")))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) of every document."""

    def work(batches):
        for batch in blocks(batches, "text"):
            found = signature_sets(*buffer_of(batch.column("text")))
            yield pa.record_batch(
                [batch.column("doc_id"), text_arrays([as_text(s) for s in found])], ["doc_id", "fingerprint"]
            )

    return texts(docs).mapInArrow(work, "doc_id long, fingerprint string")


_NO_ID = np.iinfo(np.int64).min


def with_next(docs: DataFrame, at_least: float = 0.0) -> DataFrame:
    """Every document with its edited text and its next document, by descending id.

    The edited text has the last half replaced by as many first characters of the next document.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    docs = texts(docs)
    spark = docs.sparkSession
    n = BUCKETS_PER_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    inner = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = np.array(sorted({int(x) for x in inner}), np.int64)  # n at most

    def tops(batches):
        best: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(False)
            bucket = np.searchsorted(bounds, ids, "right")
            for b in np.unique(bucket).tolist():
                best[b] = max(best.get(b, _NO_ID), int(ids[bucket == b].max()))
        yield pa.record_batch(
            [pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], ["bucket", "top"]
        )

    found = docs.select("doc_id").mapInArrow(tops, "bucket int, top long")
    top = {r.bucket: r.top for r in found.groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    order = sorted(top)
    above = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches, "text"):
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(False)
            bucket = np.searchsorted(bounds, ids, "right")
            is_top = np.flatnonzero(ids == np.array([top[b] for b in bucket.tolist()], np.int64))
            value = [(t or "").encode() for t in batch.column("text").to_pylist()]
            tie = [hashlib.blake2b(v, digest_size=8).digest() for v in value]
            packed = [press.compress(v) for v in value]
            at = np.append(np.arange(len(ids)), is_top)
            where = np.append(bucket, [above[bucket[i]] for i in is_top.tolist()]).astype(np.int32)
            take = lambda x: [x[i] for i in at.tolist()]
            yield pa.record_batch(
                [
                    pa.array(where, pa.int32()),
                    pa.array(np.arange(len(at)) >= len(ids)),
                    pa.array(ids[at]),
                    pa.array(take(tie), pa.binary()),
                    batch.column("doc_id").take(pa.array(at)),
                    pa.array(take(packed), pa.binary()),
                ],
                ["bucket", "copy", "place", "tie", "doc_id", "packed"],
            )

    def walk(batches):
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # rows whose next row has not come yet: one, between pieces
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "packed"))):
                value = unpack.decompress(row[3]).decode()
                held.append((*row[:3], value))
                size += len(value)
                if size >= BLOCK_BYTES:
                    yield compare(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield compare(held)

    def compare(rows):
        own = _sets([r[3] for r in rows])
        # the last row is held for the next piece, or is the copy that ends the last bucket
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        edited = []
        for i in pairs:
            value, half = rows[i][3], len(rows[i][3]) // 2
            edited.append(value[: len(value) - half] + rows[i + 1][3][:half])
        other = _sets(edited)
        return pa.record_batch(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                text_arrays([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                text_arrays([as_text(own[i]) for i in pairs]),
                text_arrays([as_text(s) for s in other]),
                pa.array([likeness(own[i], s, at_least) for i, s in zip(pairs, other)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1], at_least) for i in pairs], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "bucket int, copy boolean, place long, tie binary, doc_id long, packed binary"
    return (
        docs.mapInArrow(pack, schema)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "copy", F.desc("place"), "tie")
        .mapInArrow(
            walk,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
    )
