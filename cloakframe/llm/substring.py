"""Removal of word passages that repeat across documents, by recompression.

Recompression rewrites every text in rounds. A round first names runs of one symbol, then halves
the alphabet by a bit of each name and names every pair (left half, right half). A name is a hash
of what it stands for, so all tasks give equal names to equal substrings without exchanging
anything; two occurrences of a passage get the same symbols except near their ends.

With each symbol goes its *context*: the words that decide that it is there. A symbol whose
context lies inside a window of ``WINDOW`` words is there wherever that window occurs. The anchor
of a window is the longest such symbol (ties: the least name), a function of the window's words
alone. Windows that repeat therefore share an anchor, and a text has about a fifth as many
anchors as words. The job shuffles anchors to find those of two documents, and only windows
under shared anchors to compare them exactly and find the first document of each.

Definite results: a null or empty text has no words; null ids come after all others; equal ids
are no "smaller" document for each other; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import texts
from cloakframe.llm.words import BLOCK_BYTES, blocks, mix, text_arrays, window_hashes, words_of

WINDOW = 13
ROUNDS = 2
NO_ID = np.iinfo(np.int64).max  # null ids come last
_OUT = np.int64(1) << 40  # a context that leaves the text


def _group(name, s, e, cs, ce, head, step):
    """Merge symbols from each True in ``head`` to the next; ``step`` salts the new names."""
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(name)))
    last = at + size - 1
    several = size > 1
    new = name[at].copy()
    a, b, n = name[at[several]], name[last[several]], size[several].astype(np.uint64)
    salt = np.uint64(step * 0x632BE59BD9B4E019 % 2**64)
    new[several] = mix(mix(a + salt) * np.uint64(3) + b + n)
    return new, s[at], e[last], np.minimum.reduceat(cs, at), np.maximum.reduceat(ce, at), at, last


def symbols(h: np.ndarray, row: np.ndarray, rounds: int = ROUNDS):
    """Yield name, start, end, context start, context end of all symbols after each round."""
    n = len(h)
    if not n:
        return
    name, s = h, np.arange(n)
    e, cs, ce = s + 1, s, s + 1
    for step in range(rounds):
        same = row[s[1:]] == row[s[:-1]]
        head = np.append(True, ~(same & (name[1:] == name[:-1])))
        before_cs, before_ce, before = cs, ce, s
        name, s, e, cs, ce, at, last = _group(name, s, e, cs, ce, head, 2 * step + 1)
        cs, ce = _widen(cs, ce, at, last, row, before, before_cs, before_ce, True, True)
        left = (mix(name + np.uint64(2 * step + 2)) & np.uint64(1)).astype(bool)
        same = row[s[1:]] == row[s[:-1]]
        pair = np.append(left[:-1] & ~left[1:] & same, False)
        second = np.append(False, pair[:-1])
        alone = ~(pair | second)
        before_cs, before_ce, before = cs, ce, s
        lone_left, lone_right = (alone & left)[~second], (alone & ~left)[~second]
        name, s, e, cs, ce, at, last = _group(name, s, e, cs, ce, ~second, 2 * step + 2)
        cs, ce = _widen(
            cs, ce, at, last, row, before, before_cs, before_ce, lone_right, lone_left
        )
        yield name, s, e, cs, ce


def _widen(cs, ce, at, last, row, s, old_cs, old_ce, to_left, to_right):
    """Contexts of merged symbols that also depend on their left or right neighbour."""
    n = len(s)
    prev, nxt = np.maximum(at - 1, 0), np.minimum(last + 1, n - 1)
    no_prev = (at == 0) | (row[s[prev]] != row[s[at]])
    no_next = (last == n - 1) | (row[s[nxt]] != row[s[last]])
    l_cs = np.where(no_prev, -_OUT, old_cs[prev])
    l_ce = np.where(no_prev, ce, old_ce[prev])
    r_cs = np.where(no_next, cs, old_cs[nxt])
    r_ce = np.where(no_next, _OUT, old_ce[nxt])
    new_cs = np.where(to_left, np.minimum(cs, l_cs), cs)
    new_ce = np.where(to_left, np.maximum(ce, l_ce), ce)
    new_cs = np.where(to_right, np.minimum(new_cs, r_cs), new_cs)
    new_ce = np.where(to_right, np.maximum(new_ce, r_ce), new_ce)
    return new_cs, new_ce


def _with_neighbours(levels, row):
    """Each level's symbols, then its pairs of adjacent symbols, which are more telling."""
    for name, s, e, cs, ce in levels:
        yield name, s, e, cs, ce
        both = np.flatnonzero(row[s[1:]] == row[s[:-1]])
        yield (
            mix(mix(name[both]) * np.uint64(3) + name[both + 1]),
            s[both],
            e[both + 1],
            np.minimum(cs[both], cs[both + 1]),
            np.maximum(ce[both], ce[both + 1]),
        )


def anchors(h: np.ndarray, first: np.ndarray, k: int = WINDOW):
    """Anchor of every window of k words, the words the windows begin at, and their rows."""
    whole, at = window_hashes(h, first, k)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return none, none, at, at
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(h)
    by_width = np.zeros((k + 1, n + 1), np.uint64)
    for name, s, e, cs, ce in _with_neighbours(symbols(h, row), row):
        fits = (ce - cs <= k) & (cs >= 0) & (e - s >= 2)
        s, e, cs, ce, name = s[fits], e[fits], cs[fits], ce[fits], name[fits]
        rank = ((e - s).astype(np.uint64) << np.uint64(59)) | (name >> np.uint64(5))
        np.maximum.at(by_width.reshape(-1), (ce - cs) * (n + 1) + cs, rank)
    best = by_width[1]
    for width in range(2, k + 1):
        wider = np.maximum(best, by_width[width])
        np.maximum(wider[:-1], best[1:], out=wider[:-1])
        best = wider
    chosen = best[at]
    return np.where(chosen > 0, chosen, whole >> np.uint64(5)), whole, at, row[at]


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Places of the first row of each combination of keys (the last key sorts first)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return order[new]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _pack(batches):
    """Compress the texts, which are about to be shuffled."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in blocks(batches, "text"):
        packed = [pack.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(packed, pa.binary())],
            ["doc_id", "k1", "k2", "packed"],
        )


def _unpacked(batches):
    """Batches of shuffled rows with their texts back, in pieces of bounded size."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        size = [zstandard.frame_content_size(x) for x in batch.column("packed").to_pylist()]
        total = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_BYTES)))
            part = batch.slice(lo, hi - lo)
            text = [unpack.decompress(x) for x in part.column("packed").to_pylist()]
            yield part, words_of(pa.record_batch([pa.array(text, pa.binary()).cast(pa.string())], ["text"]), "text")
            lo = hi


def _anchor_rows(batches):
    """Anchors of each text once, with the low bit clear. Those of several texts in one block are
    known to be shared: their rows get the bit set, which spreads them, and two rows without it
    stand for all of them where anchors are compared."""
    for batch in blocks(batches, "text"):
        w = words_of(batch, "text")
        anchor, _, _, row = anchors(w.hashes(), w.first)
        if not len(anchor):
            continue
        anchor = anchor & ~np.uint64(1)
        k1 = batch.column("k1").to_numpy(False)[row]
        own = _first_of_each(k1, anchor)
        anchor, k1 = anchor[own], k1[own]
        ends = np.append(anchor[1:] != anchor[:-1], True)
        starts = np.append(True, ends[:-1])
        known, sent = ~(starts & ends), starts | ends
        yield pa.RecordBatch.from_arrays(
            [
                _longs(np.append(anchor[known] | np.uint64(1), anchor[sent])),
                pa.array(np.append(k1[known], k1[sent])),
            ],
            ["anchor", "k1"],
        )


def _carried(batches, key, value):
    """For sorted rows: each batch, where new keys begin, and for each row the value its key
    began with, also if that was in an earlier batch."""
    last, began = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, values = batch.column(key).to_numpy(False), batch.column(value).to_numpy(False)
        new = np.append(keys[0] != last, keys[1:] != keys[:-1])
        first = np.append([began], values[new])[np.cumsum(new)]
        yield batch, new, keys, values, first
        last, began = keys[-1], first[-1]


def _of_two_texts(batches):
    """From rows sorted by anchor and text, those whose anchor belongs to several texts."""
    held = None  # the first row of the last key, while that key has one text
    for batch, new, anchor, k1, first in _carried(batches, "anchor", "k1"):
        group, at = np.cumsum(new), np.flatnonzero(new)
        known, later = (anchor & 1) > 0, k1 != first
        several = np.zeros(group[-1] + 1, bool)
        several[group[later]] = True
        if held is not None and several[0]:
            yield held
        if len(at) or several[0]:
            held = None
        if len(at) and not several[-1]:
            held = _pairs(anchor[at[-1:]], k1[at[-1:]])
        take = known | later
        take[at] |= several[group[at]]
        if take.any():
            yield _pairs(anchor[take] & ~np.int64(1), k1[take])


def _pairs(anchor: np.ndarray, k1: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(k1)], ["anchor", "k1"])


def _place(k2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A position together with 31 bits of the second text hash, in case the first collides."""
    return ((k2 & np.int64(0x7FFFFFFF)) << np.int64(32)) | at


def _window_rows(batches):
    """Windows under shared anchors. Of equal windows in a block only that with the least
    document goes on to be compared; the others are known to repeat and carry the low bit."""
    for batch, w in _unpacked(batches):
        anchor, whole, at, row = anchors(w.hashes(), w.first)
        lists = batch.column("shared")
        shared = lists.flatten().to_numpy(False)
        shared_row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(False))
        both = lambda r, a: mix(a.view(np.uint64)) ^ mix(r.astype(np.uint64) + np.uint64(1))
        hit = np.flatnonzero(np.isin(both(row, anchor & ~np.uint64(1)), both(shared_row, shared)))
        if not len(hit):
            continue
        h, row, at = whole[hit], row[hit], at[hit]
        doc = batch.column("doc_id").fill_null(NO_ID).to_numpy(False)[row]
        order = np.lexsort((doc, h))
        h, row, at, doc = h[order], row[order], at[order], doc[order]
        new = np.append(True, h[1:] != h[:-1])
        known = doc > doc[new][np.cumsum(new) - 1]
        k1, k2 = (batch.column(c).to_numpy(False)[row] for c in ("k1", "k2"))
        spread = mix(k1.view(np.uint64) + at.astype(np.uint64))
        h = np.where(known, spread | np.uint64(1), h & ~np.uint64(1))
        yield pa.RecordBatch.from_arrays(
            [
                _longs(h),
                pa.array(doc),
                pa.array(k1),
                pa.array(_place(k2, at - w.first[row])),
            ],
            ["h", "doc_id", "k1", "place"],
        )


def _later_rows(batches):
    """From windows sorted by hash and document, those that start in an earlier document too."""
    for batch, _, h, doc, first in _carried(batches, "h", "doc_id"):
        take = ((h & 1) > 0) | (doc > first)
        if take.any():
            yield batch.filter(pa.array(take)).select(["k1", "place"])


def _kept_rows(batches):
    for batch, w in _unpacked(batches):
        keep = np.ones(len(w.start) + WINDOW, bool)
        n_words = np.diff(w.first)
        doc = batch.column("doc_id").fill_null(NO_ID).to_numpy(False)
        k2 = batch.column("k2").to_numpy(False)
        copy = (doc > batch.column("least").fill_null(NO_ID).to_numpy(False)) & (n_words >= WINDOW)
        keep[: len(w.start)] = ~np.repeat(copy, n_words)
        lists = batch.column("starts")
        if len(values := lists.flatten()):
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(False))
            place = values.to_numpy(False)
            at = place & np.int64(0xFFFFFFFF)
            own = _place(k2[row], at) == place
            begin = (at + w.first[row])[own]
            for j in range(WINDOW):
                keep[begin + j] = False
        keep = keep[: len(w.start)]
        total = np.append(0, np.cumsum(~keep))
        joined = [w.joined(r, keep) for r in range(w.rows)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words),
                pa.array(total[w.first[1:]] - total[w.first[:-1]]),
                text_arrays([x.decode() for x in joined]),
                text_arrays([hashlib.sha256(x).hexdigest() for x in joined]),
            ],
            ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
        )


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept: the words left, joined by one space).

    A word goes if a window of ``WINDOW`` words over it also starts in a document with a smaller
    id. ``docs`` needs doc_id and text; other columns are ignored.
    """
    docs = texts(docs).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    shared = (
        docs.select("text", "k1")
        .mapInArrow(_anchor_rows, "anchor long, k1 long")
        .repartition("anchor", F.when(F.col("anchor") % 2 != 0, F.col("k1")))
        .sortWithinPartitions("anchor", "k1")
        .mapInArrow(_of_two_texts, "anchor long, k1 long")
        .groupBy("k1")
        .agg(F.collect_set("anchor").alias("shared"))
    )
    least = docs.groupBy("k1").agg(
        F.when(F.min("k2") == F.max("k2"), F.min("doc_id")).alias("least")
    )
    packed = docs.mapInArrow(_pack, "doc_id long, k1 long, k2 long, packed binary")
    copies = packed.join(least, "k1")
    firsts = copies.where("least is null or doc_id = least").join(shared, "k1")
    later = (
        firsts.mapInArrow(_window_rows, "h long, doc_id long, k1 long, place long")
        .repartition("h")
        .sortWithinPartitions("h", "doc_id")
        .mapInArrow(_later_rows, "k1 long, place long")
        .groupBy("k1")
        .agg(F.collect_set("place").alias("starts"))
    )
    kept = copies.join(later, "k1", "left").mapInArrow(
        _kept_rows, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    )
    return kept if with_text else kept.drop("kept")
