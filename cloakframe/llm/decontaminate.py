"""Benchmark passages in training text, found with a positional inverted index.

The index is a stored table, split by document: each row holds the postings (term, position) of
one document, sorted by term, for the terms that the benchmark uses. A search goes through it in
shards of many documents. For every phrase it takes the list of the phrase's rarest term (by the
count over all documents), moves it by the term's offset in the phrase, and intersects it with
the moved lists of the other terms from rare to common; what is left are exact occurrences.

Terms travel as 128-bit word hashes. The benchmark is handled in blocks of at most about
``BLOCK_WORDS`` words, each with its own pass, so what a task is given stays bounded however large
the benchmark is.

Definite results: null text or item has no words; items with a null id count as hits but are not
listed; rows with equal ids are separate documents (or one item with several texts). An empty
table has no rows, an empty benchmark no hits; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import row_key, stored, texts
from cloakframe.llm.words import LETTERS_DIGITS, blocks, text_arrays, words_of

PHRASE = 10
BLOCK_WORDS = 1_000_000
SHARD_POSTINGS = 2_000_000
_POS = np.int64(40)


def word_lists(values: list[str | None]) -> list[list[tuple[int, int]]]:
    """The words of each text as pairs of hashes."""
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["text"])
    out = []
    for block in blocks([batch], "text"):
        w = words_of(block, "text", LETTERS_DIGITS, lower=True)
        pairs = list(zip(w.hashes(0).tolist(), w.hashes(1).tolist()))
        out += [pairs[w.first[r] : w.first[r + 1]] for r in range(w.rows)]
    return out


class Phrases:
    """Distinct phrases as rows of term numbers, and the items each of them is from."""

    def __init__(self, items: list[tuple[object, str | None]], k: int = PHRASE):
        found: dict[tuple, set] = {}
        for (item, _), words in zip(items, word_lists([t for _, t in items])):
            size = min(k, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                found.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.terms = sorted({w for phrase in found for w in phrase})
        number = {w: i for i, w in enumerate(self.terms)}
        self.size = np.array([len(p) for p in found], np.int64)
        self.term = np.full((len(found), k), -1, np.int64)
        for row, phrase in zip(self.term, found):
            row[: len(phrase)] = [number[w] for w in phrase]
        names = [sorted(str(i) for i in s if i is not None) for s in found.values()]
        self.names = sorted({x for s in names for x in s})
        place = {x: i for i, x in enumerate(self.names)}
        self.items = np.array([place[x] for s in names for x in s], np.int64)
        self.item_first = np.append(0, np.cumsum([len(s) for s in names])).astype(np.int64)


def build_index(docs: DataFrame, terms: list[tuple[int, int]]) -> DataFrame:
    """One row per document: its key, id, number of words and postings of ``terms``.

    ``docs`` needs doc_id and text. ``term`` and ``pos`` hold 32-bit integers.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(np.array(terms, np.uint64).reshape(-1, 2))

    def index(batches):
        known = shared.value
        for batch in blocks(batches, "text"):
            w = words_of(batch, "text", LETTERS_DIGITS, lower=True)
            h = w.hashes(0)
            number = np.minimum(np.searchsorted(known[:, 0], h), max(len(known) - 1, 0))
            at = np.flatnonzero(known[number, 0] == h) if len(known) else np.zeros(0, np.int64)
            number = number[at]
            same = known[number, 1] == w.hashes(1)[at] if len(at) else np.zeros(0, bool)
            at, number = at[same], number[same]
            row = np.searchsorted(w.first, at, "right") - 1
            order = np.argsort((row << 32) + number, kind="stable")
            at, number, row = at[order], number[order].astype(np.int32), row[order]
            pos = (at - w.first[row]).astype(np.int32)
            cut = np.searchsorted(row, np.arange(w.rows + 1))
            raw_t, raw_p, cut = number.tobytes(), pos.tobytes(), (cut * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_key"),
                    batch.column("doc_id"),
                    pa.array(np.diff(w.first)),
                    pa.array([raw_t[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([raw_p[a:b] for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                ["doc_key", "doc_id", "n_words", "term", "pos"],
            )

    rows = texts(docs).withColumn("doc_key", row_key("doc_id", "text"))
    return rows.mapInArrow(
        index, "doc_key long, doc_id long, n_words long, term binary, pos binary"
    )


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = [x.as_py() for x in column]
    return np.frombuffer(b"".join(values), np.int32), np.array([len(x) // 4 for x in values])


def _shards(batches):
    """Pieces of the index with about SHARD_POSTINGS postings each."""
    for batch in batches:
        total = np.cumsum([len(x) // 4 for x in batch.column("term").to_pylist()] or [0])
        lo = 0
        while lo < batch.num_rows:
            done = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + SHARD_POSTINGS, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term over all documents; as many numbers as there are terms."""

    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            term, _ = _lists(batch.column("term"))
            total += np.bincount(term, minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    found = index.select("term").mapInArrow(count, "term long, n long")
    counts = np.zeros(n_terms, np.int64)
    for row in found.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.term] = row.n
    return counts


def _postings(batch: pa.RecordBatch, gap: int):
    """Sorted keys (term, position) of a shard; documents lie ``gap`` positions apart."""
    term, n = _lists(batch.column("term"))
    pos, _ = _lists(batch.column("pos"))
    words = batch.column("n_words").to_numpy(False)
    base = np.append(0, np.cumsum(words + gap))[:-1]
    keys = (term.astype(np.int64) << _POS) + pos + np.repeat(base, n)
    keys.sort()
    return keys, base


def _inside(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted


def find_phrases(keys: np.ndarray, phrases: Phrases, order: np.ndarray, present: np.ndarray):
    """Occurrences (phrase, first position) in one shard.

    ``order`` lists for each phrase its offsets from the rarest term to the most common.
    """
    able = np.where(phrases.term >= 0, present[phrases.term], True).all(1)
    phrase = np.flatnonzero(able)
    if not len(phrase):
        return phrase, phrase
    rarest = phrases.term[phrase, order[phrase, 0]]
    lo = np.searchsorted(keys, rarest << _POS)
    n = np.searchsorted(keys, (rarest + 1) << _POS) - lo
    phrase = np.repeat(phrase, n)
    at = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    start = (keys[at] & ((np.int64(1) << _POS) - 1)) - order[phrase, 0]
    for k in range(1, phrases.term.shape[1]):
        offset = order[phrase, k]
        term = phrases.term[phrase, offset]
        keep = (term < 0) | _inside(keys, (term << _POS) + start + offset)
        phrase, start = phrase[keep], start[keep]
        if not len(phrase):
            break
    return phrase, start


def search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """doc_key, doc_id, n_words, hit (start and end positions), items, for every document."""
    context = index.sparkSession.sparkContext
    counts = term_counts(index, len(phrases.terms))
    weight = np.where(phrases.term >= 0, np.append(counts, 0)[phrases.term], np.iinfo(np.int64).max)
    shared = context.broadcast((phrases, np.argsort(weight, axis=1, kind="stable")))

    def look(batches):
        phrases, order = shared.value
        k = phrases.term.shape[1]
        for batch in _shards(batches):
            keys, base = _postings(batch, k)
            present = np.zeros(len(phrases.terms) + 1, bool)
            present[keys >> _POS] = True
            phrase, start = find_phrases(keys, phrases, order, present)
            row = np.searchsorted(base, start, "right") - 1
            spans = [[] for _ in range(batch.num_rows)]
            items = [set() for _ in range(batch.num_rows)]
            first = start - base[row]
            for r, p, s in zip(row.tolist(), phrase.tolist(), first.tolist()):
                spans[r].append((s, s + int(phrases.size[p])))
                own = phrases.items[phrases.item_first[p] : phrases.item_first[p + 1]]
                items[r].update(phrases.names[i] for i in own.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_key", "doc_id", "n_words")),
                    pa.array([_union(x) for x in spans], pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["doc_key", "doc_id", "n_words", "hit", "items"],
            )

    return index.mapInArrow(
        look, "doc_key long, doc_id long, n_words long, hit array<long>, items array<string>"
    )


def _union(spans: list[tuple[int, int]]) -> list[int]:
    """Bounds of the union: start, end, start, end and so on."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_near(index: DataFrame, phrases: Phrases, within: int) -> DataFrame:
    """Proximity: doc_key, doc_id, phrase and the first word of every least span of at most
    ``within`` words that holds all (distinct) terms of a phrase, in any order."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def look(batches):
        phrases = shared.value
        wanted = [sorted(set(row[row >= 0].tolist())) for row in phrases.term]
        for batch in _shards(batches):
            keys, base = _postings(batch, within)
            out = []
            for p, terms in enumerate(wanted):
                lists = [
                    keys[slice(*np.searchsorted(keys, [t << 40, (t + 1) << 40]))] - (t << 40)
                    for t in terms
                ]
                if not lists or not all(map(len, lists)):
                    continue
                lists.sort(key=len)
                ends = np.unique(np.concatenate(lists))
                begin = ends.copy()
                for x in lists:  # the last place of each term up to here
                    i = np.searchsorted(x, ends, "right") - 1
                    begin = np.where(i >= 0, np.minimum(begin, x[i]), -within - 1)
                ok = ends - begin < within
                best = {}
                for b, e in zip(begin[ok].tolist(), ends[ok].tolist()):
                    best.setdefault(b, e)
                for b in best:
                    r = int(np.searchsorted(base, b, "right")) - 1
                    out.append((batch["doc_key"][r].as_py(), batch["doc_id"][r].as_py(), p, b - int(base[r])))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], ["doc_key", "doc_id", "phrase", "at"]
            )

    return index.mapInArrow(look, "doc_key long, doc_id long, phrase long, at long")


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The benchmark in blocks of about ``block_words`` words, each as a list of items."""
    items = benchmark.select(F.col("item_id"), F.col("text"))
    length = F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")
    n = 1 + items.agg(length).first().n // (6 * block_words)
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r.item_id, r.text) for r in part.toLocalIterator()]


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found, parts = None, 0
    for items in benchmark_blocks(benchmark, block_words):
        phrases = Phrases(items)
        part = search(stored(build_index(docs, phrases.terms), "postings"), phrases)
        found, parts = part if found is None else found.union(part), parts + 1
    if parts > 1:  # every document has a row for each block
        found = (
            found.groupBy("doc_key", "doc_id", "n_words")
            .agg(
                F.flatten(F.collect_list("hit")).alias("hit"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                (F.count("*") / parts).cast("int").alias("copies"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        )
    return found.select("doc_key", "doc_id", "n_words", "hit", "items").mapInArrow(
        _summary,
        "doc_key long, doc_id long, n_words long, n_hit long, n_items long, "
        "items_sha256 string, contaminated boolean",
    )


def _summary(batches):
    for batch in batches:
        bounds = batch.column("hit").to_pylist()
        hits = [_union(list(zip(x[::2], x[1::2]))) for x in bounds]
        items = batch.column("items").to_pylist()
        n = [sum(x[1::2]) - sum(x[::2]) for x in hits]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_key", "doc_id", "n_words")),
                pa.array(n, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                text_arrays([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                pa.array([x > 0 for x in n]),
            ],
            ["doc_key", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )
