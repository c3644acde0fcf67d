"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Every text becomes pieces of at most ``SIZE`` tokens; only texts longer than that are cut. Pieces are
dealt at random to partitions of about ``PART`` pieces, and a task packs one partition by best-fit
decreasing. Dual-feasible functions of the lengths (no number of bins below their sum can hold the
pieces) say how few sequences the partition needs at least. A partition keeps the sequences that the
bound certifies and releases its emptiest: ``LOOSE`` in any case, because bounds are rounded up in each
partition, and ``LOOSE`` more for each sequence beyond the bound, though no more than a quarter of
its pieces. Released pieces are dealt to at most half as many partitions and packed again, until one
is left; so the rounds are few, each moves at most a quarter of the one before, and the last is small.

Only lengths and ids move: the tokens stay behind.

Definite results: a null or empty text is one piece that holds the closing id alone; repeated rows are
packed like any others; an empty table has no rows; other columns are left alone. A very long text is
encoded whole in one task. Which pieces share a sequence depends on how the table is read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.bpe import _BLANK, _OTHER, SHORT_WORD, VOCABULARY, Coder
from cloakframe.llm.common import stored, texts
from cloakframe.llm.words import mix

SIZE = 4096
CLOSING = 1  # the id behind every document
PART = 32_768  # pieces that a task packs at once
LOOSE = 8  # sequences
TRIES = 20
WORDS = 300_000  # words that a task remembers


class _Memory(dict):
    """Ids of words; unknown ones are encoded on the way, and remembered unless they are long."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= SHORT_WORD:
            self[word] = ids
        return ids


class Encoder(Coder):
    """Ids of whole texts, without decoding them."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = _Memory(self._word)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self.words) > WORDS:
            self.words.clear()
        if _OTHER.search(text):
            words = [w if _OTHER.search(w) else w.lower() for w in _BLANK.split(text)]
        else:
            words = _BLANK.split(text.lower())
        return b"".join(map(self.words.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker, with the words it has met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ``spread`` (a number to deal rows by)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def work(batches):
        coder = encoder_of(path)
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = coder.ids(text or "") + CLOSING.to_bytes(4, "little")
                for k, lo in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[lo : lo + 4 * size]
                    rows.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
            number = np.arange(done, done + len(rows), dtype=np.uint64) + np.uint64(task << 40)
            done += len(rows)
            spread = mix(number * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(spread)],
                [c.split()[0] for c in _PIECES.split(", ")],
            )

    return texts(docs).mapInArrow(work, _PIECES)


def best_fit(length: np.ndarray, size: int = SIZE, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: the longest first, each into the fullest bin that has room."""
    order = (np.argsort(-length, kind="stable") if order is None else order).tolist()
    sizes = length.tolist()
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    with_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the sizes of free space that occur
    used = 0
    for i in order:
        need = sizes[i]
        at = bisect_left(rooms, need)
        if at == len(rooms):
            room, b = size, used
            used += 1
        else:
            room = rooms[at]
            stack = with_room[room]
            b = stack.pop()
            if not stack:
                del with_room[room], rooms[at]
        bins[i], offset[i] = b, size - room
        left = room - need
        if left:
            if left not in with_room:
                with_room[left] = []
                insort(rooms, left)
            with_room[left].append(b)
    return bins, offset


def certified_fit(length: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, int]:
    """Bins, offsets, and by how many bins they may be too many.

    Where best-fit decreasing leaves a gap to the bound, it runs again in orders that are a little
    off, ``TRIES`` times at most, and the best run counts.
    """
    least = least_bins(np.bincount(length, minlength=size + 1), size)
    best, rng = best_fit(length, size), np.random.default_rng(len(length))
    for turn in range(TRIES):
        if best[0].max() + 1 <= least:
            break
        blur = 1 + rng.normal(0, 0.02 * (1 + turn % 10), len(length))
        other = best_fit(length, size, np.argsort(-length * blur, kind="stable"))
        best = min(best, other, key=lambda x: int(x[0].max()))
    return *best, int(best[0].max()) + 1 - least


def least_bins(count: np.ndarray, size: int = SIZE) -> int:
    """No packing of ``count[x]`` pieces of each length x has fewer bins.

    A dual-feasible function maps lengths to shares of a bin such that lengths that fit together
    have shares that fit together; so the sum of the shares is a bound. Here: the share itself; with a
    threshold, lengths near a whole bin taken as one and short ones as nothing; and, for each k, the
    rounding of lengths to k-ths by (k + 1)-ths of a bin.
    """
    x = np.arange(size + 1, dtype=np.int64)
    count = np.asarray(count, np.int64)
    total, many = np.append(0, np.cumsum(count * x)), np.append(0, np.cumsum(count))
    t = np.arange(0, size // 2 + 1)
    near = many[-1] - many[size - t + 1]  # longer than size - t
    best = int(-(-(near * size + total[size - t + 1] - total[t]) // size).min())
    for k in range(1, 101):
        up = (k + 1) * x
        share = np.where(up % size == 0, x * k, (up // size) * size)  # in k * size-ths
        best = max(best, -(-int((share * count).sum()) // (k * size)))
    return best


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long, part long, bin long, offset long, kept boolean"


def _packer(size: int, last: bool):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "spread")])
        length = table.column("length").to_numpy()
        bins, offset, gap = certified_fit(length, size)
        keep = np.ones(len(length), bool)
        if not last:
            filled = np.bincount(bins, weights=length).astype(np.int64)
            loose = np.argsort(filled, kind="stable")[: LOOSE * (1 + gap)]
            loose = loose[filled[loose] < size]
            held = np.cumsum(np.bincount(bins)[loose])
            # the emptiest goes in any case
            loose = loose[(held <= len(length) // 4) | (np.arange(len(loose)) == 0)]
            keep = ~np.isin(bins, loose)
        for name, column in (("bin", bins), ("offset", offset), ("kept", keep)):
            table = table.append_column(name, pa.array(column))
        return table

    return work


def pack(found: DataFrame, size: int = SIZE, part: int = PART) -> DataFrame:
    """``found`` (see ``pieces``) with sequence_id and offset; as few sequences as the rounds find."""
    pool = stored(found, "pieces")
    n, turn, done = pool.count(), 0, None
    parts = max(1, -(-n // part))
    while True:
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("spread", F.lit(turn)), F.lit(parts)))
        placed = stored(dealt.groupBy("part").applyInArrow(_packer(size, parts == 1), _PLACED), "packed")
        number = (F.lit(turn << 24) + F.col("part")) * (1 << 24) + F.col("bin")
        kept = placed.where("kept").withColumn("sequence_id", number)
        done = kept if done is None else done.union(kept)
        if parts == 1:
            break
        pool = placed.where("not kept").drop("part", "bin", "offset", "kept")
        # every partition has released a quarter of its pieces at most, or one sequence
        n, turn = pool.count(), turn + 1
        parts = max(1, min(-(-n // part), parts // 2))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def certificate(sequences: DataFrame, size: int = SIZE) -> tuple[int, int]:
    """How many sequences there are, and how many any packing of these pieces has at least.

    At most ``size`` counts reach the driver.
    """
    count = np.zeros(size + 1, np.int64)
    for row in sequences.groupBy("length").count().collect():
        count[row["length"]] = row["count"]
    return sequences.select("sequence_id").distinct().count(), least_bins(count, size)
