"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

A text of up to ``LEAF`` characters is encoded where it is read. A longer one is halved until its
pieces are leaves, wherever the cuts fall; tasks encode leaves in parallel, and neighbours are
joined up a binary tree. A join re-encodes a window around the cut, twice as wide each time, until
both sides agree with it exactly: the window and the left side have a token (same id, same place)
before the cut, and the window and the right side one behind it. Then the left side up to its
token, the window between the two, and the right side from its token on are the encoding of the
whole: every pair of adjacent tokens occurs in an encoding of a text around it, and a sequence
whose adjacent pairs all stand is what byte-pair merging yields.

Words between blanks are encoded independently by this vocabulary, so tasks remember the tokens
of short words (a bounded number of them, see ``MEMORY``) and merge only new ones.

Definite results: null and empty texts give no tokens and decode to an empty text; equal rows
get equal results. An empty table has no rows; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakframe.llm.common import row_key, texts
from cloakframe.llm.words import text_arrays

VOCABULARY = "word_bpe_49k.json"
LEAF = 65_536
MEMORY = 50_000
SHORT_WORD = 48
FIRST_WINDOW = 64
_BLANK = re.compile("[ \n]+")
#: What this module leaves to the tokenizer: possible special tokens, and all but printable
#: ASCII, blanks, and Latin letters whose lower case is one character.
_OTHER = re.compile("<\\||[^ \n!-~\u00c0-\u012f\u0131-\u024f]")
#: Fixed value: the vocabulary's pattern, for the characters above.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters for themselves, the others for 256, 257 and so on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Coder:
    """A tokenizer with a memory of words; one for each Python worker.

    Words of ASCII and accented Latin letters are cut by the vocabulary's pattern here and merged
    by its model; all others, and those that may hold a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.token = [
            self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())
        ]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) > MEMORY:
                self.pieces.clear()
            spelled = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(piece) <= SHORT_WORD:
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if _OTHER.search(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join([self._piece(p) for p in _PIECE.findall(word)])

    def forget(self) -> None:
        """Workers outlive tasks; what a task has learned need not."""
        self.known, self.before, self.pieces = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def decode(self, ids) -> str:
        """As the tokenizer decodes without a decoder: tokens, one space between."""
        return " ".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        if _OTHER.search(text):
            words = [w if _OTHER.search(w) else w.lower() for w in _BLANK.split(text)]
        else:
            words = _BLANK.split(text.lower())
        if len(self.known) > MEMORY:
            self.known, self.before = {}, self.known
        found = self.known
        once = {}
        for word in set(words).difference(found):
            ids = self.before.get(word)
            if ids is None:
                ids = self._word(word)
            if len(word) <= SHORT_WORD:
                found[word] = ids
            else:
                once[word] = ids
        if once:
            ids = b"".join([found[w] if w in found else once[w] for w in words])
        else:
            ids = b"".join(map(found.__getitem__, words))
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist())

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the character each token begins at."""
        code = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(code.ids, np.int64), np.array([o[0] for o in code.offsets], np.int64)


def _agreement(a_ids, a_at, b_ids, b_at, last: bool) -> tuple[int, int] | None:
    """A token that two encodings share: indices in both; the last or the first such.

    Tokens that share the beginning of a character with another token don't count.
    """

    def single(at):
        alone = np.ones(len(at), bool)
        alone[1:] &= at[1:] != at[:-1]
        alone[:-1] &= at[1:] != at[:-1]
        return alone

    keys_a = np.where(single(a_at), (a_at << 20) + a_ids, -1)
    keys_b = np.where(single(b_at), (b_at << 20) + b_ids, -2)
    _, i, j = np.intersect1d(keys_a, keys_b, return_indices=True)
    if not len(i):
        return None
    k = int(np.argmax(i)) if last else int(np.argmin(i))
    return int(i[k]), int(j[k])


def join_codes(coder: Coder, text: str, cut: int, left, right):
    """The encoding (ids, places) of ``text`` from those of text[:cut] and text[cut:].

    Places of ``right`` already count from the beginning of ``text``.
    """
    (l_ids, l_at), (r_ids, r_at) = left, right
    width = FIRST_WINDOW
    while True:
        lo, hi = max(cut - width, 0), min(cut + width, len(text))
        w_ids, w_at = coder.spans(text[lo:hi])
        w_at = w_at + lo
        # the outer tokens of the window may lack their neighbours, those at the cut theirs
        whole_left, whole_right = lo == 0, hi == len(text)
        l_from = np.searchsorted(l_at, lo)
        in_left = np.searchsorted(w_at, cut)
        a = (
            (0, 0)
            if whole_left
            else _agreement(l_ids[l_from:], l_at[l_from:], w_ids[:in_left], w_at[:in_left], False)
        )
        r_to = np.searchsorted(r_at, hi)
        b = (
            (0, 0)
            if whole_right
            else _agreement(r_ids[:r_to], r_at[:r_to], w_ids[in_left:], w_at[in_left:], True)
        )
        if a is not None and b is not None:
            first = 0 if whole_left else a[1]
            end = len(w_ids) if whole_right else in_left + b[1]
            before = 0 if whole_left else l_from + a[0]
            after = len(r_ids) if whole_right else b[0]
            return (
                np.concatenate([l_ids[:before], w_ids[first:end], r_ids[after:]]),
                np.concatenate([l_at[:before], w_at[first:end], r_at[after:]]),
            )
        width *= 2


def cuts(n: int, leaf: int) -> list[int]:
    """Bounds of the leaves of a text of n characters: halves of halves down to ``leaf``."""
    parts = 1
    while n > leaf * parts:
        parts *= 2
    return [n * i // parts for i in range(parts + 1)]


def concatenate(coder: Coder, text: str, bounds: list[int], codes: list) -> tuple[np.ndarray, np.ndarray]:
    """Join the leaves of a text up a binary tree; places in ``codes`` count within the leaf."""
    level = [(i, at + lo) for (i, at), lo in zip(codes, bounds)]
    ends = bounds[1:]
    begin = bounds[0]
    while len(level) > 1:
        up, up_ends, lo = [], [], begin
        for k in range(0, len(level), 2):
            (l_ids, l_at), (r_ids, r_at) = level[k], level[k + 1]
            ids, at = join_codes(
                coder, text[lo : ends[k + 1]], ends[k] - lo, (l_ids, l_at - lo), (r_ids, r_at - lo)
            )
            up.append((ids, at + lo))
            up_ends.append(lo := ends[k + 1])
        level, ends = up, up_ends
    return level[0]


_CODERS: dict[str, Coder] = {}


def coder_of(path: str) -> Coder:
    """The coder of this Python worker."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


_RESULT = "doc_id long, n_tokens long, ids binary, decoded string"


def encode(docs: DataFrame, vocabulary: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and decoded text of every row.

    ``vocabulary`` is the place of a tokenizer file; it must be the same on all executors.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = texts(docs)

    def short(batches):
        coder = coder_of(path)
        for batch in batches:
            codes = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield _result(batch.column("doc_id"), codes)
        coder.forget()

    def cut(batches):
        for batch in batches:
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                bounds = cuts(len(text), leaf)
                n = len(bounds) - 1
                for lo in range(0, n, 64):
                    part = [text[bounds[i] : bounds[i + 1]] for i in range(lo, min(lo + 64, n))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(part), pa.int64()),
                            pa.array([doc] * len(part), pa.int64()),
                            pa.array(range(lo, lo + len(part)), pa.int32()),
                            pa.array(part, pa.string()),
                        ],
                        ["row", "doc_id", "leaf", "text"],
                    )

    def leaves(batches):
        coder = coder_of(path)
        for batch in batches:
            codes = [coder.spans(t) for t in batch.column("text").to_pylist()]
            press = zstandard.ZstdCompressor(level=1).compress  # these are shuffled
            ids = pa.array([press(c[0].astype("<i4").tobytes()) for c in codes], pa.binary())
            at = pa.array([press(np.diff(c[1], prepend=0).astype("<i4").tobytes()) for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, at], [*batch.schema.names, "ids", "at"])

    def tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("leaf")
        coder = coder_of(path)
        part = table.column("text").to_pylist()
        text = "".join(part)
        bounds = np.append(0, np.cumsum([len(p) for p in part])).tolist()
        unpack = zstandard.ZstdDecompressor().decompress
        codes = [
            (np.frombuffer(unpack(i), "<i4").astype(np.int64), np.cumsum(np.frombuffer(unpack(a), "<i4")))
            for i, a in zip(table.column("ids").to_pylist(), table.column("at").to_pylist())
        ]
        ids, _ = concatenate(coder, text, bounds, codes)
        one = _result(
            table.column("doc_id").combine_chunks()[:1],
            [(ids.astype("<u4").tobytes(), coder.decode(ids.tolist()))],
        )
        row = table.column("row").combine_chunks()[:1]
        return pa.table([row, *one.columns], ["row", *one.schema.names])

    is_long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    # repeated rows are counted, so that each has one tree and as many results as rows
    long_rows = rows.where(is_long).withColumn("row", row_key("doc_id", "text"))
    times = long_rows.groupBy("row").agg(F.count("*").alias("times"))
    pieces = (
        long_rows.mapInArrow(cut, "row long, doc_id long, leaf int, text string")
        .dropDuplicates(["row", "leaf"])
        .repartition("row", "leaf")
        .mapInArrow(leaves, "row long, doc_id long, leaf int, text string, ids binary, at binary")
    )
    joined = pieces.groupBy("row").applyInArrow(tree, "row long, " + _RESULT)
    repeated = joined.join(times, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.where(~is_long).mapInArrow(short, _RESULT).union(
        repeated.select("doc_id", "n_tokens", "ids", "decoded")
    )


def _result(doc_id, codes: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            doc_id,
            pa.array([len(ids) // 4 for ids, _ in codes], pa.int64()),
            pa.array([ids for ids, _ in codes], pa.binary()),
            text_arrays([text for _, text in codes]),
        ],
        ["doc_id", "n_tokens", "ids", "decoded"],
    )


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


