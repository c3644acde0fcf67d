"""Secrets in texts: keywords by Aho-Corasick, anchored patterns at hits, checksums last.

One automaton walks over a block of texts (ASCII letters lowered). A pattern is only tried at the
place where its keyword stands, so its cost does not depend on text without keywords. Runs of
hexadecimal digits have no keyword; their prefilter is a run-length test over bytes. Candidates
with an embedded checksum are kept only if it holds.

Spans count code points, end exclusive. Within a kind they are the leftmost, non-overlapping
matches. Null and empty texts have no secrets; equal rows get equal results.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import texts
from cloakframe.llm.words import blocks, buffer_of, find_words

#: Kinds in the order used for ties.
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE = 3
ASSIGN = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Prefix, 30 characters, and their CRC-32 as 6 base-62 digits.
CHECKED = re.compile(rb"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "password": 0,
    "passwd": 0,
    "secret": 0,
    "token": 0,
    "apikey": 0,
    "api_key": 0,
    "akia": 1,
    **dict.fromkeys(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], 3),
    "npm_": 4,
}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
HEX = np.zeros(256, bool)
HEX[[*b"0123456789abcdef"]] = True


def base62_crc(body: bytes) -> bytes:
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit : digit + 1] + out
    return out


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (len(word), kind))
    machine.make_automaton()
    return machine


def scan(machine, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, kind, end) of all secrets in a block of texts, in bytes of the block."""
    raw = data.tobytes()
    found = []
    begins, limits = [], []
    hits = [
        (last + 1 - size, kind) for last, (size, kind) in machine.iter(raw.lower().decode("latin-1"))
    ]
    if hits:
        row = np.searchsorted(offsets, [h[0] for h in hits], "right") - 1
        begins, limits = row.tolist(), offsets[row + 1].tolist()
    done = [-1] * len(KINDS)
    for (start, kind), row, limit in sorted(zip(hits, begins, limits)):
        if start < done[kind]:
            continue
        if kind == 0:
            m = ASSIGN.match(raw, start, limit)
            good = m and len(m[1]) >= LEAST_VALUE
        elif kind == 1:
            m = ACCESS.match(raw, start, limit)
            good = m and len(m[0]) >= LEAST_ACCESS
        else:
            m = CHECKED.match(raw, start, limit)
            good = m and base62_crc(m[2]) == m[3]
        if m:
            done[kind] = m.end()
            if good:
                found.append((row, start, kind, m.end()))
    runs = find_words(data, offsets, HEX)
    long = np.flatnonzero(runs.end - runs.start >= LEAST_HEX)
    rows = np.searchsorted(offsets, runs.start[long], "right") - 1
    found += zip(
        rows.tolist(), runs.start[long].tolist(), [2] * len(long), runs.end[long].tolist()
    )
    return sorted(found)


def _spans(batches):
    machine = automaton()
    for batch in blocks(batches, "text"):
        data, offsets = buffer_of(batch.column("text"))
        found = scan(machine, data, offsets)
        out = [[] for _ in range(batch.num_rows)]
        if found:
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            for row, start, kind, end in found:
                base = points[offsets[row]]
                out[row].append(
                    {"kind": KINDS[kind], "start": points[start] - base, "end": points[end] - base}
                )
        yield batch.append_column("secrets", pa.array(out, _SPAN))


_SPAN = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
)
_SECRETS = "secrets array<struct<kind: string, start: bigint, end: bigint>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``secrets``, by start and then kind."""
    return texts(docs).mapInArrow(_spans, f"doc_id long, text string, {_SECRETS}")


def _listed(kinds: list[str]):
    keep = F.filter("secrets", lambda s: s.kind.isin(kinds)) if len(kinds) < len(KINDS) else F.col("secrets")
    one = F.transform(
        keep, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    )
    return F.array_join(one, ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts, the listing of all spans and a digest of the listing of the base kinds."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:BASE]),
        F.sha2(F.encode(_listed(KINDS[:BASE]), "UTF-8"), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """The text with each stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with secrets in ``text`` replaced and n_chars as it is then."""
    columns = docs.columns
    fields = docs.schema

    def work(batches):
        machine = automaton()
        for batch in blocks(batches, "text"):
            data, offsets = buffer_of(batch.column("text"))
            value = batch.column("text").to_pylist()
            found = scan(machine, data, offsets)
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if found else None
            by_row: dict[int, list[tuple[int, int]]] = {}
            for row, start, _, end in found:
                span = points[[start, end]] - points[offsets[row]]
                by_row.setdefault(row, []).append(tuple(span.tolist()))
            for row, spans in by_row.items():
                value[row] = redacted(value[row], spans)
            changed = {"text": pa.array(value, pa.string())}
            if "n_chars" in columns:
                old = batch.column("n_chars").to_pylist()
                for row in by_row:
                    old[row] = len(value[row])
                changed["n_chars"] = pa.array(old, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(
                [changed.get(c, batch.column(c)) for c in columns], columns
            )

    return docs.mapInArrow(work, fields)


