"""Toxic text by compression distance.

Two Zstandard dictionaries come from labelled texts. The ordinary one is trained on ordinary text
and followed by ordinary words that look like toxic ones. The toxic one holds every word whose
share of toxic documents exceeds its share of ordinary ones beyond chance; how rare such a word may
be follows from the size of the sample alone, and the dictionary is as long as those words are. A
text is cut into overlapping windows; each is compressed with the ordinary dictionary and with the
ordinary dictionary followed by the toxic one. A window with toxic words gets shorter in the second
case; the largest such gain and the number and share of windows with gains of several sizes are the
evidence of the document, turned into a score by a logistic model in which no evidence lowers the
score. Its threshold is calibrated on training labels.

The fit uses a sample of at most ``TRAIN_ROWS`` labelled documents of each class, chosen by a hash,
with at most ``TRAIN_CHARS`` characters of each (a stretch at a hashed place); scores use whole
texts. Labels of fold 0 (crc32 of the id, modulo 5) are never read.

Definite results: a null or empty text has one empty window, no gain and the lowest score; equal
texts have equal scores; without any labels of one class every score is 0, and no
text scores 0.5 where toxic labels show no more evidence than clean ones do by chance. An empty table
has no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import hashed_sample, texts
from cloakframe.llm.words import LOWER, blocks, buffer_of

WINDOW, STRIDE = 64, 16
TRAIN_ROWS = 3000
TRAIN_CHARS = 20_000
ORDINARY_BYTES = 32_768
FOLDS = 5
PARTS = 8  # of the training sample; each is judged by dictionaries of the others
_EDGES = b".,;:!?*%&$#|\"'()[]{}<>"
CHANCE = 1e-3  # words that would be found by chance in a whole vocabulary without telling words
CLEAN_COST = 2  # weight of the share of clean documents rejected against that of toxic ones passed
_STEPS = (1, 2, 3, 4, 5, 6, 8, 10)  # gains from which windows are counted
_BETTER = 2  # a gain that is evidence
MOST_CLEAN = 0.02  # share of clean documents that may be rejected
CERTAIN = 3  # deviations by which toxic documents must show more evidence than clean ones


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the fold whose labels are never used."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def _words(text: bytes) -> list[bytes]:
    return [w for w in text.split() if w.strip(_EDGES)]


def spread(group: list[bytes]) -> Counter:
    """In how many of the texts each word stands."""
    count = Counter()
    for text in group:
        count.update({w.strip(_EDGES) for w in _words(text)})
    return count


def telling_words(in_toxic: Counter, in_ordinary: Counter, n: int, m: int) -> list[bytes]:
    """Words that stand in more of ``n`` toxic than of ``m`` ordinary texts, the most telling last.

    Where labels have nothing to do with words, a word of t texts is in k or more toxic ones with a
    probability of at most exp(-t * D), D the divergence of k / t from the toxic share of all texts.
    """
    share, most = n / (n + m), math.log(CHANCE / max(len(in_toxic), 1))
    found = []
    for word, k in in_toxic.items():
        t = k + in_ordinary[word]
        if share < 1 and k > share * t:
            clean = (t - k) * math.log((t - k) / t / (1 - share)) if k < t else 0
            chance = -k * math.log(k / t / share) - clean
            if chance < most:
                found.append((-chance, word))
    return [word for _, word in sorted(found)]


def _fragments(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + n] for n in range(4, 9) for i in range(len(padded) - n + 1)}


def lookalikes(words: list[bytes], in_toxic: Counter, in_ordinary: Counter, n: int, m: int) -> list[bytes]:
    """For each fragment of ``words``, the commonest ordinary word that has it.

    They go to the ordinary dictionary, so that only what ordinary words lack makes a gain.
    """
    wanted, known = set().union(*map(_fragments, words)), set(words)
    best: dict[bytes, tuple[int, bytes]] = {}
    for word, k in in_ordinary.items():
        if k >= 3 and word not in known and 3 * k * n >= 2 * in_toxic[word] * m:
            for f in _fragments(word) & wanted:
                best[f] = max(best.get(f, (0, b"")), (k, word))
    return [word for _, word in sorted(set(best.values()))]


def _dictionary(size: int, samples: list[bytes], k: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        3, write_checksum=0, write_content_size=0, write_dict_id=0, min_match=4
    )
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def _compressors(ordinary: bytes, toxic: bytes):
    return _compressor(ordinary), _compressor(ordinary + toxic)


@dataclass
class Model:
    """What tasks are given: two dictionaries, together about 32 KB and the words, and some weights."""

    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def compressors(self):
        return _compressors(self.ordinary, self.toxic)

    def log_odds(self, evidence: np.ndarray) -> np.ndarray:
        return (evidence - self.center) / self.scale @ self.weight + self.bias

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(evidence), -30, 30)))


def gains(pair, lowered: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the toxic dictionary saves in each window, and the row of each window."""
    plain, tinted = pair
    out, rows = [], []
    for row, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for i in range(lo, max(hi - WINDOW + STRIDE, lo + 1), STRIDE):
            part = lowered[i : min(i + WINDOW, hi)]
            out.append(len(plain.compress(part)) - len(tinted.compress(part)))
            rows.append(row)
    return np.array(out), np.array(rows)


def evidence(gain: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per document: largest gain; log count and root of the share of windows with each of _STEPS."""
    size = np.bincount(row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row, np.clip(gain, 0, 16))
    columns = [most]
    for step in _STEPS:
        many = np.bincount(row, weights=gain >= step, minlength=n)
        columns += [np.log1p(many), np.sqrt(many / size)]
    return np.stack(columns, 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + penalty * w
        step = np.linalg.solve((x1.T * (p * (1 - p))) @ x1 + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """A logistic regression without negative weights."""
    on = np.ones(x.shape[1], bool)
    while True:
        weight = np.zeros(len(on))
        weight[on], bias = _logistic(x[:, on], y)
        if (weight >= 0).all():
            return weight, bias
        on[weight.argmin()] = False


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model from a bounded sample of texts of both classes."""
    toxic, ordinary = ([t.encode().lower() for t in dict.fromkeys(g)] for g in (toxic, ordinary))
    if not toxic or not ordinary:
        return None
    counts = [(spread(toxic[i::PARTS]), spread(ordinary[i::PARTS])) for i in range(PARTS)]
    evidence_of, label = [], []
    for part in range(PARTS):
        rest = [[t for i, t in enumerate(g) if i % PARTS != part] for g in (toxic, ordinary)]
        pair = _compressors(*_train(*rest, counts[:part] + counts[part + 1 :]))
        other = [*toxic[part::PARTS], *ordinary[part::PARTS]]
        evidence_of.append(_evidence_of(pair, other))
        label.append(np.arange(len(other)) < len(toxic[part::PARTS]))
    x, y = np.concatenate(evidence_of), np.concatenate(label).astype(float)
    center, scale = x.mean(0), x.std(0) + 1e-9
    weight, bias = _rising((x - center) / scale, y)
    model = Model(*_train(toxic, ordinary, counts), center, scale, weight, bias)
    model.bias -= _cut(model.log_odds(x), y, x[:, 0] >= _BETTER)
    return model


def _train(toxic: list[bytes], ordinary: list[bytes], counts: list[tuple[Counter, Counter]]) -> tuple[bytes, bytes]:
    """Both dictionaries; ``counts`` are the word counts of parts that together are the texts."""
    in_toxic, in_ordinary = Counter(), Counter()
    for of_toxic, of_ordinary in counts:
        in_toxic.update(of_toxic)
        in_ordinary.update(of_ordinary)
    known = in_toxic, in_ordinary, len(toxic), len(ordinary)
    words = telling_words(*known) if toxic and ordinary else []
    pieces = [t[i : i + 64] for t in ordinary for i in range(0, len(t), 64)]
    keep = np.random.default_rng(0).permutation(len(pieces))[:60_000]
    plain = _dictionary(ORDINARY_BYTES, [pieces[i] for i in keep], 32)[-ORDINARY_BYTES + 256 :]
    return plain + _joined(lookalikes(words, *known)), _joined(words)


def _joined(words: list[bytes]) -> bytes:
    return b"".join(b" " + w + b" " for w in words)


def _evidence_of(pair, group: list[bytes]) -> np.ndarray:
    bounds = np.append(0, np.cumsum([len(t) for t in group]))
    gain, row = gains(pair, b"".join(group), bounds)
    return evidence(gain, row, len(group)) if len(group) else np.zeros((0, 1 + 2 * len(_STEPS)))


def _cut(score: np.ndarray, y: np.ndarray, seen: np.ndarray) -> float:
    """The score where training labels err least, amid the gap there; above all where nothing tells.

    Toxic documents count by their share of those with evidence (``seen``), others for nothing. At
    most ``MOST_CLEAN`` of the clean documents are rejected.
    """
    order = np.argsort(-score, kind="stable")
    s, t, seen = score[order], y[order], seen[order].astype(float)
    bad, clean = max(t.sum(), 1), max((1 - t).sum(), 1)
    in_bad, in_clean = (t * seen).sum() / bad, ((1 - t) * seen).sum() / clean
    both = (seen.sum() + 1) / (len(s) + 2)
    if in_bad - in_clean < CERTAIN * math.sqrt(both * (1 - both) * (1 / bad + 1 / clean)):
        return float(s[0]) + 2
    lost = np.append(0, np.cumsum((1 - t) / clean))
    errors = CLEAN_COST * lost - np.append(0, np.cumsum(t * seen)) / (in_bad * bad)
    errors[lost > MOST_CLEAN] = np.inf
    # no cut goes through equal scores
    between = np.append(True, np.append(s[:-1] - s[1:] > 1e-9, True))
    i = int(np.where(between, errors, np.inf).argmin())
    hi, lo = s[i - 1] if i else s[0] + 2, s[i] if i < len(s) else s[-1] - 2
    return float(hi + lo) / 2


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on training folds of ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text)."""
    rated = labels.select("doc_id", "toxic").where(~held_out() & F.col("toxic").isin(0, 1))
    by_hash = F.xxhash64(F.lit("toxicity sample"), "doc_id")
    total = {r.toxic: r["count"] for r in rated.groupBy("toxic").count().collect()}
    chosen = None
    for label in (1, 0):
        of_label = rated.where(F.col("toxic") == label)
        part = hashed_sample(of_label, by_hash, TRAIN_ROWS, total.get(label, 0))
        chosen = part if chosen is None else chosen.union(part)
    # twice TRAIN_ROWS ids at most: the size of this broadcast is bounded by a parameter
    found = texts(docs).join(F.broadcast(chosen), "doc_id")
    start = 1 + F.pmod(by_hash, F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)))
    sample = found.select(
        "toxic", F.substring("text", start.cast("int"), F.lit(TRAIN_CHARS)).alias("text"), "doc_id"
    )
    # repeated ids could multiply the rows; at most four times TRAIN_ROWS reach the driver
    rows = sample.orderBy("doc_id", F.xxhash64("text")).limit(4 * TRAIN_ROWS).collect()
    return fit(*([r.text or "" for r in rows if r.toxic == label] for label in (1, 0)))


def _scores(model: Model | None, batches):
    """Record batches with the scores of their texts."""
    pair = model and model.compressors()
    for batch in blocks(batches, "text"):
        value = np.zeros(batch.num_rows)
        if model:
            data, bounds = buffer_of(batch.column("text"))
            gain, row = gains(pair, LOWER[data].tobytes(), bounds)
            value = model.score(evidence(gain, row, batch.num_rows))
        yield batch, value


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch, value in _scores(shared.value, batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    return texts(docs).mapInArrow(work, "doc_id long, score double")


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch, value in _scores(shared.value, batches):
            yield batch.filter(pa.array(value < threshold))

    return docs.mapInArrow(work, docs.schema)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
