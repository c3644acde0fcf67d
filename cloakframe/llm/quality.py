"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes score over binned features of its whole text, with bin
counts gathered over all training labels and the score calibrated on a histogram of it. Sites
then have a say: documents of a host share a posterior rate of good documents, those of a path below
it another. The host's rate is shrunk towards the global one, the path's towards its host's; how
much is estimated from how much hosts (paths) differ beyond chance. A document is left out of its
own site's rates. Everything that is counted over the corpus is a grouped aggregation.

The driver only sees tables of bounded size: bins, a histogram and a few sums. Labels of fold 0
(crc32 of the id, modulo 5) are never read.

Definite results: null and empty texts have the features of no words; a null host or path is a
site of its own; without labels of both classes the evidence is even and scores are 0.5. An
empty table has no rows; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import stored
from cloakframe.llm.words import NOT_SPACE, blocks, buffer_of, find_words

FOLDS = 5
#: Upper edges of the bins of each feature.
EDGES = {
    "words": [1, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096],
    "symbols": [0.001, 0.01, 0.05, 0.1, 0.2, 0.5, 1, 2],
    "capitals": [0.001, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75, 0.9],
    "distinct": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99],
    "length": [2, 3, 4, 5, 6, 7, 8, 10, 14, 20],
    "stops": [0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.5],
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*|!~^<>{}[]@=+_\\/"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_LETTER = _CAPITAL.copy()
_LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".?!;:"]] = True
CELLS = 400  # of the histogram of scores


def bins(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bin numbers (documents, features) of a block of texts."""
    w = find_words(data, offsets, NOT_SPACE)
    n = np.diff(w.first)
    row = w.row_of_word()
    h = w.hashes()
    order = np.lexsort((h, row))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1]))
    distinct = np.bincount(row[order][new[: len(row)]], minlength=w.rows)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    letters = share(_LETTER[data], np.ones(w.rows))
    size = np.bincount(row, weights=w.end - w.start, minlength=w.rows)
    stops = np.bincount(row, weights=_STOP[data[w.end - 1]] if len(row) else None, minlength=w.rows)
    values = {
        "words": n,
        "symbols": share(_SYMBOL[data], n),
        "capitals": share(_CAPITAL[data], letters),
        "distinct": distinct / np.maximum(n, 1),
        "length": size / np.maximum(n, 1),
        "stops": stops / np.maximum(n, 1),
    }
    return np.stack([np.searchsorted(EDGES[f], values[f]) for f in EDGES], 1)


def features(docs: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path and a small array of bins for every document."""

    def work(batches):
        for batch in blocks(batches, "text"):
            found = bins(*buffer_of(batch.column("text"))).astype(np.int32)
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "host", "path")),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(EDGES)), pa.array(found.reshape(-1))
                    ),
                ],
                ["doc_id", "host", "path", "bins"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.col(path).cast("string").alias("path"),
        F.col("text").alias("text"),
    )
    return rows.mapInArrow(work, "doc_id long, host string, path string, bins array<int>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def evidence_weights(labelled: DataFrame) -> list[list[float]]:
    """Log likelihood ratio of every bin of every feature, smoothed."""
    counted = (
        labelled.select("good", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin", "good")
        .count()
        .collect()  # at most one row for each bin and class
    )
    out = []
    for f, edges in enumerate(EDGES.values()):
        seen = np.ones((2, len(edges) + 1))
        for r in counted:
            if r.feature == f:
                seen[int(r.good), r.bin] += r["count"]
        share = np.log(seen / seen.sum(1, keepdims=True))
        out.append((share[1] - share[0]).tolist())
    return out


def _raw(weights: list[list[float]]):
    table = F.array(*(F.array(*map(F.lit, row)) for row in weights))
    terms = F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda i: table[i][F.get("bins", i)])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def calibration(labelled: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the log-odds of a good document over the raw score."""
    cell = F.round(F.greatest(F.least(F.col("raw"), F.lit(40.0)), F.lit(-40.0)) * (CELLS / 80)).cast("int")
    rows = labelled.groupBy(cell.alias("cell"), "good").count().collect()
    if len({r.good for r in rows}) < 2:
        return 0.0, 0.0
    x = np.array([[r.cell * 80 / CELLS, 1.0] for r in rows])
    y = np.array([float(r.good) for r in rows])
    n = np.array([float(r["count"]) for r in rows])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 0.1 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _strength(between: float, rate: float) -> float:
    """Prior weight, in documents, of a rate whose true spread has this variance."""
    return float(np.clip(rate * (1 - rate) / max(between, 1e-9) - 1, 1.0, 1e6))


def _spread(groups: DataFrame, own: str, total: str, above) -> float:
    """Variance of group rates around ``above`` beyond what chance within groups explains.

    ``groups`` has ``total`` documents with sum ``own`` and sum of squares ``squares``.
    """
    mean = F.col(own) / F.col(total)
    r = groups.select(
        F.sum(F.col(total) * F.pow(mean - above, 2)).alias("between"),
        F.sum(F.col("squares") - F.col(own) * mean).alias("within"),
        F.sum(total).alias("n"),
        F.count("*").alias("k"),
    ).first()
    if not r.n or r.n <= r.k:
        return 0.0
    noise = r.within / (r.n - r.k)
    return max(r.between - r.k * noise, 0.0) / r.n


def rate(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score and keep for every document."""
    rows = stored(features(docs, host, path).withColumn("held_out", held_out()), "features")
    good = labels.where(~held_out() & F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")
    )
    labelled = rows.join(good, "doc_id").select("bins", "good")
    weights = evidence_weights(labelled)
    slope, shift = calibration(labelled.withColumn("raw", _raw(weights)))
    odds = F.lit(slope) * _raw(weights) + F.lit(shift)
    scored = rows.withColumn("odds", odds).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))

    paths = scored.groupBy("host", "path").agg(
        F.sum("p").alias("path_sum"), F.sum(F.pow("p", F.lit(2))).alias("squares"), F.count("*").alias("path_n")
    )
    hosts = paths.groupBy("host").agg(
        F.sum("path_sum").alias("host_sum"), F.sum("squares").alias("squares"), F.sum("path_n").alias("host_n")
    )
    whole = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    prior = min(max((whole.s or 0.5) / (whole.n or 1), 1e-3), 1 - 1e-3)
    host_weight = _strength(_spread(hosts, "host_sum", "host_n", F.lit(prior)), prior)
    of_host = hosts.drop("squares").withColumnRenamed("host", "site_host")
    sites = paths.join(of_host, F.col("host").eqNullSafe(F.col("site_host"))).drop("site_host")
    path_weight = _strength(
        _spread(sites, "path_sum", "path_n", F.col("host_sum") / F.col("host_n")), prior
    )
    of_site = sites.drop("squares").withColumnsRenamed({"host": "site_host", "path": "site_path"})
    same_site = F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    joined = scored.join(of_site, same_site)
    host_rate = (F.col("host_sum") - F.col("p") + host_weight * prior) / (F.col("host_n") - 1 + host_weight)
    path_rate = (F.col("path_sum") - F.col("p") + path_weight * F.col("host_rate")) / (
        F.col("path_n") - 1 + path_weight
    )
    logit = lambda c: F.log(c / (1 - c))
    inside = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("odds") + logit(inside) - logit(F.lit(prior)))))
    return (
        joined.withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("score", score)
        .select(
            "doc_id",
            "held_out",
            F.col("p").alias("evidence"),
            "host_rate",
            "path_rate",
            "score",
            (F.col("score") >= 0.5).alias("keep"),
        )
    )
