"""Hard negatives by maximum inner products over an STR-packed R-tree.

All vectors are packed into an R-tree by sort-tile-recursion: the table is cut into ranges of its most
varied coordinate, a range into slabs of the next one, and so on down to pages and leaves, so that
neighbours share a box. Boxes give an interval for each coordinate, and with it bounds of the inner
product of an anchor with anything inside.

The anchors of one range, a block, meet the pages whose boxes may hold something for them. In a page an
anchor takes leaves from a queue, highest bound first, and stops at the first leaf that is strictly
below the k-th score it already has, or outside all its score windows. This runs three times: over the
pages of the anchors' own range, which leaves each anchor a first k-th score; over all others for the
positives; and over all pages for the negatives, whose windows follow from the positives.

A page and a block of anchors meet in one task at a time; pages go only where bounds allow it. Nothing
is approximated or capped.

Definite results: rows with a null id, label or vector, or a null or non-finite component take no part;
of rows that repeat an id the one with the least label and vector does; a shorter vector counts as one
with zeros at its end; ties go to the smaller id. Results are exact while ``256 * x`` fits 31 bits and
scores fit 63. Other columns are left alone; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import prepare, stored

SCALE = 256
ANCHORS = 50  # every so many ids is an anchor
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative has so many hundredths of the positive's score
PAGE, LEAF = 2048, 64
STEP = 4  # leaves that an anchor takes from its queue at once
RANGE_PAGES = 8  # pages that a range of the first coordinate is expected to fill
_PAGE = "page long, lo binary, hi binary, ids binary, labels binary, vectors binary, sizes binary, low binary, high binary"


@dataclass
class Tree:
    """Pages with their boxes (a table), the number of coordinates, and of ranges of the first axis."""

    pages: DataFrame
    dim: int
    ranges: int


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, q (whole numbers) of the rows that take part."""
    prepare()
    x = F.col("embedding")
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    # the comparison is null for a null component, and forall then not true
    finite = F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return (
        table.where(vec_id.isNotNull() & label.isNotNull() & x.isNotNull())
        .where(F.coalesce(finite, F.lit(False)))
        .select(
            vec_id.alias("vec_id"),
            moved.alias("label"),
            F.transform(x, lambda v: F.floor(F.lit(SCALE) * v.cast("double")).cast("long")).alias("q"),
        )
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "q")).alias("row"))
        .select("vec_id", "row.label", "row.q")
    )


def tiles(x: np.ndarray, axes: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of STR tiles of about ``size`` rows: slabs of one axis, cut along the next."""
    n = len(x)
    if n <= size:
        return [np.arange(n)]
    if len(axes) <= 1:
        order = np.argsort(x[:, axes[0]], kind="stable") if len(axes) else np.arange(n)
        return [order[i : i + size] for i in range(0, n, size)]
    parts = -(-n // size)
    slabs = int(np.ceil(parts ** (1 / len(axes))))
    rows = -(-n // slabs)
    order = np.argsort(x[:, axes[0]], kind="stable")
    found = []
    for i in range(0, n, rows):
        slab = order[i : i + rows]
        found += [slab[t] for t in tiles(x[slab], axes[1:], size)]
    return found


def _rows_of(batches, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and the matrix of vectors, short ones filled up with zeros."""
    table = pa.Table.from_batches(batches)
    q = table.column("q").combine_chunks()
    size = np.diff(q.offsets.to_numpy())
    flat = np.asarray(q.flatten(), np.int64)
    x = np.zeros((len(size), dim), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    x[np.repeat(np.arange(len(size)), size), at] = flat
    return table.column("vec_id").to_numpy(), table.column("label").to_numpy(), x


def _packer(dim: int, axes: np.ndarray):
    def pack(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        ids, labels, x = _rows_of(batches, dim)
        first = TaskContext.get().partitionId() * 2**32
        for number, page in enumerate(tiles(x, axes[1:4], PAGE)):
            leaves = [page[t] for t in tiles(x[page], axes[1:4], LEAF)]
            order = np.concatenate(leaves)
            low = np.stack([x[leaf].min(0) for leaf in leaves])
            high = np.stack([x[leaf].max(0) for leaf in leaves])
            parts = (low.min(0), high.max(0), ids[order], labels[order], x[order],
                     np.array([len(leaf) for leaf in leaves]), low, high)
            cells = [pa.array([p.astype("<i8").tobytes()], pa.binary()) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([first + number]), *cells], [c.split()[0] for c in _PAGE.split(", ")])

    return pack


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with anything in each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return _dot(up, low) + _dot(down, high), _dot(up, high) + _dot(down, low)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers; in floating point where that is exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


_LEAST = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max


def _merge(score: np.ndarray, who: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> None:
    """Let what was found (rows, windows, scores, ids) into the k best of each row and window, in place.

    Higher scores come first, then smaller ids.
    """
    windows, k = score.shape[1:]
    at = np.nonzero(who != _NO_ID)
    parts = [(at[0], at[1], score[at], who[at]), *found]
    row, window, value, ids = (np.concatenate(p) for p in zip(*parts))
    key = row * windows + window
    order = np.lexsort((ids, -value, key))
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    place = np.arange(len(key))
    place = place - np.maximum.accumulate(np.where(new, place, 0))
    top = place < k
    for held, values in ((score, value), (who, ids)):
        held.reshape(-1, k)[key[top], place[top]] = values[order][top]


class Page:
    """A page of the tree as a task holds it."""

    def __init__(self, row: dict, dim: int):
        def matrix(name):
            return np.frombuffer(row[name], "<i8").reshape(-1, dim)

        self.ids, self.labels, sizes = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "sizes"))
        self.x, self.low, self.high = matrix("vectors"), matrix("low"), matrix("high")
        self.at = np.append(0, np.cumsum(sizes))

    def queue(self, a: np.ndarray):
        """For each anchor its leaves by falling bound, and their least and largest scores."""
        least, most = bounds(a, self.low, self.high)
        order = np.argsort(-most, axis=1, kind="stable")
        return order, np.take_along_axis(least, order, 1), np.take_along_axis(most, order, 1)

    def turns(self, a: np.ndarray, going):
        """Anchors, leaves and scores, turn by turn: each anchor takes the next ``STEP`` leaves of its queue.

        ``going(rows, least, most)`` says which anchors still want a leaf, and which have ended for good.
        """
        order, least, most = self.queue(a)
        rows = np.arange(len(a))
        exact = float(np.abs(a).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * a.shape[1] < 2.0**53
        left, right = (a.astype(float), self.x.astype(float)) if exact else (a, self.x)
        for turn in range(0, order.shape[1], STEP):
            asked, leaf = [], []
            for at in range(turn, min(turn + STEP, order.shape[1])):
                wanted, ended = going(rows, least[rows, at], most[rows, at])
                asked.append(rows[wanted])
                leaf.append(order[rows[wanted], at])
            asked, leaf = np.concatenate(asked), np.concatenate(leaf)
            by_leaf, looked = np.argsort(leaf, kind="stable"), []
            for mine in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1) if len(leaf) else []:
                t, mine = leaf[mine[0]], asked[mine]
                part = slice(self.at[t], self.at[t + 1])
                looked.append((mine, part, (left[mine] @ right[part].T).astype(np.int64)))
            yield looked
            rows = rows[~ended]
            if not len(rows):
                break

    def positives(self, ids, labels, a, kth, k=POSITIVES):
        """The best k rows of each anchor's label, none of them strictly below ``kth``."""
        score, who = np.full((len(a), 1, k), _LEAST), np.full((len(a), 1, k), _NO_ID)

        def least_of(rows):
            return np.maximum(np.maximum(kth[rows], score[rows, 0, -1]), _LEAST + 1)

        def going(rows, least, most):
            out = most < least_of(rows)
            return ~out, out

        for looked in self.turns(a, going):
            found = []
            for mine, part, scores in looked:
                good = (self.labels[part] == labels[mine, None]) & (self.ids[part] != ids[mine, None])
                i, j = np.nonzero(good & (scores >= least_of(mine)[:, None]))
                found.append((mine[i], np.zeros(len(i), np.int64), scores[i, j], self.ids[part][j]))
            _merge(score, who, found)
        return score[:, 0], who[:, 0]

    def negatives(self, labels, a, low, high, k=NEGATIVES):
        """The best k rows of other labels in each window [low, high] (anchor, window) of scores."""
        score, who = np.full((*low.shape, k), _LEAST), np.full((*low.shape, k), _NO_ID)

        def going(rows, least, most):
            # a window is done with a leaf below it or strictly below its k-th, not with one above it
            out = most[:, None] < np.maximum(low[rows], score[rows, :, -1])
            inside = ~out & (least[:, None] <= high[rows])
            return inside.any(1), out.all(1)

        for looked in self.turns(a, going):
            found = []
            for mine, part, scores in looked:
                scores = np.where(self.labels[part] == labels[mine, None], _LEAST, scores)
                least = np.maximum(np.maximum(low[mine], score[mine, :, -1]), _LEAST + 1)
                for w in np.flatnonzero((scores.max(1)[:, None] >= least).any(0)).tolist():
                    i, j = np.nonzero((scores >= least[:, w, None]) & (scores <= high[mine, w, None]))
                    found.append((mine[i], np.full(len(i), w), scores[i, j], self.ids[part][j]))
            _merge(score, who, found)
        return score, who


def _anchors(table: pa.Table, dim: int):
    return (
        table.column("vec_id").to_numpy(),
        table.column("label").to_numpy(),
        np.array([np.frombuffer(v, "<i8") for v in table.column("vector").to_pylist()], np.int64).reshape(-1, dim),
    )


def _found(*columns) -> pa.Table:
    return pa.table({name: pa.array(value, pa.int64()) for name, value in columns})


def _positive_search(dim: int):
    def search(page: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, labels, a = _anchors(anchors, dim)
        rows = [] if not len(ids) else page.to_pylist()
        kth = anchors.column("kth").to_numpy()
        parts = [Page(r, dim).positives(ids, labels, a, kth) for r in rows]
        score = np.concatenate([s for s, _ in parts], 1) if parts else np.zeros((0, 1), np.int64)
        who = np.concatenate([w for _, w in parts], 1) if parts else np.zeros((0, 1), np.int64)
        keep = who != _NO_ID
        anchor = np.broadcast_to(ids[:, None], who.shape)[keep] if parts else ids[:0]
        return _found(("anchor_id", anchor), ("positive_id", who[keep]), ("score", score[keep]))

    return search


def _negative_search(dim: int):
    def search(page: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, labels, a = _anchors(anchors, dim)
        wins = anchors.column("positives").to_pylist()
        size = max((len(w) for w in wins), default=0)
        # an unused window is empty
        at = np.array([[p["score"] for p in w] + [-1] * (size - len(w)) for w in wins], np.int64).reshape(-1, size)
        who_for = np.array([[p["id"] for p in w] + [_NO_ID] * (size - len(w)) for w in wins], np.int64).reshape(-1, size)
        low, high = windows(at)
        out = [[], [], [], []]
        for r in page.to_pylist() if len(ids) and size else []:
            score, who = Page(r, dim).negatives(labels, a, low, high)
            keep = who != _NO_ID
            for part, values in zip(out, (ids[:, None, None], who_for[..., None], who, score)):
                part.append(np.broadcast_to(values, who.shape)[keep])
        names = ("anchor_id", "positive_id", "negative_id", "negative_score")
        return _found(*((n, np.concatenate(p) if p else np.zeros(0, np.int64)) for n, p in zip(names, out)))

    return search


def windows(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of a negative for each positive's score; empty below zero."""
    return -((-LOW * score) // 100), (HIGH * score) // 100


def _allowed(dim: int):
    """Pairs of a page and a block whose boxes allow a score that the block wants."""

    def work(batches):
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                box = {k: np.frombuffer(row[k], "<i8") for k in ("lo", "hi", "a_lo", "a_hi")}
                corners = [box[a] * box[p] for a in ("a_lo", "a_hi") for p in ("lo", "hi")]
                most, least = np.maximum.reduce(corners).sum(), np.minimum.reduce(corners).sum()
                keep.append(bool(most >= row["at_least"] and least <= row["at_most"]))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["block", "page"])

    return work


def _boxes(dim: int):
    """The box of the anchors of each block, and the scores they ask for."""

    def box(table: pa.Table) -> pa.Table:
        _, _, a = _anchors(table, dim)
        return pa.table(
            {
                "block": table.column("block")[:1],
                "a_lo": pa.array([a.min(0).astype("<i8").tobytes()], pa.binary()),
                "a_hi": pa.array([a.max(0).astype("<i8").tobytes()], pa.binary()),
                "at_least": pa.array([table.column("at_least").to_numpy().min()], pa.int64()),
                "at_most": pa.array([table.column("at_most").to_numpy().max()], pa.int64()),
            }
        )

    return box


_BOX = "block long, a_lo binary, a_hi binary, at_least long, at_most long"


def _meet(tree: Tree, anchors: DataFrame, search, schema: str, own: bool | None = None) -> DataFrame:
    """Search every page for the anchors (block, at_least, at_most, ...) of the blocks it may serve.

    ``own``: only pages of the block's own range, or only others.
    """
    pages, dim = tree.pages, tree.dim
    asked = anchors.select("block", "vec_id", "label", "vector", "at_least", "at_most")
    boxes = asked.groupBy("block").applyInArrow(_boxes(dim), _BOX)
    range_of = F.shiftright("page", 32)
    if own:
        pairs = pages.select("page", range_of.alias("block")).join(boxes.select("block"), "block")
    else:
        # the box of every page against that of every block of anchors: no vectors move yet
        listed = F.explode(F.sequence(F.lit(0), F.lit(tree.ranges - 1)).cast("array<long>")).alias("block")
        pairs = pages.select("page", "lo", "hi", listed)
        if own is False:
            pairs = pairs.where(range_of != F.col("block"))
        pairs = pairs.join(boxes, "block").mapInArrow(_allowed(dim), "block long, page long")
    pairs = stored(pairs.select("block", "page"), "pairs")
    left = pairs.join(pages.drop("lo", "hi"), "page").groupBy("block", "page")
    right = pairs.toDF("of", "at").join(anchors.withColumnRenamed("block", "of"), "of").groupBy("of", "at")
    return left.cogroup(right).applyInArrow(search, schema)


def _top(rows: DataFrame, keys: list[str], score: str, who: str, k: int) -> DataFrame:
    """The k best rows of each key, with ``rank``; Spark cuts to k in each task before it shuffles."""
    best = Window.partitionBy(*keys).orderBy(F.desc(score), who)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pack(rows: DataFrame) -> Tree | None:
    """The tree of all rows (vec_id, label, q); None where there is nothing to pack."""
    spread = rows.select(F.posexplode("q").alias("at", "v")).groupBy("at")
    spread = spread.agg(F.var_pop(F.col("v").cast("double")).alias("spread"), F.count("*").alias("n")).collect()
    if not spread:
        return None
    dim, n = 1 + max(r["at"] for r in spread), max(r["n"] for r in spread)
    axes = np.array([r["at"] for r in sorted(spread, key=lambda r: (-r["spread"], r["at"]))])
    ranges = max(1, -(-n // (PAGE * RANGE_PAGES)))
    first = F.coalesce(F.get("q", F.lit(int(axes[0]))), F.lit(0)).alias("first")
    # ids part equal vectors, so that a common one is spread over ranges
    cut = rows.select("vec_id", "label", "q", first).repartitionByRange(ranges, "first", "vec_id")
    pages = stored(cut.select("vec_id", "label", "q").mapInArrow(_packer(dim, axes), _PAGE), "rtree")
    return Tree(pages, dim, ranges)


def _anchor_rows(dim: int):
    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
                x = np.frombuffer(row["vectors"], "<i8").reshape(-1, dim)
                at = np.flatnonzero(ids % ANCHORS == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["page"] >> 32] * len(at), pa.int64()),
                        pa.array(ids[at], pa.int64()),
                        pa.array(labels[at], pa.int64()),
                        pa.array([v.tobytes() for v in x[at]], pa.binary()),
                    ],
                    ["block", "vec_id", "label", "vector"],
                )

    return work


_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def mine(table: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    tree = pack(stored(vectors(table), "vectors"))
    if tree is None:
        return table.sparkSession.createDataFrame([], _RESULT)
    dim = tree.dim
    listed = tree.pages.select("page", "ids", "labels", "vectors")
    anchors = stored(
        listed.mapInArrow(_anchor_rows(dim), "block long, vec_id long, label long, vector binary"), "anchors"
    )
    every = (F.lit(_LEAST).alias("at_least"), F.lit(_NO_ID).alias("at_most"))
    found = "anchor_id long, positive_id long, score long"
    near = stored(
        _meet(tree, anchors.select("*", F.lit(_LEAST).alias("kth"), *every), _positive_search(dim), found, True),
        "near",
    )
    best = _top(near, ["anchor_id"], "score", "positive_id", POSITIVES)
    kth = best.where(F.col("rank") == POSITIVES).select(F.col("anchor_id").alias("vec_id"), F.col("score").alias("kth"))
    asked = anchors.join(kth, "vec_id", "left").withColumn("kth", F.coalesce("kth", F.lit(_LEAST)))
    asked = stored(asked.select("*", F.col("kth").alias("at_least"), F.lit(_NO_ID).alias("at_most")), "asked")
    far = _meet(tree, asked, _positive_search(dim), found, False)
    positives = stored(
        _top(near.union(far), ["anchor_id"], "score", "positive_id", POSITIVES).drop("rank"), "positives"
    )
    wanted = positives.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("score", F.col("positive_id").alias("id"))).alias("positives"),
        F.min(F.ceil(F.col("score") * LOW / 100).cast("long") - 1).alias("at_least"),
        F.max(F.ceil(F.col("score") * HIGH / 100).cast("long") + 1).alias("at_most"),
    )
    asked = stored(anchors.join(wanted, "vec_id"), "asked")
    hits = _meet(
        tree, asked, _negative_search(dim),
        "anchor_id long, positive_id long, negative_id long, negative_score long",
    )
    best = _top(hits, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
    return best.join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("score").alias("positive_score"), "negative_score",
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""
