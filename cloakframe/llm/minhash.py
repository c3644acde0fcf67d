"""Near-duplicate documents: ProbMinHash over weighted word shingles, banding, verification.

A document is the multiset of its runs of ``SHINGLE`` words (ASCII letters lowered; a text of
fewer words is one run). Similarity is the probability Jaccard of the shingle counts, which for
distinct shingles is the ordinary Jaccard; documents are linked at ``SIMILARITY`` or more.

Signature: every shingle is a Poisson process whose rate is its count. Each arrival picks one of
``COMPONENTS`` places at random, a place keeps its first arrival, and a document's processes stop
once they are later than all its places. Two documents agree in a place with probability equal
to their similarity. Places are hashed in ``BANDS`` bands of ``ROWS``; a pair at similarity 0.8
misses all bands with probability below 3e-6.

Groups of copies never become all pairs. Equal texts are one node from the start. In a bucket all
nodes are compared with one node in the middle, one of ``MIDDLES`` orders deciding which, exactly, on
their whole texts, and links become components. Buckets that still hold several components take ``TURNS`` more
turns with other middles, now against nodes of other components only. What even then holds several
components is compared in blocks inside tasks: nodes outside the largest component of the bucket
against all its nodes, signatures first (five deviations are allowed), then whole texts, and only as
long as the two are still in different components. A block emits the links that join components,
never its pairs. Nothing is capped: turns only leave less for the last step.

Definite results: texts without words are linked to nothing but equal texts; null counts as
empty; repeated rows are copies. An empty table has no rows; other columns, whatever their names,
are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import shared_dir, stored, texts, unused
from cloakframe.llm.words import (
    LOWER,
    NOT_SPACE,
    Words,
    blocks,
    find_words,
    mix,
    window_hashes,
    words_of,
)

SHINGLE = 5
SIMILARITY = 0.8
COMPONENTS, BANDS, ROWS = 256, 42, 6
MIDDLES = 8
TURNS = 1
MEMORY = 2_000_000  # shingles that a task keeps parsed
BLOCK = 256  # nodes on a side of a block of signatures


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of a block, sorted by row and hash."""
    h, size = w.hashes(), np.diff(w.first)
    parts = []
    for k in range(1, SHINGLE + 1):
        if k < SHINGLE and not (size == k).any():
            continue
        value, at = window_hashes(h, w.first, k)
        row = np.searchsorted(w.first, at, "right") - 1
        ours = size[row] >= SHINGLE if k == SHINGLE else size[row] == k
        parts.append((row[ours], value[ours]))
    row, value = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else []
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, x: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS):
    """ProbMinHash places (n, m): the shingle that arrived first; rows without any stay 0."""
    best = np.full(n * m, np.inf)
    place = np.zeros(n * m, np.uint64)
    size = np.bincount(row, minlength=n)
    # documents of few shingles draw several arrivals at once
    step = 1 << np.ceil(np.log2(np.clip(2 * m / np.maximum(size, 1), 1, 2 * m))).astype(int)
    for b in np.unique(step[size > 0]).tolist():
        at = np.flatnonzero(step[row] == b)
        time, done = np.zeros(len(at)), 0
        while len(at):
            count = np.arange(done + 1, done + b + 1, dtype=np.uint64)
            u = mix(x[at, None] + count * np.uint64(0x9E3779B97F4A7C15))
            gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            arrival = time[:, None] + np.cumsum(gap, 1) / weight[at, None]
            slot = row[at, None] * m + (mix(u) % np.uint64(m)).astype(np.int64)
            early = arrival < best[slot]
            when, where = arrival[early], slot[early]
            who = np.broadcast_to(x[at, None], early.shape)[early]
            np.minimum.at(best, where, when)
            first = best[where] == when
            place[where[first]] = who[first]
            latest = best.reshape(n, m).max(1)
            time = arrival[:, -1]
            going = time < latest[row[at]]
            at, time, done = at[going], time[going], done + b
    return place.reshape(n, m)


def bands(place: np.ndarray) -> np.ndarray:
    """Bucket keys (n, BANDS)."""
    part = place[:, : BANDS * ROWS].reshape(len(place), BANDS, ROWS)
    key = np.zeros(part.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + part[:, :, r])
    return key


def probability_jaccard(a, x, b, y) -> float:
    """Of two sorted hash arrays with counts: the chance that ProbMinHash places agree."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    # union as (weight in one, weight in other), by the ratio of the weights
    u = np.concatenate([x[i], np.delete(x, i), np.zeros(len(y) - len(j))]).astype(float)
    v = np.concatenate([y[j], np.zeros(len(x) - len(i)), np.delete(y, j)]).astype(float)
    with np.errstate(divide="ignore"):
        ratio = u / v
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    left = np.append(0, np.cumsum(v[order]))
    right = u.sum() - np.append(0, np.cumsum(u[order]))
    at = np.searchsorted(sorted_ratio, ratio[: len(i)])  # those before have a smaller ratio
    return float((1 / (right[at] / u[: len(i)] + left[at] / v[: len(i)])).sum())


def _signature_rows(batches):
    for batch in blocks(batches, "text"):
        w = words_of(batch, "text", NOT_SPACE, lower=True)
        row, value, count = shingles(w)
        place = signatures(row, value, count, w.rows)
        some = np.flatnonzero(np.bincount(row, minlength=w.rows) > 0)
        keys = bands(place[some]).view(np.int64)
        code = (mix(place[some]) & np.uint64(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node").take(pa.array(some)),
                pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(
                    pa.list_(pa.int64())
                ),
                pa.array([c.tobytes() for c in code], pa.binary()),
            ],
            ["node", "bands", "code"],
        )


def _pack(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in blocks(batches, "text"):
        packed = [pack.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("node"), pa.array(packed, pa.binary())],
            ["doc_id", "node", "packed"],
        )


class _Parsed:
    """Shingles of packed texts; the last texts looked at are kept, up to ``MEMORY`` shingles."""

    def __init__(self):
        self.unpack, self.known, self.held = zstandard.ZstdDecompressor(), {}, 0

    def __call__(self, node: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        if node not in self.known:
            if self.held > MEMORY:
                self.known.clear()
                self.held = 0
            data = LOWER[np.frombuffer(self.unpack.decompress(packed), np.uint8)]
            _, value, count = shingles(find_words(data, np.array([0, len(data)]), NOT_SPACE))
            self.known[node] = value, count
            self.held += len(value)
        return self.known[node]


def _verify(batches):
    """Pairs whose texts reach the similarity."""
    parsed = _Parsed()
    for batch in batches:
        a, b, text_a, text_b = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
        good = [
            probability_jaccard(*parsed(p, s), *parsed(q, t)) >= SIMILARITY
            for p, q, s, t in zip(a, b, text_a, text_b)
        ]
        yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])


def _join_in_block(table: pa.Table) -> pa.Table:
    """Verified links that join two classes, among the nodes of one block of a bucket.

    Nodes of side 0 are held against those of side 1. Classes that a link has joined are not
    compared again, so a block emits fewer links than it has nodes.
    """
    side, minor = table.column("side").to_numpy(), table.column("minor").to_numpy(False)
    node, group = table.column("node").to_numpy(), table.column("class").to_numpy().copy()
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(node), -1)
    least = SIMILARITY - 5 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / COMPONENTS)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def candidates(i):
        # two nodes outside the largest class stand on both sides: once is enough
        open_ = right[(group[right] != group[i]) & (~minor[right] | (node[right] > node[i]))]
        return open_[(code[open_] == code[i]).mean(1) >= least]

    compare = _Compare(table.column("packed"), node)
    a, b = [], []
    for i in left.tolist():
        near = candidates(i)
        while len(near):
            close = near[compare(i, near)]
            if not len(close):
                break
            c = int(close[0])
            a.append(min(node[i], node[c]))
            b.append(max(node[i], node[c]))
            group[group == group[c]] = group[i]
            near = close[group[close] != group[i]]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class _Compare:
    """Which of some texts of a block reach the similarity to one of them; all at once.

    Where no shingle of two texts repeats, common shingles are counted for all pairs in one pass
    over their shingles; other pairs go one by one.
    """

    def __init__(self, packed, node):
        self.packed, self.node, self.parsed = packed, node, _Parsed()

    def _of(self, i: int) -> tuple[np.ndarray, np.ndarray, bool]:
        value, count = self.parsed(int(self.node[i]), self.packed[i].as_py())
        return value, count, len(count) == count.sum()

    def __call__(self, i: int, near: np.ndarray) -> np.ndarray:
        value, count, plain = self._of(i)
        good = np.zeros(len(near), bool)
        many, at = [], []
        for k, c in enumerate(near.tolist()):
            other, weight, other_plain = self._of(c)
            if plain and other_plain:
                many.append(other)
                at.append(k)
            else:
                good[k] = probability_jaccard(value, count, other, weight) >= SIMILARITY
        if many:
            size = np.array([len(x) for x in many])
            known = np.concatenate(many)
            place = np.searchsorted(value, known)
            hit = value[np.minimum(place, len(value) - 1)] == known
            both = np.add.reduceat(hit, np.append(0, np.cumsum(size)[:-1]), dtype=np.int64)
            good[at] = both / (len(value) + size - both) >= SIMILARITY
        return good


def _flat(up: DataFrame) -> DataFrame:
    """Pointers (node, to) followed to their ends; the number of rounds is logarithmic in the depth."""
    while True:
        one, two = up.toDF("to", "next"), up.toDF("next", "end")
        longer = up.join(one, "to").join(two, "next").select("node", "next", "end").checkpoint()
        up = longer.select("node", F.col("end").alias("to"))
        if longer.where("next != end").isEmpty():
            return up


def components(links: DataFrame) -> DataFrame:
    """node, class: the least node of the connected component, for all nodes of ``links``.

    Every round points each node to its least neighbour, follows the pointers, and goes on with the
    links between different ends. A star collapses at once, so links soon become few.
    """
    shared_dir(links.sparkSession)
    links = links.select("a", "b").checkpoint()
    names = None
    while True:
        both = links.union(links.select("b", "a")).toDF("node", "other")
        up = _flat(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")))
        if names is None:
            names = up.toDF("node", "class")
        else:
            names = names.join(up.toDF("class", "to"), "class", "left").select(
                "node", F.coalesce("to", "class").alias("class")
            )
        one, two = up.toDF("a", "of_a"), up.toDF("b", "of_b")
        links = (
            links.join(one, "a")
            .join(two, "b")
            .where("of_a != of_b")
            .select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
            .distinct()
            .checkpoint()
        )
        if links.isEmpty():
            return names.checkpoint()


def _joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after links between some of them."""
    one, two = classes.toDF("a", "of_a"), classes.toDF("b", "of_b")
    between = (
        links.join(one, "a", "left")
        .join(two, "b", "left")
        .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        .where("a != b")
        .distinct()
    )
    up = components(between).toDF("class", "to")
    old = classes.join(up, "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    # nodes that had no link so far
    new = up.toDF("node", "class").join(classes.select("node"), "node", "left_anti")
    return old.union(new).checkpoint()


def _texts_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and packed text of the wanted nodes, stored."""
    packed = docs.mapInArrow(_pack, "doc_id long, node long, packed binary")
    found = packed.join(nodes.join(wanted, "node"), "node").where("doc_id <=> first")
    return stored(found.select("node", "packed").dropDuplicates(["node"]), "texts")


def _linked(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the similarity, stored."""
    one, two = found.toDF("b", "text_b"), found.toDF("a", "text_a")
    both = pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_verify, "a long, b long").distinct(), "links")


def _mixed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """band, node, class of the buckets that hold nodes of several classes, stored."""
    named = members.join(classes, "node", "left").select(
        "band", "node", F.coalesce("class", "node").alias("class")
    )
    ends = named.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y"))
    return stored(named.join(ends.where("x != y").select("band"), "band", "left_semi"), "members")


def _block_links(members: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    """Verified links (a, b) between the classes of each bucket, stored.

    Every node outside the largest class of its bucket is held against all nodes, in blocks of
    ``BLOCK`` on a side; nodes of the largest class are not held against each other.
    """
    of_class = members.groupBy("band", "class").agg(F.count("*").alias("k"))
    size = of_class.groupBy("band").agg(
        F.sum("k").alias("n"), F.max("k").alias("k"), F.max(F.struct("k", "class"))["class"].alias("most")
    )
    down = F.ceil((F.col("n") - F.col("k")) / BLOCK).cast("int")
    across = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (
        members.select("band", "node", "class")
        .join(size, "band")
        .select("band", "node", "class", (F.col("class") != F.col("most")).alias("minor"), down.alias("down"), across.alias("across"))
    )
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = ("band", "i", "j", "side", "node", "class", "minor")
    above = placed.where("minor").withColumn("i", at("down")).withColumn("j", every("across"))
    beside = placed.withColumn("j", at("across")).withColumn("i", every("down"))
    blocks_of = (
        above.withColumn("side", F.lit(0)).select(*rows).union(beside.withColumn("side", F.lit(1)).select(*rows))
        .join(signed.select("node", "code"), "node")
        .join(found, "node")
    )
    linked = blocks_of.groupBy("band", "i", "j").applyInArrow(_join_in_block, "a long, b long")
    return stored(linked.distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, node and class of every document.

    class_id is the least doc_id of the class (null if none has an id), class the least node, and
    a node is a hash of a text. n_links counts the verified links of the document's text: a spanning set of links between
    different texts, not all pairs of a class.
    """
    docs = texts(docs).withColumn("node", F.xxhash64(F.coalesce("text", F.lit(""))))
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("first"))
    signed = stored(
        docs.select("node", "text")
        .mapInArrow(_signature_rows, "node long, bands array<long>, code binary")
        .dropDuplicates(["node"]),
        "signatures",
    )
    buckets = signed.select("node", F.explode("bands").alias("band"))
    # the least node after flipping bits is the middle, found by a plain minimum of numbers;
    # few ways of flipping, so that one group has few middles over all its bands
    flip = F.xxhash64(F.pmod("band", F.lit(MIDDLES)))
    leads = (
        buckets.groupBy("band")
        .agg(F.min(F.col("node").bitwiseXOR(flip)).alias("least"), F.count("*").alias("n"))
        .where("n > 1")
        .select("band", "n", F.col("least").bitwiseXOR(flip).alias("lead"))
    )
    leads = stored(leads, "leads")
    pairs = (
        buckets.join(leads, "band")
        .where("node != lead")
        .select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    )
    pairs = stored(pairs.distinct(), "pairs")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    found = _texts_of(met, docs, nodes)
    links = _linked(pairs, found)
    classes = components(links)

    members = buckets.join(leads.where("n > 2"), "band").select("band", "node")
    members = _mixed(members, classes)
    for turn in range(TURNS):
        if members.isEmpty():
            break
        middle = F.min(F.struct(F.xxhash64(F.lit(turn), "band", "node"), F.col("node").alias("a"), F.col("class").alias("of")))
        middles = members.groupBy("band").agg(middle.alias("m")).select("band", "m.a", "m.of")
        pairs = members.join(middles, "band").where("class != of")
        pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        more = _linked(pairs.distinct(), found)
        links, classes = links.union(more), _joined_classes(classes, more)
        members = _mixed(members.select("band", "node"), classes)
    if not members.isEmpty():
        more = _block_links(members, signed, found)
        links, classes = links.union(more), _joined_classes(classes, more)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    of_node = (
        nodes.join(classes, "node", "left")
        .join(degree, "node", "left")
        .select(
            "node",
            "first",
            F.coalesce("class", "node").alias("class"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
    least = of_node.groupBy("class").agg(F.min("first").alias("class_id"))
    named = of_node.join(least, "class").select("node", "class_id", "n_links", "class")
    return (
        docs.select("doc_id", "node")
        .join(named, "node")
        .select("doc_id", "class_id", "n_links", "node", "class")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the row with the least id (then the least text hash), all columns kept.

    Rows without an id come after all others of their class. Of rows that repeat both id and
    text one stays.
    """
    columns = docs.columns
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "node")
    best = near_duplicates(docs).groupBy("class").agg(F.min(order).alias("best"))
    doc, node = unused(docs, "doc"), unused(docs, "node")
    best = best.select(F.col("best.doc_id").alias(doc), F.col("best.node").alias(node))
    keyed = docs.withColumn(node, F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = keyed.withColumn(doc, F.col("doc_id").cast("long"))
    same = keyed[doc].eqNullSafe(best[doc]) & (keyed[node] == best[node])
    kept = keyed.join(best, same, "left_semi")
    repeated = keyed.groupBy(doc, node).agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates([doc, node])
    return kept.select(columns)
