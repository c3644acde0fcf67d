"""Merkle manifest of a dataset: a proof for every row, by butterfly exchange.

Every row is a leaf, the hash of its columns. The leaves of a source, in order of their ids, are
cut into blocks of ``FANOUT ** LOCAL`` leaves. A task builds the subtree of a block and keeps its
root. Then blocks exchange roots in rounds: in round r, the ``FANOUT`` blocks whose numbers differ
in digit r alone swap the subtree roots they have so far, and each of them hashes the parent, so that
an ancestor is computed by every block below it. After the last round each block holds the root of
its source and all siblings on the way to it; nothing is sent down again. Where the last subtree of a
source is not full, its first block also answers for the blocks that are missing, in that round.
The roots of the sources are the leaves of one more tree of the same kind.

Nothing is collected: a round shuffles one row for each block, a group of it has at most ``FANOUT``
rows, and a task holds one block of leaves at a time, however large its source.

Definite results: a null field is hashed as ``-``; repeated rows are leaves next to each other; rows
without an id come first in their source, rows of one id in order of their hashes; rows without a
source form the first source; an empty table has no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import prepare, stored
from cloakframe.plans.ordering import row_numbers

FANOUT = 16
LOCAL = 2  # levels that a task builds by itself
TAMPERED_FOLDS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The hash of a row: fields with their sizes in bytes, one after the other."""
    values = [f.cast("string") for f in fields]
    sized = [F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values]
    return F.sha2(F.concat(*[F.coalesce(s, F.lit("-")) for s in sized]), 256)


def levels_of(n: int) -> int:
    """Levels between a leaf and the root of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def leaves(docs: DataFrame) -> DataFrame:
    """g, doc_id, leaf, changed: ``g`` is the source as a key, ``changed`` the leaf as found later.

    Later means with the text of every fifth id (by crc32) in lower case; null where nothing changes.
    """
    prepare()
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    doc_id = doc_id.cast("long")
    rest = [doc_id, source, lang, n_chars]
    picked = F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED_FOLDS == 0
    changed = F.when(picked, leaf_of([*rest, F.translate(text, _UPPER, _LOWER)]))
    key = F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))  # null before all others
    return docs.select(
        key.alias("g"), doc_id.alias("doc_id"), leaf_of([*rest, text]).alias("leaf"), changed.alias("changed")
    )


def _levels(nodes: list[str], levels: int) -> list[list[str]]:
    """Nodes of a block, level by level up to its root."""
    made = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        made.append(nodes)
    return made


def _block_root(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    n = table.column("n")[0].as_py()
    made = _levels(table.column("node").to_pylist(), min(LOCAL, levels_of(n)))
    return pa.table(
        {"g": table.column("g")[:1], "block": table.column("block")[:1], "n": table.column("n")[:1], "node": made[-1]}
    )


def _numbered(items: DataFrame, order: list[str], group: str) -> DataFrame:
    """``items`` with their place (from 0), the size and the block in their group, stored."""
    keyed = items.withColumnRenamed(group, "g")
    size = keyed.groupBy("g").agg(F.count("*").alias("n"))
    placed = row_numbers(keyed, ["g"], order, "pos").withColumn("pos", F.col("pos") - 1)
    block = F.floor(F.col("pos") / FANOUT**LOCAL).cast("long")
    return stored(placed.join(size, "g").withColumn("block", block), "leaves")


def _exchange(state: DataFrame, step: int) -> DataFrame:
    """One round: blocks that differ in one digit swap roots and hash their common parent."""
    block, many, at = F.col("block"), F.col("many"), F.lit(step)
    going = many > step  # more than one node left in the tree
    cut = (many - 1) - F.pmod(many - 1, at)  # first block of the last subtree
    key = (
        F.floor(block / (step * FANOUT)).alias("hi"),
        F.pmod(F.floor(block / step), F.lit(FANOUT)).alias("digit"),
    )
    columns = ("g", "hi", "lo", "digit", "node", "block", "many", "lefts", "rights", "real")
    own = state.where(going).select(
        "*", *key, F.pmod(block, at).alias("lo"), F.lit(True).alias("real")
    ).select(*columns)
    missing = F.explode(F.sequence(many - cut, at - 1)).alias("lo")
    standing_in = (
        state.where(going & (block == cut) & (many - cut < at))
        .select("*", *key, F.lit(False).alias("real"), missing)
        .select(*columns)
    )
    run = F.sort_array(F.collect_list(F.struct("digit", "node")))
    members = F.collect_list(F.when(F.col("real"), F.struct("block", "many", "digit", "lefts", "rights")))
    met = own.union(standing_in).groupBy("g", "hi", "lo").agg(run.alias("run"), members.alias("members"))
    each = met.select("g", "run", F.explode("members").alias("m"))

    def joined(keep) -> Column:
        kept = F.filter("run", lambda x: keep(x["digit"], F.col("m.digit")))
        return F.array_join(F.transform(kept, lambda x: x["node"]), "")

    risen = each.select(
        "g",
        F.col("m.block").alias("block"),
        F.col("m.many").alias("many"),
        F.sha2(F.array_join(F.transform("run", lambda x: x["node"]), ""), 256).alias("node"),
        F.concat("m.lefts", F.array(joined(lambda x, y: x < y))).alias("lefts"),
        F.concat("m.rights", F.array(joined(lambda x, y: x > y))).alias("rights"),
    )
    return risen.union(state.where(~going).select(*risen.columns))


def climb(placed: DataFrame) -> DataFrame:
    """g, block, node (the root of g), lefts, rights (siblings above the block, by level)."""
    roots = placed.select("g", "block", "n", "pos", "node").groupBy("g", "block")
    roots = roots.applyInArrow(_block_root, "g string, block long, n long, node string")
    none = F.array().cast("array<string>")
    many = F.ceil(F.col("n") / FANOUT**LOCAL).cast("long").alias("many")
    state = stored(roots.select("g", "block", many, "node", none.alias("lefts"), none.alias("rights")), "blocks")
    most, step = state.agg(F.max("many")).first()[0] or 0, 1
    while step < most:
        state = stored(_exchange(state, step), "blocks")
        step *= FANOUT
    return state.drop("many")


def _siblings(table: pa.Table):
    """Per row of a block: its siblings (left, right) on each local level."""
    n = table.column("n")[0].as_py()
    made = _levels(table.column("node").to_pylist(), min(LOCAL, levels_of(n)))
    for i in range(table.num_rows):
        path = []
        for nodes in made[:-1]:
            lo = i - i % FANOUT
            path.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + FANOUT])))
            i //= FANOUT
        yield path


def fold(node: str, path) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _paths(items: pa.Table, above: pa.Table) -> pa.Table:
    """For each item the whole way to the root of its group."""
    items = items.sort_by("pos")
    lefts, rights = above.column("lefts")[0].as_py(), above.column("rights")[0].as_py()
    paths = [[*own, *zip(lefts, rights)] for own in _siblings(items)]
    return pa.table(
        {
            "g": items.column("key"),
            "root": pa.array(above.column("node").to_pylist() * items.num_rows, pa.string()),
            "lefts": pa.array([[a for a, _ in p] for p in paths], pa.list_(pa.string())),
            "rights": pa.array([[b for _, b in p] for p in paths], pa.list_(pa.string())),
        }
    )


_PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def _proofs(items: pa.Table, above: pa.Table) -> pa.Table:
    items = items.sort_by("pos")
    lefts, rights = above.column("lefts")[0].as_py(), above.column("rights")[0].as_py()
    upper, subroot, root = list(zip(lefts, rights)), above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
    rest = "".join(a + b for a, b in upper)
    leaf, changed = items.column("node").to_pylist(), items.column("changed").to_pylist()
    proof, folded = [], []
    for own, now in zip(_siblings(items), (c or x for c, x in zip(changed, leaf))):
        proof.append(digest("".join(a + b for a, b in own) + rest))
        folded.append(fold(fold(now, own), upper))
    return pa.table(
        {
            "doc_id": items.column("doc_id"),
            "leaf": pa.array(leaf, pa.string()),
            "subroot": pa.array([subroot] * len(leaf), pa.string()),
            "root": pa.array([root] * len(leaf), pa.string()),
            "proof_sha256": pa.array(proof, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == root for f in folded], pa.bool_()),
        }
    )


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = stored(leaves(docs).withColumnRenamed("leaf", "node"), "hashes")
    placed = _numbered(rows, ["doc_id", "node"], "g")
    tops = climb(placed)
    ends = tops.where("block = 0").select(F.lit("").alias("all"), F.col("g").alias("key"), "node")
    sources = _numbered(ends, ["key"], "all")
    by_block = sources.groupBy("g", "block").cogroup(climb(sources).groupBy("g", "block"))
    ways = by_block.applyInArrow(_paths, "g string, root string, lefts array<string>, rights array<string>")
    above = tops.withColumnRenamed("node", "subroot").join(ways.toDF("g", "root", "more", "others"), "g")
    above = above.select(
        "g", "block", "subroot", "root",
        F.concat("lefts", "more").alias("lefts"), F.concat("rights", "others").alias("rights"),
    )
    return placed.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_proofs, _PROOF)
