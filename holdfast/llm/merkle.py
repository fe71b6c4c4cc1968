"""Merkle manifest of a dataset: every few levels are kept, the levels between are made again.

A row's leaf is H of its fields; H is the lowercase hex sha256 of its inputs one after another,
digests as hex text. Per source the leaves ascend by document id; while several nodes remain,
every 16 consecutive ones become their H. What remains is the source's subroot; the subroots,
ordered by source, form one more tree whose last node is the root.

Checkpoint and recompute: only every third level is stored, as one row for each aligned subtree of
16 ** 3 nodes. A proof job goes down from the top: it makes the interior levels of a subtree from
the stored row below it, reads off the siblings on every level, passes each stored node's path on
to the subtree under it, and throws the interior nodes away.

Scale: one range exchange on (source, id) numbers the leaves, salted among equal ids, so neither a
hot source nor a hot id lands in one task; texts are hashed where they are read and never move. A
subtree is the largest group (4,096 digests). The driver sees the number of sources and the size
of the largest one.

Cases: a null field is `-`, so it differs from an empty one; null ids come first in their source
and a null source is a source of its own, first of all; rows of one id go by their leaf, so
repeated rows are leaves of their own; texts of any length are hashed whole; an empty table has no
root, and gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.ordering import number_rows
from holdfast.session import stage

FANOUT = 16
KEPT_EVERY = 3  # levels
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def node_hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """H over fields, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t),
                                        F.lit("-")) for t in texts]), 256)


def subtree(nodes: list[str], n: int, every: int) -> list[list[str]]:
    """The levels above `nodes` up to the next kept one; n: nodes of the whole tree's level."""
    levels = [nodes]
    while n > 1 and len(levels) <= every:
        nodes = [node_hash("".join(nodes[i:i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        levels.append(nodes)
        n = -(-n // FANOUT)
    return levels


def height(n: int) -> int:
    """Levels above the n nodes of a tree."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of node `at` and of its ancestors, level by level."""
    path = []
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + FANOUT])))
        at //= FANOUT
    return path


def fold(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The last node above `node`, given what stands beside it and its ancestors."""
    for left, right in path:
        node = node_hash(left + node + right)
    return node


# ------------------------------------------------------------------------------------ building
@dataclass
class Forest:
    """Trees by their kept levels: rows (tree, block, n, nodes[, ids, claims]), lowest first."""

    every: int  # levels from one kept one to the next
    kept: list[DataFrame]
    tops: DataFrame  # tree, top


def _tops(blocks: DataFrame, every: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [subtree(nodes, n, every)[-1][0] for n, nodes in zip(
                batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(tops, pa.string())],
                                             names=["tree", "block", "n", "top"])

    return blocks.select("tree", "block", "n", "nodes").mapInArrow(
        run, "tree long, block long, n long, top string")


def _grouped(nodes: DataFrame, size: int, *extra: str) -> DataFrame:
    """Rows (tree, pos, n, node, ...) as one stored row for each aligned run of `size` nodes."""
    items = F.sort_array(F.collect_list(F.struct("pos", "node", *extra)))
    block = F.floor(F.col("pos") / size).cast("long").alias("block")
    rows = nodes.groupBy("tree", block).agg(F.first("n").alias("n"), items.alias("items"))
    return stage(rows.select("tree", "block", "n", F.col("items.node").alias("nodes"),
                             *[F.col(f"items.{c}").alias(f"{c}s") for c in extra]), "merkle")


def grow(nodes: DataFrame, largest: int, every: int, *extra: str) -> Forest:
    """Forest over rows (tree, pos, n, node): n nodes in the tree, pos from 0 in it."""
    size = FANOUT ** every
    kept = [_grouped(nodes, size, *extra)]
    tops = stage(_tops(kept[0], every), "merkle-tops")
    done = tops.where(F.col("n") <= size)
    while largest > size:
        up = tops.where(F.col("n") > size).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"),
            F.col("top").alias("node"))
        kept.append(_grouped(up, size))
        tops = stage(_tops(kept[-1], every), "merkle-tops")
        done = done.unionByName(tops.where(F.col("n") <= size))
        largest = -(-largest // size)
    return Forest(every, kept, done.select("tree", "top"))


@dataclass
class Manifest:
    sources: DataFrame  # source, tree, first, n
    trees: Forest  # one tree per source
    crown: Forest  # one tree over the subroots


def manifest(docs: DataFrame, claim: Callable[[DataFrame], Column] | None = None,
             fields: Sequence[str] = FIELDS, every: int = KEPT_EVERY) -> Manifest:
    """Manifest of `docs` (fields: id, source, then any others).

    claim: from the documents, the leaf that a later holder of the row presents; kept beside the
    true leaf for `verify`. Null or unset, it is the leaf itself.
    """
    leaf = leaf_hash([docs[c] for c in fields])
    leaves = stage(docs.select(
        docs[fields[1]].alias("source"), docs[fields[0]].alias("id"), leaf.alias("node"),
        (claim(docs) if claim else F.lit(None)).cast("string").alias("claim")).withColumn(
            "row", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col(c).asc_nulls_first() for c in ("source", "id", "node", "row")]
    ranked = number_rows(leaves, order, "rank")
    found = stage(ranked.groupBy("source").agg(F.min("rank").alias("first"),
                                               F.count(F.lit(1)).alias("n")), "merkle-sources")
    sources = stage(number_rows(found, [F.col("source").asc_nulls_first()], "tree").withColumn(
        "tree", F.col("tree") - 1), "merkle-sources")
    head = sources.agg(F.max("n"), F.count(F.lit(1))).first()
    largest, n_sources = head[0] or 0, head[1]
    placed = ranked.alias("r").join(
        sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "s.tree", (F.col("r.rank") - F.col("s.first")).alias("pos"), "s.n", "r.node", "r.id",
        "r.claim")
    trees = grow(placed, largest, every, "id", "claim")
    crown = grow(trees.tops.select(F.lit(0).cast("long").alias("tree"),
                                   F.col("tree").alias("pos"), F.lit(n_sources).cast("long")
                                   .alias("n"), F.col("top").alias("node")), n_sources, every)
    return Manifest(sources, trees, crown)


# -------------------------------------------------------------------------------------- proofs
def _with_upper(blocks: DataFrame, paths: DataFrame | None, above: DataFrame,
                size: int) -> DataFrame:
    """Blocks and the path above each: from the kept level over it, or from above its tree.

    Only the narrow keys of blocks meet `above`, so a hot tree's digests are not moved for it.
    """
    keys = blocks.select("tree", "block", "n")
    upper = keys.where(F.col("n") <= size).join(above, "tree").select("tree", "block", "path")
    if paths is not None:
        upper = upper.unionByName(paths.select("tree", F.col("pos").alias("block"), "path"))
    return blocks.join(stage(upper, "merkle-upper"), ["tree", "block"])


def _paths_below(blocks: DataFrame, every: int) -> DataFrame:
    """(tree, pos, path up to the root) of every node of the blocks (tree, block, n, nodes, path)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                upper = [(p["left"], p["right"]) for p in row["path"]]
                levels = subtree(row["nodes"], row["n"], every)
                paths = [[{"left": a, "right": b} for a, b in siblings(levels, k) + upper]
                         for k in range(len(row["nodes"]))]
                first = row["block"] * FANOUT ** every
                at = range(first, first + len(paths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(paths), pa.int64()), pa.array(at, pa.int64()),
                     pa.array(paths, pa.list_(pa.struct(
                         [("left", pa.string()), ("right", pa.string())])))],
                    names=["tree", "pos", "path"])

    return blocks.select("tree", "block", "n", "nodes", "path").mapInArrow(
        run, f"tree long, pos long, path {PATH}")


def _descend(forest: Forest, above: DataFrame) -> DataFrame:
    """The lowest kept blocks with their upper paths."""
    paths = None
    size = FANOUT ** forest.every
    for blocks in reversed(forest.kept[1:]):
        paths = _paths_below(_with_upper(blocks, paths, above, size), forest.every)
    return _with_upper(forest.kept[0], paths, above, size)


def verify(found: Manifest) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256 (H of its siblings, level by level, left to
    right), folded_root (from the claimed leaf and those siblings) and verified."""
    head = found.crown.tops.first()
    root = head["top"] if head else None
    none = found.crown.tops.select("tree", F.array().cast(PATH).alias("path"))
    every = found.trees.every
    above = stage(_paths_below(_descend(found.crown, none), every).select(
        F.col("pos").alias("tree"), "path"), "merkle-above")
    id_type = found.trees.kept[0].schema["ids"].dataType.elementType.simpleString()
    schema = (f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, "
              "folded_root string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                upper = [(p["left"], p["right"]) for p in row["path"]]
                levels = subtree(row["nodes"], row["n"], every)
                proofs, roots = [], []
                first = siblings(levels, 0) + upper
                subroot = fold(row["nodes"][0], first[:height(row["n"])])
                for at, claim in enumerate(row["claims"]):
                    path = siblings(levels, at) + upper
                    proofs.append(node_hash("".join(a + b for a, b in path)))
                    roots.append(fold(claim or row["nodes"][at], path))
                ids = batch.column("ids").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(row["nodes"], pa.string()),
                     pa.array([subroot] * len(ids), pa.string()),
                     pa.array(proofs, pa.string()), pa.array(roots, pa.string())],
                    names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    rows = _descend(found.trees, above).select("n", "nodes", "ids", "claims", "path").mapInArrow(
        run, schema)
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"),
                       "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.lit(root)).alias("verified"))
