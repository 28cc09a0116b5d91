"""Dataset manifest: a Merkle tree of records per group, and proofs that fold through retained hash states.

A parent's digest is one running SHA-256 over its children. The state before each
child slot is kept as a copy, so a proof is checked by resuming the copy of the
slot with the child in question and the siblings to its right only; those to its
left are in the state already.

Trees are built in blocks of 512 consecutive nodes, which are whole subtrees;
the roots of blocks are the nodes of the next round. No task ever sees more than
one block, whatever share of the records a group holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.statistics import with_row_index
from ..sources.tables import written
from .common import column

FANOUT = 8
# Levels of a block: it takes in FANOUT**LEVELS consecutive nodes.
LEVELS = 3

_SIBLINGS = "array<struct<left:array<string>,right:array<string>>>"
_PROOF = "array<struct<slot:int,siblings:array<string>>>"
_KINDS = pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
_STEP = pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))])


def record_digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields in turn: `-` for null, else UTF-8 bytes, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def depth(nodes: int) -> int:
    """Levels above so many nodes; a lone node is its own root."""
    levels, width = 0, 1
    while width < nodes:
        levels, width = levels + 1, width * FANOUT
    return levels


class Parent:
    """A parent node: its children, the hash state before each of them, and its digest."""

    def __init__(self, children: Sequence[str], state=None):
        state = hashlib.sha256() if state is None else state
        self.children, self.states = children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, child: str) -> str:
        """The digest with another child in a slot: the state before it, the child and its right siblings."""
        state = self.states[slot].copy()
        state.update((child + "".join(self.children[slot + 1:])).encode())
        return state.hexdigest()


def _levels(nodes: list[str], levels: int) -> list[list[Parent]]:
    out = []
    for _ in range(levels):
        parents = [Parent(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        out.append(parents)
        nodes = [p.digest for p in parents]
    return out


def _block_levels(table: pa.Table, levels: int) -> int:
    return min(levels, depth(table["total"][0].as_py()))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / FANOUT**levels).cast("bigint")


def _block_roots(nodes: DataFrame, high: int) -> DataFrame:
    """tree, pos, total, node: the root of each block of nodes (tree, pos, total, node)."""
    def reduce(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        names = table["node"].to_pylist()
        levels = _levels(names, _block_levels(table, high))
        root = levels[-1][0].digest if levels else names[0]
        total = -(-table["total"][0].as_py() // FANOUT**high)
        return pa.table({"tree": table["tree"][:1], "pos": table["block"][:1], "total": pa.array([total], pa.int64()),
                         "node": pa.array([root], pa.string())})

    return nodes.select("tree", "pos", "total", "node", _block(high).alias("block")).groupBy("tree", "block").applyInArrow(
        reduce, "tree bigint, pos bigint, total bigint, node string")


def _paths(nodes: DataFrame, largest: int, high: int) -> DataFrame:
    """tree, pos, top, above: per node the root of its tree and the siblings on the way there, by level."""
    kept = nodes.select("tree", "pos", "total", "node", _block(high).alias("block"))

    def own(table: pa.Table, upper: pa.Table | None = None) -> pa.Table:
        table = _sorted(table)
        names = table["node"].to_pylist()
        levels = _levels(names, _block_levels(table, high))
        top = upper["top"][0].as_py() if upper is not None else levels[-1][0].digest if levels else names[0]
        rest = upper["above"][0].as_py() if upper is not None else []
        above = []
        for at in range(len(names)):
            steps = []
            for parents in levels:
                at, slot = divmod(at, FANOUT)
                children = parents[at].children
                steps.append({"left": children[:slot], "right": children[slot + 1:]})
            above.append(steps + rest)
        return pa.table({"tree": table["tree"], "pos": table["pos"], "top": pa.array([top] * len(names), pa.string()),
                         "above": pa.array(above, pa.list_(_KINDS))})

    schema = f"tree bigint, pos bigint, top string, above {_SIBLINGS}"
    if largest <= FANOUT**high:
        return kept.groupBy("tree", "block").applyInArrow(lambda table: own(table), schema)
    roots = written(_block_roots(kept, high), "block-roots")
    upper = written(_paths(roots, -(-largest // FANOUT**high), high), "upper-paths")
    return kept.groupBy("tree", "block").cogroup(
        upper.withColumn("block", F.col("pos")).groupBy("tree", "block")).applyInArrow(own, schema)


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree, pos and total, and one row per tree: tree (its number in the order of groups), first, total."""
    ordered = leaves.withColumn("place", F.struct("group", "key", "leaf"))
    placed = with_row_index(ordered, "place", "at").drop("place")
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("total"))
    # Groups are numbered like rows: their table is as long as there are groups.
    trees = written(with_row_index(groups, "first", "tree"), "trees")
    joined = placed.alias("p").join(trees.alias("t"), F.col("p.group").eqNullSafe(F.col("t.group"))).select(
        F.col("t.tree"), (F.col("p.at") - F.col("t.first")).alias("pos"), "t.total", "p.group", "p.key", "p.leaf", "p.replacement")
    return written(joined, "leaves"), trees


def manifest(records: DataFrame, key: str = "doc_id", group: str = "lang", leaf: str = "leaf",
             replacement: str = "replacement", block_levels: int = LEVELS) -> DataFrame:
    """Per record: key, group, leaf, subroot, root, proof and folded_root.

    `records` has a digest per record in `leaf`. Per group the leaves ascend by
    key (null first; equal keys by digest), every 8 consecutive nodes become
    their parent until one is left, the subroot; subroots in the order of groups
    (null first, then by UTF-8 bytes) likewise give the root. `proof` has a step
    per level: the slot of the node and its siblings from left to right, first
    those below the subroot, then those of the subroots. `folded_root` is the
    root that follows from `replacement` instead of the leaf (null: the leaf)
    and the original siblings. Rows that repeat are leaves of their own; other
    columns of `records` are not read. An empty table gives none.
    """
    leaves = written(records.select(
        column(key).alias("key"), column(group).alias("group"), column(leaf).alias("leaf"),
        F.coalesce(column(replacement), column(leaf)).alias("replacement")), "digests")
    placed, trees = _numbered(leaves)
    sizes = trees.agg(F.max("total").alias("largest"), F.count("*").alias("trees")).first()
    if not sizes["trees"]:
        return leaves.select(F.col("key").alias(key), F.col("group").alias(group), "leaf", F.lit("").alias("subroot"), F.lit("").alias("root"),
                             F.lit(None).cast(_PROOF).alias("proof"), F.lit("").alias("folded_root"))
    roots = written(_block_roots(placed.select("tree", "pos", "total", F.col("leaf").alias("node")), block_levels), "block-roots")
    within = written(_paths(roots, -(-sizes["largest"] // FANOUT**block_levels), block_levels), "upper-paths")
    subroots = within.where("pos = 0").select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(sizes["trees"]).cast("bigint").alias("total"),
        F.col("top").alias("node"))
    final = _paths(subroots, sizes["trees"], block_levels).select(F.col("pos").alias("tree"), F.col("top").alias("root"), F.col("above").alias("last"))
    upper = written(within.join(final, "tree").select(
        "tree", F.col("pos").alias("block"), F.col("top").alias("subroot"), "root", F.concat("above", "last").alias("above")), "paths")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def prove(table: pa.Table, path: pa.Table) -> pa.Table:
        table = _sorted(table)
        names, changed = table["leaf"].to_pylist(), table["replacement"].to_pylist()
        levels = _levels(names, _block_levels(table, block_levels))
        # Above the block the states are the same for all its leaves: the left siblings are read once.
        rest, tail = [], []
        for step in path["above"][0].as_py():
            state = hashlib.sha256()
            state.update("".join(step["left"]).encode())
            rest.append((state, "".join(step["right"]).encode()))
            tail.append({"slot": len(step["left"]), "siblings": step["left"] + step["right"]})
        proofs, folded = [], []
        for at, node in enumerate(changed):
            steps = []
            for parents in levels:
                at, slot = divmod(at, FANOUT)
                node = parents[at].folded(slot, node)
                children = parents[at].children
                steps.append({"slot": slot, "siblings": children[:slot] + children[slot + 1:]})
            for state, right in rest:
                state = state.copy()
                state.update(node.encode() + right)
                node = state.hexdigest()
            proofs.append(steps + tail)
            folded.append(node)
        n = len(names)
        return pa.table({
            "key": table["key"], "group": table["group"], "leaf": table["leaf"],
            "subroot": pa.array(path["subroot"].to_pylist() * n, pa.string()), "root": pa.array(path["root"].to_pylist() * n, pa.string()),
            "proof": pa.array(proofs, pa.list_(_STEP)), "folded_root": pa.array(folded, pa.string())})

    schema = f"key {kinds['key']}, `group` {kinds['group']}, leaf string, subroot string, root string, proof {_PROOF}, folded_root string"
    proved = placed.withColumn("block", _block(block_levels)).groupBy("tree", "block").cogroup(
        upper.groupBy("tree", "block")).applyInArrow(prove, schema)
    return proved.withColumnsRenamed({"key": key, "group": group})


def siblings_digest(proof: str = "proof") -> Column:
    """Lower-case hex SHA-256 of all siblings of a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(column(proof), lambda step: step["siblings"])), ""), 256)
