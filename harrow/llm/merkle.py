"""A Merkle manifest of a table: one tree per group, one tree over the groups' roots.

A node is the sha256 of its children's hex digests. A parent keeps a copy of the
hash state before each child slot. To fold a changed leaf, the state before its
slot is copied, takes the new digest and the siblings to the right, and gives the
new parent; what lies to the left is never hashed again.

Leaves are hashed by Spark's own sha2 in the scan of the table, the only pass over
the texts. Digests then take their place in the order of their group by a range
partitioning and the sizes of its ranges, and lie in blocks of `block`
neighbours, a row each. A block is a subtree that one task builds; its root is a
node of the next step, so a group of n leaves has log(n) / log(block) steps. The
way down gives each block the siblings above it, and the last step folds every leaf
of a block up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from harrow.session import cut_lineage

FANOUT = 2
# Leaves of a block; a power of the fanout.
BLOCK = 1024

_PART_BITS = 33  # of monotonically_increasing_id: the partition is above them


class Level:
    """One level of a tree: nodes as hex, and the hash state before each of them in its parent."""

    def __init__(self, nodes: list[bytes], fanout: int):
        self.nodes, self.fanout = nodes, fanout
        self.states, self.parents = [], []
        for at in range(0, len(nodes), fanout):
            state = hashlib.sha256()
            for node in nodes[at : at + fanout]:
                self.states.append(state.copy())
                state.update(node)
            self.parents.append(state.hexdigest().encode())

    def siblings(self, i: int) -> tuple[list[bytes], list[bytes]]:
        """The other children of a node's parent, left and right of it."""
        run = i - i % self.fanout
        return self.nodes[run:i], self.nodes[i + 1 : run + self.fanout]

    def fold(self, i: int, node: bytes) -> bytes:
        """The parent, were node the child in that place."""
        state = self.states[i].copy()
        for x in (node, *self.nodes[i + 1 : i - i % self.fanout + self.fanout]):
            state.update(x)
        return state.hexdigest().encode()


def levels_of(nodes: list[bytes], fanout: int, height: int) -> tuple[list[Level], bytes]:
    """The levels above some nodes, that many, and the node on top."""
    out = []
    for _ in range(height):
        out.append(Level(nodes, fanout))
        nodes = out[-1].parents
    return out, nodes[0]


class Above:
    """The way from a block's root to the root of all: siblings by level, bottom first."""

    def __init__(self, lefts: list[list[str]], rights: list[list[str]]):
        self.proof = b"".join(x.encode() for pair in zip(lefts, rights, strict=True) for side in pair for x in side)
        self.steps = []
        for left, right in zip(lefts, rights, strict=True):
            state = hashlib.sha256()
            for x in left:
                state.update(x.encode())
            self.steps.append((state, [x.encode() for x in right]))

    def fold(self, node: bytes) -> bytes:
        for kept, right in self.steps:
            state = kept.copy()
            for x in (node, *right):
                state.update(x)
            node = state.hexdigest().encode()
        return node


def height_of(n: int, fanout: int, block: int) -> int:
    """How many levels a block of a tree of n nodes has."""
    height, width = 0, 1
    while width < min(n, block):
        width *= fanout
        height += 1
    return height


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values: `-` for a null, else UTF-8 byte count, `:`, value."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """The rows of (tree, ...) with pos, their place in their tree by `order`, and n, its size.

    Rows of equal order are spread and take neighbouring places.
    """
    # the row number splits a run of equal rows over several ranges
    rows = nodes.withColumn("_row", F.monotonically_increasing_id())
    keys = ("tree", *order, "_row")
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    table = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PART_BITS)
    ranges = table.groupBy("tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "tree",
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_n").over(by_tree).alias("n"),
    )
    with_part = table.withColumn("_part", part)
    return (
        with_part.join(ranges, ["tree", "_part"])
        .withColumn("pos", F.col("_at") + F.col("_base"))
        .drop("_part", "_at", "_base")
    )


def in_blocks(nodes: DataFrame, block: int, *payload: str) -> DataFrame:
    """(tree, block, n, members): `block` neighbours of a tree in one row, in their order."""
    number = F.floor(F.col("pos") / block).cast("long").alias("block")
    members = F.array_sort(F.collect_list(F.struct("pos", *payload)))
    return cut_lineage(nodes.groupBy("tree", number).agg(F.first("n").alias("n"), members.alias("members")))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """Blocks one at a time, and their nodes as hex."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row, [m["node"].encode() for m in row["members"]]


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns.values()], list(columns))


def block_roots(blocks: DataFrame, fanout: int, block: int) -> DataFrame:
    """(tree, pos, n, node): the root of each block as a node of the next step."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, nodes in _members(batches):
            _, top = levels_of(nodes, fanout, height_of(row["n"], fanout, block))
            yield _batch(
                {
                    "tree": ([row["tree"]], pa.string()),
                    "pos": ([row["block"]], pa.int64()),
                    "n": ([-(-row["n"] // block)], pa.int64()),
                    "node": ([top.decode()], pa.string()),
                }
            )

    names = F.col("members.node").alias("node")
    slim = blocks.select("tree", "block", "n", F.transform(names, lambda x: F.struct(x.alias("node"))).alias("members"))
    return slim.mapInArrow(build, "tree string, pos long, n long, node string")


def climbed(blocks: DataFrame, fanout: int, block: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every step, bottom first, and (tree, node): the root of each tree."""
    steps = [blocks]
    # one number to the driver
    most = blocks.agg(F.max("n")).first()[0] or 0
    while most > block:
        steps.append(in_blocks(cut_lineage(block_roots(steps[-1], fanout, block)), block, "node"))
        most = -(-most // block)
    return steps, block_roots(steps[-1], fanout, block).select("tree", "node")


_PATH = "lefts array<array<string>>, rights array<array<string>>"
_PATH_TYPE = pa.list_(pa.list_(pa.string()))


def paths_of(blocks: DataFrame, above: DataFrame, fanout: int, block: int) -> DataFrame:
    """(tree, block, node, lefts, rights): each node's way to the root of all.

    above has the ways of the blocks: (tree, block, lefts, rights).
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, nodes in _members(batches):
            members, lefts, rights = row["members"], [], []
            levels, _ = levels_of(nodes, fanout, height_of(row["n"], fanout, block))
            for i in range(len(members)):
                places = [i // fanout**j for j in range(len(levels))]
                sides = [level.siblings(at) for level, at in zip(levels, places, strict=True)]
                lefts.append([[x.decode() for x in left] for left, _ in sides] + row["lefts"])
                rights.append([[x.decode() for x in right] for _, right in sides] + row["rights"])
            yield _batch(
                {
                    "tree": ([row["tree"]] * len(members), pa.string()),
                    "block": ([m["pos"] for m in members], pa.int64()),
                    "name": ([m.get("name") for m in members], pa.string()),
                    "node": ([m["node"] for m in members], pa.string()),
                    "lefts": (lefts, _PATH_TYPE),
                    "rights": (rights, _PATH_TYPE),
                }
            )

    return blocks.join(above, ["tree", "block"]).mapInArrow(
        go, f"tree string, block long, name string, node string, {_PATH}"
    )


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "lang",
    claimed: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    block: int = BLOCK,
) -> DataFrame:
    """The manifest of a table and a check of claimed rows against it: one row per row of docs.

    Columns: the key, leaf, subroot (of the row's group), root, proof (the hex
    digests of the siblings, one after another, level by level from the leaf to the
    root, left to right), folded_root, verified. `claimed` gives columns as somebody
    else states them; folded_root is folded from the leaf of the claimed row and the
    manifest's siblings, and verified says whether it equals root.

    Leaves of a group are ordered by key, nulls first, and by digest where keys are
    equal; groups by value, null first, in the order of UTF-8 bytes. The last run of
    a level may have fewer nodes, even one. A null of any column is a value of its
    own; an empty table gives no rows. Other columns are not read.
    """
    if height_of(block, fanout, block) and fanout ** height_of(block, fanout, block) != block:
        raise ValueError("block must be a power of fanout")
    leaf = leaf_digest([F.col(c) for c in columns])
    altered = F.lit(None).cast("string")
    for name, value in (claimed or {}).items():
        stated = [claimed.get(c, F.col(c)) for c in columns]
        altered = F.when(~value.eqNullSafe(F.col(name)), leaf_digest(stated)).otherwise(altered)
    wanted = docs.select(*dict.fromkeys((*columns, key, group)))
    leaves = cut_lineage(
        wanted.select(
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
            F.col(key).alias("key"),
            leaf.alias("node"),
            altered.alias("altered"),
        )
    )
    blocks = in_blocks(placed(leaves, "key", "node"), block, "node", "key", "altered")
    steps, subroots = climbed(blocks, fanout, block)
    named = cut_lineage(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"))
    top_steps, roots = climbed(in_blocks(placed(named, "name"), block, "node", "name"), fanout, block)

    spark = docs.sparkSession
    no_way = F.array().cast("array<array<string>>")
    above = spark.range(1).select(
        F.lit("").alias("tree"), F.col("id").alias("block"), no_way.alias("lefts"), no_way.alias("rights")
    )
    for step in reversed(top_steps):
        above = cut_lineage(paths_of(step, above, fanout, block))
    # a group's way down begins at its root, which is the one block of its last step
    ways = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "lefts", "rights")
    for step in reversed(steps[1:]):
        ways = cut_lineage(paths_of(step, ways, fanout, block)).select("tree", "block", "lefts", "rights")
    ways = ways.join(above.select(F.col("name").alias("tree"), F.col("node").alias("subroot")), "tree")

    key_type = docs.schema[key].dataType.simpleString()
    key_arrow = to_arrow_type(docs.schema[key].dataType)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, nodes in _members(batches):
            members, proofs, folded = row["members"], [], []
            levels, _ = levels_of(nodes, fanout, height_of(row["n"], fanout, block))
            way = Above(row["lefts"], row["rights"])
            for i, member in enumerate(members):
                node = (member["altered"] or member["node"]).encode()
                proof, at = [], i
                for level in levels:
                    left, right = level.siblings(at)
                    proof += left
                    proof += right
                    node = level.fold(at, node)
                    at //= fanout
                proofs.append((b"".join(proof) + way.proof).decode())
                folded.append(way.fold(node).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([m["key"] for m in members], key_arrow),
                    pa.array([m["node"] for m in members], pa.string()),
                    pa.array([row["subroot"]] * len(members), pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array(folded, pa.string()),
                ],
                ["key", "leaf", "subroot", "proof", "folded_root"],
            )

    schema = f"key {key_type}, leaf string, subroot string, proof string, folded_root string"
    checked = steps[0].join(ways, ["tree", "block"]).mapInArrow(check, schema)
    root = roots.first()  # one row: the root of all
    root = F.lit(root["node"] if root else None).cast("string")
    return checked.select(
        F.col("key").alias(key),
        "leaf",
        "subroot",
        root.alias("root"),
        "proof",
        "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
