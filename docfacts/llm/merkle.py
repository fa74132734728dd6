"""Merkle manifest of a dataset: one tree for each group of records, one root over all, a witness for every record.

A witness holds, level by level, the digests left and right of a record's node in its run; with it anyone can recompute
the root from the record alone. Witnesses grow by appends: leaves are appended in order to a frontier of open
subtrees, one run of at most ``FANOUT`` nodes for each level. A full run becomes its parent: every leaf under it has its
witness extended by its siblings, and the parent is appended one level up. Runs start at multiples of the fan-out, so
an append never changes a finished run.

The append is distributed by alignment: a block of ``FANOUT ** BLOCK_LEVELS`` consecutive leaves is a whole subtree that one task
appends; its root is then appended, like a leaf, to a frontier of block roots, and so on (each step divides the nodes by
4096). Coming back, the witness of a block root is what all its leaves' witnesses are extended by. The roots of the
groups are appended to one more tree in the same way. Only digests are shuffled, never texts; witnesses are not shuffled at
all for leaves, since a block meets the one row that extends it in its own task.

Places in a tree come from a range partition by group, order column, digest and a number for equal rows, and from the counts before each
part, so a group that holds most rows is spread over many tasks, and so are rows that repeat.

Defined cases: a null field is written ``-``; a null group is a group of its own and comes first; null order values come first;
rows with equal order value are ordered by digest, repeated rows are leaves of their own; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docfacts.llm.common import written

FANOUT = 8
#: Levels that one task appends: blocks of 4096 leaves.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WITNESS = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it, so that neighbours cannot run into each other; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes up to the one that stands alone."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Frontier:
    """Open subtrees of an append, and the witnesses of all leaves so far."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._push(0, (leaf, at, at + 1))

    def _push(self, level: int, node: tuple[str, int, int]) -> None:
        self.open[level].append(node)
        if level < self.levels and len(self.open[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The open run of a level becomes a node of the next; the leaves below are told their siblings."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            step = "".join(digests[:k]), "".join(digests[k + 1 :])
            for leaf in range(first, end):
                self.witnesses[leaf].append(step)
        self._push(level + 1, (digest("".join(digests)), run[0][1], run[-1][2]))

    def close(self) -> str:
        """Complete what is open, from the leaves up. The root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def _appended(table: pa.Table, levels: int) -> tuple[pa.Table, Frontier, str]:
    """The nodes of a block in order, their frontier and the block's root."""
    table = table.sort_by("pos")
    frontier = Frontier(min(levels_of(table.column("n")[0].as_py()), levels))
    for node in table.column("digest").to_pylist():
        frontier.append(node)
    return table, frontier, frontier.close()


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FANOUT**levels}"))


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of all blocks, as nodes of the next step: ``tree, pos, digest, n``."""

    def root(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = key
        nodes_above = -(-table.column("n")[0].as_py() // FANOUT**levels)
        return pa.table({"tree": [tree.as_py()], "pos": [block.as_py()], "digest": [_appended(table, levels)[2]], "n": [nodes_above]})

    slim = _blocks(nodes.select("tree", "pos", "digest", "n"), levels)
    return slim.groupBy("tree", "block").applyInArrow(root, "tree string, pos long, digest string, n long")


def _extended(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The nodes with whole witnesses: inside their block, then as the block's root has it in ``above``."""
    names = [c for c in nodes.columns if c not in ("pos", "n")]

    def extend(key: tuple, table: pa.Table, upper: pa.Table) -> pa.Table:
        table, frontier, _ = _appended(table, levels)
        later = [(step["left"], step["right"]) for step in upper.column("witness")[0].as_py()]
        steps = [step for witness in frontier.witnesses for step in (*witness, *later)]
        length = frontier.levels + len(later)
        both = pa.StructArray.from_arrays([pa.array([s[side] for s in steps], pa.string()) for side in (0, 1)], ["left", "right"])
        ends = pa.array(range(0, length * table.num_rows + 1, length) if length else [0] * (table.num_rows + 1), pa.int32())
        whole = table.select([*names, "pos"]).append_column("witness", pa.ListArray.from_arrays(ends, both))
        return whole.append_column("subroot", pa.array([upper.column("subroot")[0].as_py()] * table.num_rows, pa.string()))

    kinds = dict(nodes.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "pos long", f"witness {_WITNESS}", "subroot string"])
    met = above.select("tree", F.col("pos").alias("block"), "witness", "subroot")
    return _blocks(nodes, levels).groupBy("tree", "block").cogroup(met.groupBy("tree", "block")).applyInArrow(extend, schema)


def _placed(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``pos``, their place in their tree, and ``n``, the size of the tree."""
    keys = ["tree", *order]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "ranged")
    runs = ranged.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    joined = ranged.join(shifts, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift"))
    return joined.select("tree", "pos", *[c for c in leaves.columns if c != "tree"], "n")


def _steps(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes, and the block roots of each further step up to one node for each tree."""
    steps = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        steps.append(written(_block_roots(steps[-1], levels), "blocks"))
        most = -(-most // FANOUT**levels)
    return steps


def _descended(steps: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Witnesses for the first of the steps, from those of the last: ``above`` has a row for each tree."""
    if len(steps) == 1:
        return steps[0].join(above.select("tree", "pos", "witness", "subroot"), ["tree", "pos"])
    for nodes in steps[-2:0:-1]:
        above = written(_extended(nodes, above, levels), "witnesses")
    return _extended(steps[0], above, levels)


def manifest(
    documents: DataFrame,
    fields: Sequence[str] = FIELDS,
    order: str = "doc_id",
    group: str = "lang",
    also: dict[str, Column] | None = None,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """A witness for every document: ``doc_id`` (the order column), ``leaf, pos, witness, subroot, root`` and what ``also`` adds.

    ``also`` are further columns over the documents that travel with the leaf. ``witness`` has one entry for each level up to the root: the
    digests ``left`` and ``right`` of the node in its run, run together. Places in a group are ascending by the order column.
    """
    spark = documents.sparkSession
    also = also or {}
    carried = [F.col(order).alias("order"), leaf_digest(*(F.col(f) for f in fields)).alias("digest"), *(c.alias(f"also_{name}") for name, c in also.items())]
    # An empty name is the null group: it comes before all others, which keep their order in bytes.
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("tree")
    leaves = written(documents.select(tree, *carried, F.monotonically_increasing_id().alias("tie")), "leaves")
    steps = _steps(_placed(leaves, ["order", "digest", "tie"]), block_levels)
    subroots = steps[-1].select(F.lit("").alias("tree"), F.col("tree").alias("order"), "digest")
    top = _steps(_placed(written(subroots, "subroots"), ["order"]), block_levels)
    root = top[-1].select("digest").first()
    root = root[0] if root else None
    empty = F.array().cast(_WITNESS)
    summit = spark.range(1).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("pos"), empty.alias("witness"), F.lit(root).cast("string").alias("subroot"))
    of_trees = written(_descended(top, summit, block_levels), "witnesses")
    above = of_trees.select(F.col("order").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness", F.col("digest").alias("subroot"))
    found = _descended(steps, above, block_levels)
    return found.select(
        F.col("order").alias(order), F.col("digest").alias("leaf"), "pos", "witness", "subroot", F.lit(root).cast("string").alias("root"),
        *(F.col(f"also_{name}").alias(name) for name in also),
    )


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    return F.aggregate(witness, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_text(witness: Column) -> Column:
    """All sibling digests of a witness, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda step: F.concat(step["left"], step["right"])), "")


def verified_manifest(documents: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest checked against documents of which some were changed: one row for each document row.

    Changed are those whose id has a CRC-32 that 3 divides: their texts lose the capitals A to Z. A null id is not changed.
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.when(changed, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    seen = leaf_digest(*(text if f == "text" else F.col(f) for f in FIELDS))
    made = manifest(documents, also={"seen": seen}, block_levels=block_levels)
    checked = made.withColumns({"proof_sha256": F.sha2(proof_text(F.col("witness")), 256), "folded_root": folded(F.col("seen"), F.col("witness"))})
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
