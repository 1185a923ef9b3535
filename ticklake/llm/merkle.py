"""A Merkle manifest of a dataset with a witness for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, keep

FAN = 16
LEVELS = 3  # of the tree that one task builds: it appends FAN ** LEVELS nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """Nodes appended in order; every ``FAN`` of a level become one of the next.

    A node's witness is the run it is in, the run its parent is in, and so on.
    While those runs are open it is partial: the completion of a run extends the
    witnesses of all nodes below it by one step, which they share.
    """

    def __init__(self):
        self.open: list[list[str]] = [[]]
        self.runs: list[list[str]] = [[]]  # closed runs by level

    def append(self, node: str, level: int = 0) -> None:
        if level == len(self.open):
            self.open.append([])
            self.runs.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FAN:
            self.close(level)

    def close(self, level: int) -> None:
        run = "".join(self.open[level])
        self.runs[level].append(run)
        self.open[level] = []
        self.append(digest(run), level + 1)

    def finish(self, levels: int) -> str:
        """Close what is open, ``levels`` times, and return the root."""
        for level in range(levels):
            if self.open[level]:
                self.close(level)
        return self.open[levels][0]

    def path(self, place: int, levels: int) -> Iterator[tuple[str, str]]:
        """The witness of a node: what stands before and after it in its run, level by level."""
        for level in range(levels):
            run, at = self.runs[level][place // FAN], 64 * (place % FAN)
            yield run[:at], run[at + 64 :]
            place //= FAN


def height(n: int) -> int:
    """Levels until one of ``n`` nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _built(nodes: pa.Table, span: int) -> tuple[pa.Table, Tree, int, str]:
    """The tree over the nodes of one block: a whole one, or ``span`` levels of one that goes on above."""
    nodes = nodes.sort_by("pos")
    n = nodes["n"][0].as_py()
    levels = height(n) if n <= FAN**span else span
    tree = Tree()
    for node in nodes["node"].to_pylist():
        tree.append(node)
    return nodes, tree, levels, tree.finish(levels)


def in_block(span: int) -> Column:
    return F.expr(f"pos div {FAN**span}L").alias("block")


def block_roots(nodes: DataFrame, span: int = LEVELS) -> DataFrame:
    """``tree, pos, n, node``: the roots of the blocks of ``nodes(tree, pos, n, node)``, which are appended to the tree above."""

    def build(nodes: pa.Table) -> pa.Table:
        rows, _, _, root = _built(nodes, span)
        return pa.table({"tree": rows["tree"][:1], "pos": [rows["pos"][0].as_py() // FAN**span], "n": [-(-rows["n"][0].as_py() // FAN**span)], "node": [root]})

    return nodes.select("tree", "pos", "n", "node").groupBy("tree", in_block(span)).applyInArrow(build, "tree string, pos long, n long, node string")


def witnessed(nodes: DataFrame, span: int = LEVELS) -> DataFrame:
    """``tree, pos, path, root`` of every row of ``nodes(tree, pos, n, node)``.

    Blocks of ``FAN ** span`` nodes are built side by side; their roots are the nodes
    of a further tree, and the witnesses that come from there extend those of the block.
    """
    if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
        return nodes.select("tree", "pos", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("node").alias("root"))
    roots = keep(block_roots(nodes, span))
    above = witnessed(roots, span)

    def extend(own: pa.Table, up: pa.Table) -> pa.Table:
        rows, tree, levels, _ = _built(own, span)
        tail = up["path"][0].as_py()
        paths = [[{"before": b, "after": a} for b, a in tree.path(i, levels)] + tail for i in range(len(rows))]
        return pa.table({"tree": rows["tree"], "pos": rows["pos"], "path": pa.array(paths, STEPS), "root": [up["root"][0].as_py()] * len(rows)})

    own = nodes.select("tree", "pos", "n", "node").groupBy("tree", in_block(span))
    out = keep(own.cogroup(above.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(extend, f"tree string, pos long, path {PATH}, root string"))
    drop_table(roots)
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with ``pos``, the place in its tree by ``order``, and ``n``, the rows of the tree.

    One range sort; a row's place follows from its place in the sorted partition
    and from how many rows of its tree the partitions before hold, so no tree, however
    large, is gathered anywhere.
    """
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = keep(rows.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    runs = rows.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    runs = runs.select("tree", "__part", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy("tree")).alias("n"))
    at = F.col("__before") + F.col("__at") - F.col("__first")
    return rows.join(keep(runs), ["tree", "__part"]).withColumn("pos", at).drop("__at", "__part", "__first", "__before")


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """Hash of a row's :data:`FIELDS`: each ``-`` if null, else its UTF-8 size, ``:`` and itself."""
    each = []
    for name in FIELDS:
        c = (changed or {}).get(name, F.col(name)).cast("string")
        each.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*each), 256)


def manifest(docs: DataFrame, *, tampered: Column | None = None, span: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    A row's leaf is the hash of its fields.  The leaves of a source, by ascending
    doc_id, form a tree with up to 16 children a node; the roots of the sources,
    in the order of their names, form the tree above.  ``tampered`` says what a row's leaf
    is when it is checked (null: unchanged): it is folded with its witness, and verified
    if that gives the root.  ``proof_sha256`` is the hash of the witness.

    Leaves are numbered by one range sort and appended in aligned blocks of ``16 ** span``;
    the roots of blocks are appended to trees above, and what those add
    extends the blocks' witnesses.  A block's witness goes to its rows by
    cogroup, so rows never carry one in a shuffle.

    Null fields count as above; a null source is a source of its own and the first;
    null ids come first in their source; rows that repeat an id go by their
    leaves, and equal ones each have a place.  Empty and very long texts are
    hashed whole.  Other columns are not read.  An empty table gives an empty result.
    """
    tree = F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))  # null first
    bad = F.lit(None).cast("string") if tampered is None else tampered
    leaves = keep(docs.select(F.col("doc_id").cast("long"), tree.alias("tree"), leaf().alias("node"), bad.alias("bad")))
    placed = keep(numbered(leaves, ["doc_id", "node"]))
    drop_table(leaves)
    roots = keep(block_roots(placed, span))
    own = witnessed(roots, span)
    heads = keep(own.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")))
    heads = keep(numbered(heads, ["name"]))
    above = witnessed(heads, span).select("pos", F.col("path").alias("up"), F.col("root").alias("top"))
    above = heads.select(F.col("name").alias("tree"), "pos").join(above, "pos").select("tree", "up", "top")
    whole = own.join(above, "tree").select("tree", "pos", F.concat("path", "up").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))

    def prove(own: pa.Table, up: pa.Table) -> pa.Table:
        rows, tree, levels, _ = _built(own, span)
        tail = [(p["before"], p["after"]) for p in up["path"][0].as_py()]
        last = "".join(b + a for b, a in tail)
        proofs, folded = [], []
        for i, (node, bad) in enumerate(zip(rows["node"].to_pylist(), rows["bad"].to_pylist())):
            at, steps = bad or node, list(tree.path(i, levels))
            proofs.append(digest("".join(b + a for b, a in steps) + last))
            for b, a in (*steps, *tail):
                at = digest(b + at + a)
            folded.append(at)
        subroot, root = up["subroot"][0].as_py(), up["root"][0].as_py()
        n = len(rows)
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    made = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return placed.groupBy("tree", in_block(span)).cogroup(whole.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(prove, made)
