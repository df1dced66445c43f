"""Merkle manifest of a dataset: a digest, a proof and its check for every row (operator 12).

Each row is a leaf, the SHA-256 of its columns. The leaves of each tree (here: each source) stand in the order of their keys; every 16
consecutive nodes become one of the next level until one is left, and the trees' last nodes become the root likewise.

Work is cut into superblocks of 16^3 nodes, so that no group is larger, however large a tree is. Going up, each superblock
is reduced to one node by applyInPandas, and these nodes again, one layer of superblocks after another. Going down,
the nodes of a layer are cogrouped by superblock with what the layer above has found for it: the outer siblings. The last
such exchange finishes the local levels, joins inner and outer siblings to the proof and folds it, leaf by leaf.

Positions of leaves come from a range sort: numbers within the partitions, and prefix sums over the rows that a partition has
of each tree. Only the number of nodes left in the largest tree reaches the driver.

Edge cases: a null in any column counts as `-`; a null tree is a tree of its own and the first; null keys come first in
their tree; rows with equal keys follow by leaf, and equal rows are leaves each. A tree of one leaf is that leaf. An
empty table has no rows. Texts of any length are one row. Other columns than the named ones don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skypairs.llm.columns import written

FANOUT = 16
LEVELS = 3
SUPERBLOCK = FANOUT**LEVELS
_DIGEST = 64


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row: of each value its bytes in UTF-8, their number before them; `-` for null."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the number of the run of equal trees (first column) in it, and the row's number in the run."""
    part, run, local, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        trees = batch.column(0).dictionary_encode(null_encoding="encode")
        code, names = trees.indices.to_numpy(zero_copy_only=False), trees.dictionary.to_pylist()
        new = np.ones(n, bool)
        new[1:] = code[1:] != code[:-1]
        new[0] = run < 0 or names[code[0]] != last
        runs = run + np.cumsum(new)
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        numbers = np.where(begin < 0, local + np.arange(n), np.arange(n) - begin)
        run, local, last = int(runs[-1]), int(numbers[-1]) + 1, names[code[-1]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(runs), pa.array(numbers)],
                                         [*batch.schema.names, "part", "run", "local"])


def positions(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """The rows with tree_no (from 0, by tree, null first), pos (from 0 in the tree, in `order`, nulls first) and total (rows of
    the tree) in place of the tree. Rows that are equal in tree and order may come in any order."""
    keys = [F.col(c).asc_nulls_first() for c in [tree, *order]]
    spread = F.xxhash64(F.monotonically_increasing_id()).asc()  # many rows that are equal in all keys
    others = [c for c in rows.columns if c != tree]
    ranged = rows.select(tree, *others).repartitionByRange(*keys, spread).sortWithinPartitions(*keys)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema), "part long, run long, local long"])
    table = written(ranged.mapInArrow(_runs, schema))

    # one row for each tree of each partition; a tree has at most as many of them as there are partitions
    of_tree = Window.partitionBy(tree)
    runs = (table.groupBy("part", "run").agg(F.first(tree).alias(tree), F.count("*").alias("n"))
            .withColumn("offset", F.sum("n").over(of_tree.orderBy("part")) - F.col("n"))
            .withColumn("total", F.sum("n").over(of_tree))
            .withColumn("first", F.min(F.struct("part", "run")).over(of_tree)))
    starts = (runs.filter("first.part = part").groupBy("part").agg(F.count("*").alias("trees"), F.min("run").alias("least"))
              .withColumn("before", F.sum("trees").over(Window.orderBy("part")) - F.col("trees"))  # one row for each partition
              .select(F.col("part").alias("start"), "before", "least"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SUPERBLOCK}")))
    runs = (runs.join(starts, F.col("first.part") == F.col("start"))
            .select("part", "run", chunk.alias("chunk"), "offset", "total",
                    (F.col("before") + F.col("first.run") - F.col("least")).alias("tree_no")))
    numbered = table.withColumn("chunk", F.expr(f"local div {SUPERBLOCK}")).join(runs, ["part", "run", "chunk"])
    return numbered.select(*others, "tree_no", (F.col("offset") + F.col("local")).alias("pos"), "total")


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _reduced(nodes: list[str], total: int) -> list[list[str]]:
    """The runs of each level of a superblock, joined: all levels of a tree that is one superblock, else LEVELS."""
    levels = []
    while (len(nodes) > 1) if total <= SUPERBLOCK else (len(levels) < LEVELS):
        levels.append(["".join(nodes[k:k + FANOUT]) for k in range(0, len(nodes), FANOUT)])
        nodes = [_digest(run) for run in levels[-1]]
    return levels


def _siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """What stands left and right of the node in the run of each level."""
    for runs in levels:
        run, place = runs[at // FANOUT], at % FANOUT * _DIGEST
        yield run[:place], run[place + _DIGEST:]
        at //= FANOUT


def _tops(nodes: DataFrame) -> DataFrame:
    """tree_no, pos, total, digest of the next layer: one node for each superblock."""
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        total, block = int(group["total"].iloc[0]), int(group["pos"].iloc[0]) // SUPERBLOCK
        levels = _reduced(group["digest"].tolist(), total)
        digest = _digest(levels[-1][0]) if levels else group["digest"].iloc[0]
        return pd.DataFrame({"tree_no": group["tree_no"].iloc[:1].to_numpy(), "pos": [block], "total": [-(-total // SUPERBLOCK)],
                             "digest": [digest]})

    block = F.expr(f"pos div {SUPERBLOCK}").alias("block")
    return (nodes.select("tree_no", "pos", "total", "digest").groupBy("tree_no", block)
            .applyInPandas(reduce, "tree_no long, pos long, total long, digest string"))


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """Layers of superblocks, the last of one node for each tree."""
    layers = [nodes]
    while (layers[-1].agg(F.max("total")).first()[0] or 1) > 1:
        layers.append(written(_tops(layers[-1])))
    return layers


_OUTER = "tree_no long, pos long, subroot string, root string, lefts array<string>, rights array<string>"


def _down(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Of each node of a layer the siblings up to the root, from those of the layer above."""
    def extend(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, above = group.sort_values("pos"), above.iloc[0]
        levels = _reduced(group["digest"].tolist(), int(group["total"].iloc[0]))
        sides = [list(_siblings(levels, k)) for k in range(len(group))]
        return pd.DataFrame({"tree_no": group["tree_no"], "pos": group["pos"], "subroot": above["subroot"], "root": above["root"],
                             "lefts": [[*(s[0] for s in side), *above["lefts"]] for side in sides],
                             "rights": [[*(s[1] for s in side), *above["rights"]] for side in sides]})

    return _exchange(nodes.select("tree_no", "pos", "total", "digest"), outer, extend, _OUTER)


def _exchange(nodes: DataFrame, outer: DataFrame, work, schema: str) -> DataFrame:
    """Nodes of a layer and the outer nodes that they need, cogrouped by superblock."""
    block = F.expr(f"pos div {SUPERBLOCK}").alias("block")
    return nodes.groupBy("tree_no", block).cogroup(outer.groupBy("tree_no", F.col("pos").alias("block"))).applyInPandas(work, schema)


def _folded(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    group, above = group.sort_values("pos"), above.iloc[0]
    levels = _reduced(group["digest"].tolist(), int(group["total"].iloc[0]))
    outer = [*zip(above["lefts"], above["rights"], strict=True)]
    outside = "".join(a + b for a, b in outer)
    proofs, roots = [], []
    for k, node in enumerate(group["shown"]):
        inner = [*_siblings(levels, k)]
        proofs.append(_digest("".join(a + b for a, b in inner) + outside))
        for left, right in (*inner, *outer):
            node = _digest(left + node + right)
        roots.append(node)
    return pd.DataFrame({"key": group["key"], "leaf": group["digest"], "subroot": above["subroot"], "root": above["root"],
                         "proof_sha256": proofs, "folded_root": roots, "verified": [r == above["root"] for r in roots]})


def manifest(rows: DataFrame, key: str, tree: str, leaf: Column, shown: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    leaf: the row's digest. shown: the digest to be proved (null: the leaf). proof_sha256 is the digest of all siblings, level
    by level; folded_root is what the shown digest and the siblings give, verified whether that is the root.
    """
    kind = rows.schema[key].dataType.simpleString()
    digest = F.coalesce(shown, leaf) if shown is not None else leaf
    table = rows.select(F.col(tree).alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), digest.alias("shown"))
    leaves = written(positions(table, "tree", ["key", "digest", "shown"]))
    inner = _layers(leaves)
    trees = inner[-1].select(F.lit(0).cast("long").alias("tree_no"), F.col("tree_no").alias("pos"),
                             F.lit(inner[-1].count()).cast("long").alias("total"), "digest")
    outer = _layers(trees)
    none = F.array().cast("array<string>")
    found = outer[-1].select("tree_no", "pos", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
                             none.alias("lefts"), none.alias("rights"))
    for layer in reversed(outer[:-1]):
        found = written(_down(layer, found))
    # the path of a tree is that of its last node
    found = (found.drop("tree_no", "subroot").withColumnRenamed("pos", "tree_no")
             .join(inner[-1].select("tree_no", "pos", F.col("digest").alias("subroot")), "tree_no"))
    for layer in reversed(inner[1:-1]):
        found = written(_down(layer, found))
    leaves = leaves.withColumn("key", F.col("key").cast("string"))  # pandas would make doubles of numbers with a null among them
    out = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _exchange(leaves, found, _folded, out).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
