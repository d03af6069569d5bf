"""Merkle manifest of a dataset: a hash tree over all documents, a proof for each, and its check.

H is the lowercase hex SHA-256 of its inputs joined, digests as their hex text.  A leaf is H of the fields
doc_id, source, lang, n_chars, text, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value.  The
leaves of a language, by doc_id, and then the subroots of all languages, null first, are each reduced by pairs to one
node; at a level with several nodes a last one without a partner becomes its own H.

A superblock is ``2**BLOCK_BITS`` neighbouring nodes, aligned, so partners are always in one superblock:

1. Leaves are hashed by Spark's own functions and numbered within their language by range partitions: no language is
   sorted in one task.  Texts do not travel.
2. Superblocks are reduced to their top nodes, level of superblocks by level, until each language has one node; the
   subroots, numbered by language, go the same way to the root.
3. Back down, nodes and the outer nodes above their superblock (partners on the way to the root, one short
   list for each superblock) are cogrouped by superblock.  One function reduces the block again, joins the
   partners inside it with those outside, and at the leaves folds the claimed leaf with them up to a root.

A task holds one superblock at a time and a list as long as the tree is high; nothing is collected but the size of
the largest group.

Rows without a doc_id come first.  Rows that share a doc_id are ordered by leaf, and each gets a row; equal rows are
interchangeable.  Null languages are a group of their own, before all others, the empty one next.  A table without rows
gives none.  Columns other than the five fields are not read, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.llm.tables import keep

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree inside one superblock.
BLOCK_BITS = 12

_NODES = "group string, position long, total long, node string"
_ABOVE = "group string, position long, outer array<string>, subroot string, root string"
_PROOFS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(**values: Column) -> Column:
    """H of a document's fields; given columns take the place of the document's own."""
    parts = []
    for name in FIELDS:
        text = values.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(documents: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Numbered leaves with the leaf that someone claims each document to have (its own, unless given), stored."""
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    rows = documents.select(
        group.alias("group"), F.col("doc_id"), leaf_hash().alias("node"), (leaf_hash() if claimed is None else claimed).alias("claimed")
    )
    return _numbered(rows, ["doc_id", "node"])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``position`` (from 0) and ``total`` within their group, stored."""
    # Stored before numbering: a range partitioning that is drawn again may cut elsewhere.
    placed = keep(rows.repartitionByRange("group", *order).withColumn("part", F.spark_partition_id()), "manifest-ranges")
    sizes = placed.groupBy("group", "part").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("group")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("group", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(whole).alias("total"))
    inside = F.row_number().over(Window.partitionBy("group", "part").orderBy(*order)) - 1
    numbered = placed.withColumn("inside", inside).join(starts, ["group", "part"])
    return keep(numbered.withColumn("position", F.col("start") + F.col("inside")).drop("part", "inside", "start"), "manifest-nodes")


def _h(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def _local_levels(nodes: list[str], total: int, bits: int) -> list[list[str]]:
    """The levels of a superblock, from its nodes to its top; ``total`` nodes are in the whole group."""
    levels = [nodes]
    for _ in range(min(bits, max(total - 1, 0).bit_length())):
        below = levels[-1]
        levels.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def _partners(levels: list[list[str]], place: int) -> list[str]:
    """On the way up from a place: the partner with the side it stands on, or nothing where there is none."""
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((("<" if place & 1 else ">") + level[other]) if other < len(level) else "")
        place >>= 1
    return out


def fold(leaf: str, partners: list[str]) -> str:
    """The root that follows from a leaf and its partners."""
    for partner in partners:
        leaf = _h(partner[1:], leaf) if partner.startswith("<") else _h(leaf, partner[1:])
    return leaf


def _reduce(bits: int):
    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block, total = block.sort_values("position"), int(block["total"].iloc[0])
        top = _local_levels(block["node"].tolist(), total, bits)[-1]
        return pd.DataFrame({"group": [key[0]], "position": [key[1]], "total": [-(-total >> bits)], "node": top})

    return reduce


def _climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes, the tops of their superblocks, the tops of those, and so on until each group has one node."""
    stages = [nodes]
    while (stages[-1].agg(F.max("total")).first()[0] or 0) > 1:
        below = stages[-1].select("group", "position", "total", "node")
        tops = below.groupBy("group", _block(bits)).applyInPandas(_reduce(bits), _NODES)
        stages.append(keep(tops, "manifest-tops"))
    return stages


def _block(bits: int) -> Column:
    return F.shiftright("position", bits).alias("block")


def _descend(stages: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """What stands above each node of the lowest stage, given what stands above each group's last node."""
    for nodes in reversed(stages):
        above = _exchange(nodes.select("group", "position", "total", "node"), above, bits, _pass_on(bits), _ABOVE)
    return above


def _exchange(nodes: DataFrame, above: DataFrame, bits: int, function, schema: str) -> DataFrame:
    """Nodes and the outer nodes of their superblock, cogrouped by superblock."""
    blocks = above.withColumnRenamed("position", "block")
    return nodes.groupBy("group", _block(bits)).cogroup(blocks.groupBy("group", "block")).applyInPandas(function, schema)


def _pass_on(bits: int):
    def pass_on(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        levels, outer = _local_levels(block["node"].tolist(), int(block["total"].iloc[0]), bits), list(above["outer"].iloc[0])
        out = block[["group", "position"]].copy()
        out["outer"] = [[*_partners(levels, i), *outer] for i in range(len(block))]
        return out.assign(subroot=above["subroot"].iloc[0], root=above["root"].iloc[0])

    return pass_on


def _prove(bits: int, extra: list[str]):
    def prove(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("position")
        levels, outer = _local_levels(block["node"].tolist(), int(block["total"].iloc[0]), bits), list(above["outer"].iloc[0])
        root, proofs, folded = above["root"].iloc[0], [], []
        for i, claimed in enumerate(block["claimed"]):
            partners = [*_partners(levels, i), *outer]
            proofs.append(_h(*[p[1:] for p in partners]))
            folded.append(fold(claimed, partners))
        out = block[extra].assign(leaf=block["node"], subroot=above["subroot"].iloc[0], root=root, proof_sha256=proofs, folded_root=folded)
        return out.assign(verified=[f == root for f in folded])

    return prove


def proofs(leaves: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf), verified.

    The proof is the partners on the way to the root, level by level; its digest is H of them, left to right.
    """
    trees, tops = subroots(leaves, bits)
    last = tops[-1].select("group", F.lit(0).cast("long").alias("position"), F.array().cast("array<string>").alias("outer"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    places = _descend(tops, last, bits).select("position", "outer", "root")
    above = tops[0].join(places, "position").select(
        F.col("lang_group").alias("group"), F.lit(0).cast("long").alias("position"), "outer", F.col("node").alias("subroot"), "root"
    )
    above = keep(_descend(trees[1:], above, bits), "manifest-outer")
    doc_id = leaves.schema["doc_id"].dataType.simpleString()
    return _exchange(leaves, above, bits, _prove(bits, ["doc_id"]), f"doc_id {doc_id}, {_PROOFS}")


def subroots(leaves: DataFrame, bits: int = BLOCK_BITS) -> tuple[list[DataFrame], list[DataFrame]]:
    """The stages of the trees of all languages, and those of the tree over their subroots."""
    trees = _climb(leaves, bits)
    roots = trees[-1].select(F.lit("").alias("group"), F.col("group").alias("lang_group"), "node")
    return trees, _climb(_numbered(roots, ["lang_group"]), bits)


def summary(documents: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The manifest to publish: lang, n_documents, subroot, root."""
    rows = leaves(documents)
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n_documents"))
    _, tops = subroots(rows, bits)
    lang = F.when(F.col("lang_group").startswith("1"), F.expr("substring(lang_group, 2)"))
    return tops[0].join(counts, F.col("lang_group") == counts["group"]).select(
        lang.alias("lang"), "n_documents", F.col("node").alias("subroot"), tops[-1].select("node").scalar().alias("root")
    )
