"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

A tree splits the vectors of a node along a random direction; each child gets one side of the median and a
margin of the other side.  The margin follows from how far vectors that link can lie apart against how far the node's
vectors do, so near vectors are seldom parted in narrow nodes either.  A node whose mean cosine is that of a link is not
split: there, most pairs are links.  Trees are fitted on the driver, on a sample of at most about ``SAMPLE`` vectors; every vector of
the table is then sent down every tree.  Leaves that are still too full are split further by Spark jobs, each
by trees fitted on a sample of its own, until all are small; a large leaf is cut into blocks for that.

Each length of vectors has trees of its own, so vectors of two models do not meet; lengths too rare for the sample have one
leaf.  Vectors are scaled by their largest component before anything is squared.

Vectors of a leaf are compared by cosine in double precision.  A leaf of more than ``BLOCK`` vectors is cut into
blocks and each pair of blocks is a task of its own, so no group is held at once however large a leaf is.  A pair
that shares several leaves counts in the first of them only.  Tasks return numbers of links and, for the components, edges of a
spanning forest of what they linked; linked pairs are never listed.

Equal vectors are compared once and counted with their number.  Vectors that are null, zero, or hold null or
non-finite components link with nothing, and vectors of different lengths not with each other.  Of rows with equal ids and vectors
each counts as a vector; a row without an id is not compared, and has itself no component.  Empty tables give no rows;
other columns are ignored.  The search is approximate by its nature; ``tests/llm`` measures its recall.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.tables import keep
from relweave.operators.explore import smallest_reachable
from relweave.operators.ranking import top_k

#: Cosine of a link.
THRESHOLD = 0.9
TREES = 8
#: Vectors the trees are fitted on, at most about.
SAMPLE = 60_000
#: Vectors of the table a leaf should have.
LEAF = 400
#: Part of the distance of linked vectors that the overlap of two children is wide.
OVERLAP = 0.8
#: A leaf of the table is split further beyond so many times ``LEAF`` vectors, on a sample of so many of them.
OVERFULL = 8
LEAF_SAMPLE = 4_096
#: Vectors of one task of that.
SPLIT_BLOCK = 50_000
#: Vectors of a leaf that are compared at once.
BLOCK = 1_500
#: Smallest number of sampled vectors of a leaf.
LEAST_SAMPLED = 12


class Tree(NamedTuple):
    """Nodes of a tree; a leaf has direction -1 and its number in ``left``."""

    direction: np.ndarray
    low: np.ndarray  # up to here to the left child
    high: np.ndarray  # from here to the right child
    left: np.ndarray
    right: np.ndarray


def spill(spread: float, threshold: float) -> float:
    """Share of a node's vectors that a child gets from the other side of the median.

    ``spread`` is one less the node's mean cosine.  In a random direction linked vectors differ by as much of the node's deviation
    as their distance is of its spread; the overlap is a part of that, and its share that of a normal distribution.
    """
    width = OVERLAP * math.sqrt(2 * (1 - threshold) / max(spread, 1e-9))
    return 0.5 * math.erf(width / 2 / math.sqrt(2))


def grow(
    vectors: np.ndarray, generator: np.random.Generator, leaf: int, first_leaf: int, threshold: float = THRESHOLD
) -> tuple[Tree, np.ndarray, int]:
    """One tree on unit vectors, its directions, and the next free leaf number."""
    rows, directions = [], []

    def split(members: np.ndarray) -> int:
        nonlocal first_leaf
        here = len(rows)
        rows.append([-1, 0.0, 0.0, first_leaf, -1])
        mean = vectors[members].mean(axis=0)
        spread = 1 - float(mean @ mean)
        if len(members) > leaf and spread > 1 - threshold:
            direction = generator.standard_normal(vectors.shape[1])
            cast = vectors[members] @ direction
            margin = spill(spread, threshold)
            high, low = np.quantile(cast, [0.5 - margin, 0.5 + margin])
            if low > high:
                directions.append(direction)
                number = len(directions) - 1
                left, right = split(members[cast <= low]), split(members[cast >= high])
                rows[here] = [number, low, high, left, right]
                return here
        first_leaf += 1
        return here

    split(np.arange(len(vectors)))
    columns = list(zip(*rows, strict=True))
    tree = Tree(*(np.array(c) for c in columns))
    return tree, np.array(directions).reshape(-1, vectors.shape[1]), first_leaf


def leaves_of(vectors: np.ndarray, tree: Tree, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vector and leaf of every place that vectors come to in a tree."""
    which, leaf = [], []
    waiting = [(0, np.arange(len(vectors)))]
    while waiting:
        node, members = waiting.pop()
        if not len(members):
            continue
        if tree.direction[node] < 0:
            which.append(members)
            leaf.append(np.full(len(members), int(tree.left[node])))
            continue
        cast = vectors[members] @ directions[tree.direction[node]]
        waiting.append((int(tree.left[node]), members[cast <= tree.low[node]]))
        waiting.append((int(tree.right[node]), members[cast >= tree.high[node]]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(which or [none]), np.concatenate(leaf or [none])


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _usable(vector: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _fitted(points: np.ndarray, trees: int, seed: int, leaf: int, free: int, threshold: float) -> tuple[list[tuple], int]:
    forest = []
    for k in range(trees):
        tree, directions, free = grow(points, np.random.default_rng([seed, k]), leaf, free, threshold)
        forest.append((tuple(tree), directions))
    return forest, free


def _forest(vectors: DataFrame, trees: int, seed: int, threshold: float) -> dict[int, list[tuple]]:
    """For each length of vectors its trees.  Their leaves are numbered from 1 on, through all of them."""
    total = vectors.count()
    share = min(1.0, SAMPLE / max(total, 1))
    # Cut by a hash, so that a second run takes the same vectors.
    sample = vectors.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("node").select("embedding").toArrow()
    column, forest, free = sample.column("embedding").combine_chunks(), {}, 1
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    for size in np.unique(sizes).tolist():
        points = _unit(column.filter(pa.array(sizes == size)))
        leaf = max(LEAST_SAMPLED, int(LEAF * share))
        if len(points) > leaf:
            forest[size], free = _fitted(points, trees, seed, leaf, free, threshold)
    return forest


def _down(unit: np.ndarray, forest: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Vector and leaf of every place in a forest, by vector."""
    found = [leaves_of(unit, Tree(*tree), directions) for tree, directions in forest]
    which, leaf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.lexsort((leaf, which))
    return which[order], leaf[order]


def _placed(vectors: DataFrame, forest: dict[int, list[tuple]]) -> DataFrame:
    """node, copies, embedding, leaf: a row for each leaf of each vector.  A length without trees is one leaf, below zero."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            for begin in range(0, len(batch), 2_000):
                part = batch.slice(begin, 2_000)
                sizes = np.diff(part.column("embedding").offsets.to_numpy())
                for size in np.unique(sizes).tolist():
                    own = part.filter(pa.array(sizes == size))
                    if size in shared.value:
                        which, leaf = _down(_unit(own.column("embedding")), shared.value[size])
                    else:
                        which, leaf = np.arange(len(own)), np.full(len(own), -size)
                    yield _rows(own, which, leaf)

    return vectors.select("node", "copies", "embedding").mapInArrow(place, _schema(vectors))


def _schema(vectors: DataFrame) -> str:
    return f"node long, copies long, embedding {vectors.schema['embedding'].dataType.simpleString()}, leaf long, solid boolean"


def _rows(part: pa.RecordBatch, which: np.ndarray, leaf: np.ndarray, solid: bool = False) -> pa.RecordBatch:
    rows = pa.array(which)
    return pa.RecordBatch.from_pydict({
        **{c: part.column(c).take(rows) for c in ("node", "copies", "embedding")}, "leaf": pa.array(leaf, pa.int64()), "solid": pa.array([solid] * len(which)),
    })


def _refined(placed: DataFrame, seed: int, threshold: float) -> DataFrame:
    """The rows with leaves of about ``LEAF`` vectors: fuller ones are split again and again, unless nothing parts their vectors."""
    for level in range(1, 4):
        sizes = placed.where("NOT solid").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OVERFULL * LEAF)
        full = keep(sizes.select("leaf", F.ceil(F.col("n") / SPLIT_BLOCK).cast("int").alias("blocks")), "full-leaves")
        if full.isEmpty():
            break
        rows = placed.join(full, "leaf")
        sample = top_k(rows, ["leaf"], [F.xxhash64("node"), F.col("node")], LEAF_SAMPLE, "place").drop("place")
        asked = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(level)), F.col("blocks")).cast("int"))
        copies = sample.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def split(key: tuple, table: pa.Table, fitting: pa.Table) -> pa.Table:
            leaf, shape = key[0].as_py(), pa.schema([*(table.schema.field(c) for c in ("node", "copies", "embedding")), ("leaf", pa.int64()), ("solid", pa.bool_())])
            if not table.num_rows:
                return shape.empty_table()
            points = _unit(fitting.sort_by("fit_node").combine_chunks().column("fit_embedding").combine_chunks())
            # A leaf of a tree takes part in one tree further down: every tree of the forest leads to it once already.
            forest, free = _fitted(points, 1, (seed + leaf) % (1 << 31), max(LEAST_SAMPLED, min(LEAF, len(points) // 8)), 1, threshold)
            batch = table.combine_chunks().to_batches()[0]
            which, sub = _down(_unit(batch.column("embedding")), forest)
            return pa.Table.from_batches([_rows(batch, which, (leaf << 12) + sub, free <= 2)]).cast(shape)

        fitting = copies.select(*[F.col(c).alias(f"fit_{c}") for c in ("node", "embedding", "leaf", "block")])
        groups = asked.select("node", "copies", "embedding", "leaf", "block").groupBy("leaf", "block")
        below = groups.cogroup(fitting.groupBy("fit_leaf", "fit_block")).applyInArrow(split, _schema(placed))
        rest = placed.join(full, "leaf", "left_anti").withColumn("leaf", F.shiftleft("leaf", 12)).select(below.columns)
        placed = keep(rest.union(below), "placed")
    return placed


def _with_leaves(placed: DataFrame) -> DataFrame:
    """The rows with all leaves of their vector in order; a vector is in a few leaves of each tree."""
    leaves = placed.groupBy("node").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    return placed.drop("solid").join(leaves, "node")


def _blocked(placed: DataFrame) -> DataFrame:
    """The rows of each leaf for each pair of its blocks."""
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("*", other).select(
        "leaf", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "copies", "embedding", "leaves"
    )


def _earlier(leaves: pa.Array, leaf: int) -> np.ndarray:
    """For each row a set of bits, one for each earlier leaf that two rows or more are in."""
    flat = leaves.flatten().to_numpy()
    row = np.repeat(np.arange(len(leaves)), np.diff(leaves.offsets.to_numpy()))
    row, flat = row[flat < leaf], flat[flat < leaf]
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    kept = count[number] > 1
    row, bit = row[kept], place[number[kept]]
    out = np.zeros((len(leaves), int((count > 1).sum()) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(out, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def _compared(threshold: float):
    def compare(key, table):
        leaf, a, b = (k.as_py() for k in key)
        table = table.combine_chunks()
        block = table.column("block").to_numpy()
        unit = _unit(table.column("embedding").combine_chunks())
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        earlier = _earlier(table.column("leaves").combine_chunks(), leaf)
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        edges: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for begin in range(0, len(left), 250):
            rows = left[begin : begin + 250]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold)
            i, j = rows[i], right[j]
            fresh = (i < j) if a == b else np.ones(len(i), dtype=bool)
            i, j = i[fresh], j[fresh]
            seen = np.zeros(len(i), dtype=bool)
            for word in range(earlier.shape[1]):
                seen |= (earlier[i, word] & earlier[j, word]) != 0
            i, j = i[~seen], j[~seen]
            links += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[x] = y
                    edges.append((x, y))
        linked = np.flatnonzero(links)
        return pa.table({
            "node": pa.array(np.concatenate([node[linked], node[[x for x, _ in edges]]]) if len(linked) else [], pa.int64()),
            "other": pa.array([None] * len(linked) + node[[y for _, y in edges]].tolist() if len(linked) else [], pa.int64()),
            "links": pa.array(links[linked].tolist() + [0] * len(edges) if len(linked) else [], pa.int64()),
        })

    return compare


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reached), kept."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"  # half the bytes; compared in double precision
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    good = rows.where(F.col("vec_id").isNotNull() & _usable("embedding"))
    key = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x.cast("double") + 0.0).cast("string"))), 256)
    named = keep(good.withColumn("key", key), "vectors")
    distinct = keep(
        named.groupBy("key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "distinct-vectors"
    )
    placed = _refined(keep(_placed(distinct, _forest(distinct, trees, seed, threshold)), "placed"), seed, threshold)
    found = keep(
        _blocked(keep(_with_leaves(placed), "placed-with-leaves")).groupBy("leaf", "a", "b").applyInArrow(_compared(threshold), "node long, other long, links long"),
        "vector-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = named.select("vec_id", "key").join(distinct.select("key", "node", "copies"), "key")
    edges = found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")).union(
        members.where("vec_id <> node").select(F.col("vec_id").alias("u"), F.col("node").alias("v"))
    )
    classes = smallest_reachable(edges).select(F.col("id").alias("vec_id"), "component")
    # Rows that share an id: their links are told at each row by its own vector.
    counts = members.join(links, "node", "left").select("vec_id", F.col("key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = rows.withColumn("key", key).join(counts.distinct(), ["vec_id", "key"], "left").join(classes, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return told.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
