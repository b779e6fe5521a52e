"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits the vectors again and again along random directions; vectors close to a split go to both
sides (spill), so that near ones seldom part. Of several directions and cuts the one that spills least is
taken, and a node that no cut can divide without spilling much, a dense cloud, stays a leaf. The trees
are fitted on a bounded sample; every vector is led through every tree and compared with all others in
its leaves, in double precision. Large leaves are compared block by block in tasks of their own.

A pair that meets in several leaves counts in the first of them only, so links are counted where they
are found and no pair leaves its task: each leaf sends a count and a smallest linked id for each vector.
Equal vectors are one point with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.session import attach, tidy
from gleanery.session import materialise, small_side

TREES = 5
#: Vectors that the trees are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Vectors in a leaf, about; sampled vectors that a node needs to be split.
LEAF, LEAST_SAMPLE = 800, 24
#: Width of the spill on each side of a cut, in standard deviations of the node's projections.
SPILL = 0.15
#: Directions and cuts tried for a node, and the share of spilled vectors at which it stays a leaf.
DIRECTIONS, CUTS, DENSE = 4, (0.3, 0.4, 0.5, 0.6, 0.7), 0.5
#: Vectors of a large leaf that are compared at once.
BLOCK = 2_000


@dataclass
class Node:
    direction: np.ndarray | None = None
    cut: float = 0.0
    margin: float = 0.0
    sides: tuple[Node, Node] | None = None
    leaf: int = -1


def grow(sample: np.ndarray, total: int, seed: int = 7) -> tuple[list[Node], int]:
    """(trees, number of leaves) from unit vectors of a sample of `total`."""
    rng = np.random.default_rng(seed)
    leaves = 0

    def node(rows: np.ndarray) -> Node:
        nonlocal leaves
        expected = len(rows) * total / max(1, len(sample))
        best = None
        if expected > LEAF and len(rows) >= LEAST_SAMPLE:
            for _ in range(DIRECTIONS):
                direction = rng.standard_normal(sample.shape[1])
                direction /= np.linalg.norm(direction)
                at = sample[rows] @ direction
                margin = SPILL * at.std()
                for cut in np.quantile(at, CUTS):
                    spilled = float((np.abs(at - cut) <= margin).mean())
                    lopsided = abs(float((at <= cut).mean()) - 0.5)
                    if best is None or spilled + 0.1 * lopsided < best[0]:
                        best = (spilled + 0.1 * lopsided, spilled, direction, float(cut), float(margin), at)
        if best is None or best[1] > DENSE:
            leaves += 1
            return Node(leaf=leaves - 1)
        _, _, direction, cut, margin, at = best
        sides = node(rows[at <= cut + margin]), node(rows[at >= cut - margin])
        return Node(direction, cut, margin, sides)

    return [node(np.arange(len(sample))) for _ in range(TREES)], leaves


def leaves_of(trees: list[Node], unit: np.ndarray) -> list[list[int]]:
    """The leaves of each vector over all trees, in rising order."""
    out: list[list[int]] = [[] for _ in range(len(unit))]
    for tree in trees:
        stack = [(tree, np.arange(len(unit)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node.sides is None:
                for r in rows:
                    out[r].append(node.leaf)
                continue
            at = unit[rows] @ node.direction
            stack.append((node.sides[0], rows[at <= node.cut + node.margin]))
            stack.append((node.sides[1], rows[at >= node.cut - node.margin]))
    return [sorted(x) for x in out]


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _compare(width: int, least: float):
    """Links of the vectors that meet in one leaf, or in two blocks of a large one."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        leaf, one, two = key[0].as_py(), key[1].as_py(), key[2].as_py()
        ids = table["id"].to_numpy()
        weight = table["weight"].to_numpy()
        unit = _unit(table["vector"].combine_chunks(), width)
        near = unit @ unit.T >= least
        np.fill_diagonal(near, False)
        if one != two:
            own = table["block"].to_numpy()
            near &= own[:, None] != own[None, :]
        reach = ids.copy()
        while True:  # the smallest id over links, again until nothing changes
            least_near = np.where(near, reach[None, :], np.iinfo(np.int64).max).min(axis=1) if len(ids) else reach
            new = np.minimum(reach, least_near)
            if (new == reach).all():
                break
            reach = new
        # pairs that meet in an earlier leaf were counted there
        before = [[x for x in row if x < leaf] for row in table["leaves"].to_pylist()]
        names = {x: k for k, x in enumerate(sorted({x for row in before for x in row}))}
        if names:
            member = np.zeros((len(ids), len(names)), np.float32)
            for k, row in enumerate(before):
                member[k, [names[x] for x in row]] = 1
            near &= member @ member.T == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(near @ weight), pa.array(reach)], names=["id", "n", "reach"]
        )

    return run


def _by_given_ids(points: DataFrame) -> DataFrame:
    """`points` with components that are called by the number of a vector without an id named by given ids."""
    without = points.filter("own is null").select(F.col("id").alias("component"))
    if without.isEmpty():
        return points
    given = points.join(without, "component", "left_semi").groupBy("component").agg(F.min("own").alias("given"))
    given = materialise(given.withColumn("renamed", F.lit(True)), "given")
    component = F.when(F.col("renamed"), F.col("given")).otherwise(F.col("component"))
    return points.join(small_side(given), "component", "left").withColumn("component", component)


def near_vectors(
    vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of `vectors`.

    Vectors link where their cosine is at least `least`. Null vectors, zero vectors, those with null or
    non-finite parts, and those of another length than most link with nothing. One output row for each
    input row; rows that share an id are different vectors for n_links and one node for components. Rows with
    null ids are vectors like others: they are compared, counted and join components, but never name one;
    where only such rows are linked the component is null. Kept is true where the id is its component's, and
    for null ids in such components. Other columns are ignored.
    """
    spark = attach(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("vector", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("vector", F.when(fine, F.transform("vector", lambda x: x + F.lit(0.0))))
    sizes = rows.filter("vector is not null").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width")
    first = sizes.first()
    plain = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if first is None:
        return plain
    width = first["width"]
    rows = rows.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")))
    points = materialise(
        rows.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("weight"))
        .withColumn("id", F.coalesce("own", F.lit((1 << 63) - 1) - F.xxhash64("vector").bitwiseAND((1 << 61) - 1))),
        "points",
    )
    total = points.count()
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    trees, _ = grow(_unit(sample["vector"].combine_chunks(), width) if total else np.zeros((0, width)), total)
    sent = spark.sparkContext.broadcast(trees)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = leaves_of(sent.value, _unit(batch.column("vector"), width)) if len(batch) else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "weight", "vector")] + [pa.array(leaves, pa.list_(pa.int32()))],
                names=["id", "weight", "vector", "leaves"],
            )

    led = materialise(
        points.select("id", "weight", "vector").mapInArrow(tidy(lead), "id long, weight long, vector array<double>, leaves array<int>"),
        "led",
    )
    placed = led.withColumn("leaf", F.explode("leaves"))
    blocks = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(small_side(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = placed.select(
        "leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "block", "id", "weight", "vector", "leaves",
    )
    found = materialise(meets.groupBy("leaf", "one", "two").applyInArrow(_compare(width, least), "id long, n long, reach long"), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    label = components(found.filter("id != reach").select(F.col("id").alias("a"), F.col("reach").alias("b")))
    points = (
        points.join(counts, "id", "left").join(label, "id", "left")
        .select(
            "vector", "id", "own", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    points = _by_given_ids(points).select("vector", "n", "component")
    out = rows.join(points, "vector", "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    return out.select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
