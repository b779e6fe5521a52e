"""Exact dense ranking: int8 vectors against blocks of queries, pruned where the vectors are.

No pair of passage and query is ever shuffled. The queries are written as packed blocks and the vectors packed into
chunks where they lie; Spark brings every chunk together with every block, by a broadcast of as many blocks at a
time as its bound allows. A task multiplies chunk by block and keeps, per query, only what can still be in the top
k of what it has seen; the survivors are merged in slices, then together. Nothing passes through the driver's Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.arrays import wide
from gleanery.operators.scan import laid_out, running
from gleanery.operators.topk import top_k
from gleanery.session import at_most, materialise, small_side

#: Queries of a block, vectors of a chunk, and blocks that are broadcast together (of 384 components: 100 MB).
BLOCK_QUERIES = 2048
CHUNK_ROWS = 4096
BLOCKS_AT_ONCE = 128
#: Parts in which survivors of one query are merged first, where more tasks than this find some.
SLICES = 32
#: Vectors of a file that wait in a task to be scored together, and of all files.
WAITING_ROWS, MOST_WAITING = 2048, 131_072
EXACT_FLOAT32 = 1 << 24  # integers below this are exact in single precision


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(lists) * dim:
        raise ValueError(f"every vector needs {dim} components")
    return flat.reshape(len(lists), dim)


def _multiply(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products through the fast float kernels, in four bytes each where they fit."""
    dim = left.shape[1]
    short = dim * 127 * 127 < EXACT_FLOAT32
    kind = np.float32 if short else np.float64
    dots = left.astype(kind) @ right.astype(kind).T
    return np.rint(dots, out=dots).astype(np.int32 if short else np.int64)


def query_blocks(queries: DataFrame, extra: tuple[str, ...] = ()) -> list[DataFrame]:
    """Tables of packed blocks (block, asked: qid, embedding and `extra` of each query), each small enough to broadcast.

    A batch that fits one block is packed as it is; others are numbered by running counts, so that every block but
    the last is full.
    """
    if at_most(queries, BLOCK_QUERIES):
        one = F.sort_array(F.collect_list(F.struct(F.lit(0).cast("long").alias("_n"), "qid", "embedding", *extra)))
        return [queries.agg(one.alias("asked")).filter(F.size("asked") > 0).select(F.lit(0).alias("block"), "asked")]
    stored = laid_out(queries.select("qid", "embedding", *extra), [], ["qid"])
    numbered = running(stored, [], {"_n": ("sum", F.lit(1).cast("long"))})
    packed = numbered.groupBy(F.floor((F.col("_n") - 1) / BLOCK_QUERIES).cast("int").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("_n", "qid", "embedding", *extra))).alias("asked")  # BLOCK_QUERIES at most
    )
    packed = materialise(packed, "query-blocks")
    passes = -(-packed.count() // BLOCKS_AT_ONCE)
    return [packed.filter(F.floor(F.col("block") / BLOCKS_AT_ONCE) == k) for k in range(passes)]


class _Block:
    """A block of queries in a task: ids, vectors, and the best k-th dots seen so far.

    Ids and vectors are copies: a view would hold the whole Arrow batch that the block came with."""

    def __init__(self, asked: pa.StructArray) -> None:
        self.ids = asked.field("qid").take(pa.array(np.arange(len(asked))))
        lists = asked.field("embedding")
        self.vectors = _matrix(lists, len(lists.flatten()) // len(lists)).copy()
        self.floor = _no_floor(len(asked))
        self.targets: dict[str, list[int]] = {}
        self.waiting: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        self.rows: dict[str, int] = {}
        self.floors: dict[str, np.ndarray] = {}
        if "paths" in asked.type.names:
            for k, paths in enumerate(asked.field("paths").to_pylist()):
                for path in paths:
                    self.targets.setdefault(path, []).append(k)


def _packed(vectors: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The vectors as (chunk, rows: order columns and embedding), each chunk sorted by `order`."""
    fields = [f"{c}: {vectors.schema[c].dataType.simpleString()}" for c in (*order, "embedding")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                piece = batch.slice(start, CHUNK_ROWS)
                piece = _in_order(piece, order) if order else piece
                rows = pa.StructArray.from_arrays(piece.columns, names=piece.schema.names)
                lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([pa.array([number]), lists], names=["chunk", "rows"])
                number += 1

    return vectors.select(*order, "embedding").mapInArrow(pack, f"chunk long, rows array<struct<{', '.join(fields)}>>")


def _slices(vectors: DataFrame) -> int:
    return SLICES if vectors.rdd.getNumPartitions() > SLICES else 1


#: What a task does with a chunk (rows, its matrix) and a block, and the columns of what it yields.
Score = Callable[[pa.StructArray, np.ndarray, _Block], Iterator[list[pa.Array]]]
Last = Callable[[_Block], Iterator[list[pa.Array]]]


def _met(vectors: DataFrame, queries: DataFrame, order: tuple[str, ...], schema: str, score: Score, extra: tuple[str, ...] = (), last: Last | None = None) -> DataFrame:
    """What `score` yields for every chunk of vectors with every block of queries, and `last` for every block at the end of
    a task."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        chunk, rows, matrix = None, None, None
        for batch in batches:
            for k, (own, number) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("block").to_pylist())):
                if own != chunk:
                    chunk, rows = own, batch.column("rows")[k].values
                    lists = rows.field("embedding")
                    matrix = _matrix(lists, len(lists.flatten()) // max(len(lists), 1))
                if number not in blocks:
                    blocks[number] = _Block(batch.column("asked")[k].values)
                for columns in score(rows, matrix, blocks[number]):
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays(columns, names=names)
        for block in blocks.values() if last else ():
            for columns in last(block):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    chunks = _packed(vectors, order)
    parts = [chunks.crossJoin(F.broadcast(blocks)).mapInArrow(scan, schema) for blocks in query_blocks(queries, extra)]
    return reduce(DataFrame.unionByName, parts)


def _in_order(batch: pa.RecordBatch, columns: tuple[str, ...]) -> pa.RecordBatch:
    """The chunk sorted by the tie-break, so that row position decides between equal dots."""
    order = pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in columns])
    return batch.take(order)


def _survivors(dots: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) entries that can still be in a top k, never more than k per query.

    `floor` holds the best k-th dot seen so far and is raised in place. Equal dots fall to the
    lower row, so a long run of copies cannot make the output grow.
    """
    keep = dots >= floor
    if dots.shape[0] > k:
        cut = np.partition(dots, dots.shape[0] - k, axis=0)[dots.shape[0] - k]
        keep &= dots >= cut
        np.maximum(floor, cut, out=floor)
        for col in np.flatnonzero(keep.sum(axis=0) > k):
            rows = np.flatnonzero(keep[:, col])
            extra = rows[np.argsort(-dots[rows, col], kind="stable")[k:]]
            keep[extra, col] = False
    return np.nonzero(keep)


def _no_floor(n: int) -> np.ndarray:
    return np.full(n, np.iinfo(np.int64).min)


def _qid_type(queries: DataFrame) -> str:
    return queries.schema["qid"].dataType.simpleString()


def passage_dense(vectors: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(qid, path, line_start, dot, rank): best passages by (-dot, path, line_start)."""

    def score(rows: pa.StructArray, matrix: np.ndarray, block: _Block) -> Iterator[list[pa.Array]]:
        dots = _multiply(matrix, block.vectors)
        row, col = _survivors(dots, depth, block.floor)
        yield _emit(rows, block, row, col, dots[row, col])

    schema = f"qid {_qid_type(queries)}, path string, line_start bigint, dot bigint"
    found = _met(vectors, queries, ("path", "line_start"), schema, score)
    order = [F.desc("dot"), F.asc("path"), F.asc("line_start")]
    return top_k(found, ["qid"], order, depth, slices=_slices(vectors))


def _emit(rows: pa.StructArray, block: _Block, row: np.ndarray, col: np.ndarray, dots: np.ndarray) -> list[pa.Array]:
    at = pa.array(row)
    return [block.ids.take(pa.array(col)), rows.field("path").take(at), rows.field("line_start").take(at).cast(pa.int64()), pa.array(dots, pa.int64())]


def file_dense(vectors: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(qid, path, dot, rank): each file by its best passage, by (-dot, path).

    Inside a chunk a file is reduced to its best passage. A file in the final top `depth` is also in
    the top `depth` of the chunk that holds its best passage, so cutting each chunk there is exact.
    """

    def score(rows: pa.StructArray, matrix: np.ndarray, block: _Block) -> Iterator[list[pa.Array]]:
        runs = pc.run_end_encode(rows.field("path"))
        ends = runs.run_ends.to_numpy(zero_copy_only=False)
        best = np.maximum.reduceat(_multiply(matrix, block.vectors), np.r_[0, ends[:-1]], axis=0)
        row, col = _survivors(best, depth, block.floor)
        yield [block.ids.take(pa.array(col)), runs.values.take(pa.array(row)), pa.array(best[row, col], pa.int64())]

    found = _met(vectors, queries, ("path",), f"qid {_qid_type(queries)}, path string, dot bigint", score)
    best = found.groupBy("qid", "path").agg(F.max("dot").alias("dot"))
    return top_k(best, ["qid"], [F.desc("dot"), F.asc("path")], depth, slices=_slices(vectors))


def top_similarity(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, top_dot): the best dot product over every passage."""

    def score(rows: pa.StructArray, matrix: np.ndarray, block: _Block) -> Iterator[list[pa.Array]]:
        best = _multiply(matrix, block.vectors).max(axis=0)
        better = np.flatnonzero(best > block.floor)
        block.floor[better] = best[better]
        yield [block.ids.take(pa.array(better)), pa.array(best[better], pa.int64())]

    found = _met(vectors, queries, (), f"qid {_qid_type(queries)}, top_dot bigint", score)
    return found.groupBy("qid").agg(F.max("top_dot").alias("top_dot"))


def within_files(
    vectors: DataFrame, queries: DataFrame, chosen: DataFrame, depth: int
) -> DataFrame:
    """(qid, path, line_start, dot, rank): best passages inside each question's chosen files.

    `chosen` holds (qid, path). Each task scores only the chosen pairs, some WAITING_ROWS vectors of a file at a time, and
    yields no more than `depth` of each pair for each time, so a chosen file that holds much of the corpus stays
    spread out.
    """
    lists = chosen.groupBy("qid").agg(F.collect_set("path").alias("paths"))
    asked = queries.select("qid", "embedding").join(lists, "qid")
    vectors = vectors.join(small_side(chosen.select("path").distinct()), "path", "left_semi")

    def settle(block: _Block, path: str) -> Iterator[list[pa.Array]]:
        lines, matrices = zip(*block.waiting.pop(path))
        del block.rows[path]
        lines, matrix = pa.concat_arrays(lines), np.concatenate(matrices)
        order = wide(pc.sort_indices(lines, null_placement="at_start"))  # of equal dots the first line counts
        cols = np.array(block.targets[path])
        dots = _multiply(matrix[order], block.vectors[cols])
        row, col = _survivors(dots, depth, block.floors.setdefault(path, _no_floor(len(cols))))
        found = lines.take(pa.array(order[row])).cast(pa.int64())
        yield [block.ids.take(pa.array(cols[col])), pa.array([path] * len(row), pa.string()), found, pa.array(dots[row, col], pa.int64())]

    def score(rows: pa.StructArray, matrix: np.ndarray, block: _Block) -> Iterator[list[pa.Array]]:
        runs = pc.run_end_encode(rows.field("path"))
        ends = [0, *runs.run_ends.to_pylist()]
        for lo, hi, path in zip(ends, ends[1:], runs.values.to_pylist()):
            if path in block.targets:
                line = rows.field("line_start").take(pa.array(np.arange(lo, hi)))
                block.waiting.setdefault(path, []).append((line, matrix[lo:hi].copy()))
                block.rows[path] = block.rows.get(path, 0) + hi - lo
                if block.rows[path] >= WAITING_ROWS:
                    yield from settle(block, path)
        if sum(block.rows.values()) >= MOST_WAITING:
            yield from last(block)

    def last(block: _Block) -> Iterator[list[pa.Array]]:
        for path in list(block.waiting):
            yield from settle(block, path)

    schema = f"qid {_qid_type(queries)}, path string, line_start bigint, dot bigint"
    found = _met(vectors, asked, ("path", "line_start"), schema, score, ("paths",), last)
    return top_k(found, ["qid", "path"], [F.desc("dot"), F.asc("line_start")], depth, slices=_slices(vectors))
