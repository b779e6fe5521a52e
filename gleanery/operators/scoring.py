"""BM25 of a batch of questions as products of arrays: only what can be among a group's best leaves a task.

The matching postings go to the task of their bag in compressed pieces. There a block of bags is scored for all
questions at once, and of each group (a question, or a question and a chosen file) the best so far are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.arrays import narrow, packed, slices_of, unpacked, wide
from gleanery.operators.dense import _survivors
from gleanery.params import RankParams
from gleanery.session import MAX_BROADCAST_BYTES, small_side

#: Rows of weights and of chosen files that are sent to every task; above that they are joined.
MOST_WEIGHTS = 500_000
#: Postings that a task packs together, scores of a block, and pairs of question and bag for a task.
PACK_ROWS, BLOCK_SCORES, PAIRS_A_TASK = 500_000, 400_000, 4_000_000
LEAST = 5e-10  # scores are rounded to nine decimals, and those of 0 don't count


class Asked:
    """The weighted terms of a batch: rows of (term, question, idf) ordered by term, and who chose which file."""

    def __init__(self, weights: pa.Table, chosen: pa.Table | None) -> None:
        terms = weights["term"].combine_chunks().dictionary_encode()
        qids = weights["qid"].combine_chunks().dictionary_encode("encode")
        code, asker = wide(terms.indices), wide(qids.indices)
        order = np.argsort(code, kind="stable")
        self.terms, self.qids = terms.dictionary, qids.dictionary
        self.asker, self.idf = asker[order], weights["idf"].to_numpy()[order]
        self.n = np.bincount(code, minlength=len(self.terms))
        self.start = np.cumsum(self.n) - self.n
        self.files: dict[str, np.ndarray] | None = None
        if chosen is not None:
            at = pc.index_in(chosen["qid"].combine_chunks(), value_set=self.qids)
            files = defaultdict(set)
            for path, k in zip(chosen["path"].to_pylist(), at.to_pylist()):
                if k is not None and path is not None:
                    files[path].add(k)
            self.files = {path: np.array(sorted(ks)) for path, ks in files.items()}


def asked(weights: DataFrame, chosen: DataFrame | None) -> Asked | None:
    """What every task needs to know of the batch; None if that is much. `weights` and `chosen` are read twice."""
    for df in (weights, chosen):
        if df is not None and small_side(df, MOST_WEIGHTS, MAX_BROADCAST_BYTES // 4) is df:
            return None
    tables = [None if df is None else df.toArrow() for df in (weights.select("qid", "term", "idf"), chosen and chosen.select("qid", "path"))]
    return Asked(*tables) if tables[0].num_rows else None


def best(
    postings: DataFrame, weights: DataFrame, batch: Asked, avgdl: float, keys: Sequence[str], params: RankParams, depth: int,
    chosen: DataFrame | None, bags: int,
) -> DataFrame:
    """(qid, keys, score) with the first `depth` of each question, or of each question and chosen file, among them."""
    on = [c for c in ("bucket", "term") if c in postings.columns and c in weights.columns]
    lined = "line_start" in keys
    if chosen is not None:
        postings = postings.join(small_side(chosen.select("path").distinct()), "path", "left_semi")
    postings = postings.join(small_side(weights).filter(F.col("idf") > 0), on, "left_semi")
    tasks = max(-(-bags * len(batch.qids) // PAIRS_A_TASK), postings.sparkSession.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK_ROWS:
                yield from _dealt(held, batch, tasks)
                held, n = [], 0
        if n:
            yield from _dealt(held, batch, tasks)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = defaultdict(list)
        for b in batches:
            for part, piece in zip(b.column("part").to_pylist(), b.column("piece").to_pylist()):
                held[part].append(piece)
        for part in sorted(held):
            yield from _scored(held.pop(part), batch, avgdl, params, depth)
            pa.default_memory_pool().release_unused()

    qid = weights.schema["qid"].dataType.simpleString()
    packs = postings.select(*keys, "dl", "term", "tf").mapInArrow(pack, "part int, piece binary")
    found = packs.repartition(tasks, "part").mapInArrow(score, f"qid {qid}, path string, {'line_start bigint, ' if lined else ''}score double")
    return found


def _dealt(batches: list[pa.RecordBatch], batch: Asked, tasks: int) -> Iterator[pa.RecordBatch]:
    """(part, piece) of some postings, by bag."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: rows[name].combine_chunks() if rows[name].num_chunks != 1 else rows[name].chunk(0)
    paths = column("path").dictionary_encode()
    path, dl, tf = wide(paths.indices), wide(column("dl")), wide(column("tf"))
    term = wide(pc.index_in(column("term"), value_set=batch.terms))
    lined = "line_start" in rows.column_names
    known = np.ones(len(path), bool)
    if lined:
        line, known = wide(column("line_start").fill_null(0)), column("line_start").is_valid().to_numpy(zero_copy_only=False)
    else:
        line = np.zeros(len(path), np.int64)
    order = np.lexsort((term, dl, ~known, line, path))
    path, line, dl, tf, term, known = path[order], line[order], dl[order], tf[order], term[order], known[order]
    new = np.r_[True, (path[1:] != path[:-1]) | (line[1:] != line[:-1]) | (dl[1:] != dl[:-1]) | (known[1:] != known[:-1])]
    first = np.flatnonzero(new)
    bag = np.cumsum(new) - 1
    owners = pa.array(line[first], mask=~known[first]) if lined else None
    names = paths.dictionary.take(pa.array(path[first]))
    part = slices_of(names, owners, tasks)
    order = np.argsort(part[bag], kind="stable")
    ends = np.searchsorted(part[bag][order], np.arange(tasks + 1))
    parts, blobs = [], []
    for p in np.flatnonzero(np.diff(ends)):
        mine = order[ends[p] : ends[p + 1]]
        bags, n = np.unique(bag[mine], return_counts=True)
        extra = {"line": owners.take(pa.array(bags))} if lined else {}
        blobs.append(packed(path=names.take(pa.array(bags)), dl=narrow(dl[first][bags]), n=narrow(n), term=narrow(term[mine]), tf=narrow(tf[mine]), **extra))
        parts.append(int(p))
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "piece"])


def _scored(blobs: list[bytes], batch: Asked, avgdl: float, params: RankParams, depth: int) -> Iterator[pa.RecordBatch]:
    """The best of each group among the bags of a part. Rows of one key are one bag, each with a length of its own."""
    pieces = [unpacked(b) for b in blobs]
    names = pa.concat_arrays([p["path"] for p in pieces]).dictionary_encode()
    lined = "line" in pieces[0]
    n = np.concatenate([wide(p["n"]) for p in pieces])
    dl = np.repeat(np.concatenate([wide(p["dl"]) for p in pieces]), n).astype(float)
    term = np.concatenate([wide(p["term"]) for p in pieces])
    tf = np.concatenate([wide(p["tf"]) for p in pieces]).astype(float)
    lines = pa.concat_arrays([p["line"] for p in pieces]) if lined else pa.nulls(len(names), pa.int64())
    del pieces
    rank = np.empty(len(names.dictionary), np.int64)
    by_name = wide(pc.sort_indices(names.dictionary))
    rank[by_name] = np.arange(len(rank))
    path, line, known = rank[wide(names.indices)], wide(lines.fill_null(0)), lines.is_valid().to_numpy(zero_copy_only=False)
    order = np.lexsort((line, known, path))  # nulls first
    path, line, known = path[order], line[order], known[order]
    new = np.r_[True, (path[1:] != path[:-1]) | (line[1:] != line[:-1]) | (known[1:] != known[:-1])]
    bag = np.empty(len(order), np.int64)
    bag[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    path, line = path[first], pa.array(line[first], mask=~known[first])
    bag = np.repeat(bag, n)
    order = np.argsort(bag, kind="stable")
    bag, term, tf, dl = bag[order], term[order], tf[order], dl[order]
    part = tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl / avgdl))
    paths = names.dictionary.take(pa.array(by_name))
    askers = len(batch.qids)
    step = max(1, BLOCK_SCORES // askers)
    floors: dict[int, np.ndarray] = {}
    for lo in range(0, len(path), step):
        hi = min(lo + step, len(path))
        a, b = np.searchsorted(bag, [lo, hi])
        times = batch.n[term[a:b]]
        at = np.repeat(np.arange(a, b), times)
        weight = np.repeat(batch.start[term[a:b]] - (np.cumsum(times) - times), times) + np.arange(len(at))
        cell = (bag[at] - lo) * askers + batch.asker[weight]
        scores = np.bincount(cell, part[at] * batch.idf[weight], (hi - lo) * askers).reshape(hi - lo, askers)
        scores = np.round(scores, 9)
        if batch.files is None:
            groups = [(0, 0, hi - lo, None)]
        else:
            cuts = [0, *(np.flatnonzero(np.diff(path[lo:hi])) + 1).tolist(), hi - lo]
            groups = [(int(path[lo + x]), x, y, batch.files.get(paths[int(path[lo + x])].as_py())) for x, y in zip(cuts, cuts[1:])]
        rows, cols, values = [], [], []
        for group, x, y, mine in groups:
            if batch.files is not None and mine is None:
                continue
            own = scores[x:y] if mine is None else scores[x:y, mine]
            row, col = _survivors(own, depth, floors.setdefault(group, np.full(own.shape[1], LEAST)))
            values.append(own[row, col])
            rows.append(row + x + lo)
            cols.append(col if mine is None else mine[col])
        if not rows:
            continue
        row, col = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        out = {"qid": batch.qids.take(col), "path": paths.take(pa.array(path).take(row))}
        if lined:
            out["line_start"] = line.take(row)
        yield pa.RecordBatch.from_pydict(out | {"score": pa.array(np.concatenate(values))})
