"""From texts to stored postings: bags are counted where the texts lie and travel once, packed.

A task counts the stems of some million words at a time, sorts them by part (a group of buckets and a slice of the
bags) and term, and sends a compressed piece for each part. A part's pieces meet in one task, which merges them and
writes its rows, sorted by bucket, term and bag. No posting is a row before that, and none is sorted or spilled by Spark.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gleanery.functions.arrays import crc, narrow, packed, slices_of, unpacked, wide
from gleanery.functions.porter import Vocabulary
from gleanery.functions.tokens import Alphabet, folding
from gleanery.plans.postings import FILE_ROWS, buckets_for

#: Words that are counted and sorted together, characters that are tokenised at once, and words a task remembers.
CHUNK_WORDS, CHUNK_CHARS, WORDS_KEPT = 1_000_000, 2_000_000, 200_000
#: Groups of buckets that travel together: a bag's name goes to each. The number of buckets is a multiple of it.
GROUPS = 4
#: Bytes of text for each posting, about; only the number of buckets and slices hangs on it.
POSTING_BYTES = 8
BATCH_ROWS = 65_536
FILE = "file"
#: Tasks for each part.
TASKS_A_PART = 1
WRITERS, CLEANUP = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_known: list[Vocabulary] = []


def known() -> Vocabulary:
    """The worker's vocabulary, which outlives a task; a new one where it has grown too large."""
    from gleanery.plans import bags as here  # the worker's own module

    if not here._known or len(here._known[0]) > WORDS_KEPT:
        here._known[:] = [Vocabulary()]
    return here._known[0]


class _Unit:
    """What a task has counted of a unit's bags since its last pieces. The texts of a path are one bag of unit `file`."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.clear()

    def clear(self) -> None:
        self.paths: list[pa.Array] = []
        self.lines: list[pa.Array] = []
        self.rows: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.n = 0

    def add(self, batch: pa.RecordBatch, owner: np.ndarray, numbers: np.ndarray) -> None:
        self.paths.append(batch.column("path"))
        if self.name != FILE:
            self.lines.append(batch.column("line_start"))
        self.rows.append(owner + self.n)
        self.numbers.append(numbers)
        self.n += batch.num_rows

    def pieces(self, stems: list[str], groups: int, slices: int) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from _pieces(self.name, stems, self.paths, self.lines, self.rows, self.numbers, groups, slices)
        self.clear()


def _some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of CHUNK_CHARS about, or of one row."""
    size = sum(pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "body", "extra"))
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_CHARS, prepend=0))
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _counted(batches: Iterator[pa.RecordBatch], alphabet: Alphabet, groups: int, slices: int, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(unit, part, piece) of the bags of some texts, of the units named."""
    vocabulary, units, n_words = known(), [_Unit(name) for name in names], 0
    for batch in (some for whole in batches for some in _some(whole)):
        texts = [t or "" for row in zip(*(batch.column(c).to_pylist() for c in ("first", "body", "extra"))) for t in row]
        words, counts = alphabet.words(texts)
        numbers = vocabulary.numbers(words)
        text = np.repeat(np.arange(len(texts)), counts)[numbers >= 0]
        numbers, owner, kind = numbers[numbers >= 0], text // 3, text % 3
        for unit in units:
            if unit.name == FILE:
                unit.add(batch, owner[kind < 2], numbers[kind < 2])
            else:
                there = batch.column("extra").is_valid().to_numpy(zero_copy_only=False)
                mine = (kind > 0) & there[owner]
                unit.add(batch.filter(pa.array(there)), (np.cumsum(there) - 1)[owner[mine]], numbers[mine])
        n_words += len(numbers)
        if n_words >= CHUNK_WORDS:
            for unit in units:
                yield from unit.pieces(vocabulary.stems, groups, slices)
            vocabulary, n_words = known(), 0
    for unit in units:
        yield from unit.pieces(vocabulary.stems, groups, slices)


def _pieces(
    unit: str, stems: list[str], paths: list[pa.Array], lines: list[pa.Array], rows: list[np.ndarray], numbers: list[np.ndarray],
    groups: int, slices: int,
) -> Iterator[pa.RecordBatch]:
    path, line, row, number = pa.concat_arrays(paths), pa.concat_arrays(lines) if lines else None, np.concatenate(rows), np.concatenate(numbers)
    if line is None:  # the texts of a path are one bag
        encoded = path.dictionary_encode()
        path, row = encoded.dictionary, wide(encoded.indices)[row]
    n_docs = len(path)
    lengths = np.bincount(row, minlength=n_docs)
    own = slices_of(path, line, slices)
    used, number = np.unique(number, return_inverse=True)
    terms = [stems[k] for k in used]
    order = sorted(range(len(terms)), key=terms.__getitem__)
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    group = np.array([crc(t) for t in terms], np.int64) % groups
    # one number for each word: its part, term and bag; equal ones are a posting
    key = ((group[number] * slices + own[row]) * max(len(terms), 1) + rank[number]) * n_docs + row
    key, tf = np.unique(key, return_counts=True)
    key, doc = key // n_docs, key % n_docs
    part, term = key // max(len(terms), 1), key % max(len(terms), 1)
    strings = pa.array(terms, pa.string()).take(pa.array(np.array(order, np.int64)))
    parts, blobs = [], []
    ends = np.searchsorted(part, np.arange(groups * slices + 1))
    for s in range(slices):
        mine = np.flatnonzero(own == s)
        if not len(mine):
            continue
        place = np.zeros(n_docs, np.int64)
        place[mine] = np.arange(len(mine))
        docs = {"path": path.take(pa.array(mine)), "dl": narrow(lengths[mine])}
        if line is not None:
            docs["line"] = line.take(pa.array(mine))
        for p in range(s, groups * slices, slices):
            lo, hi = ends[p], ends[p + 1]
            if lo == hi and line is not None:
                continue  # of a whole file every part needs the length
            at = np.flatnonzero(np.diff(term[lo:hi], prepend=-1))
            gaps = np.diff(place[doc[lo:hi]], prepend=0)
            gaps[at] = place[doc[lo:hi]][at]
            parts.append(p)
            blobs.append(packed(
                **docs, term=strings.take(pa.array(term[lo:hi][at])), n=narrow(np.diff(np.append(at, hi - lo))),
                gap=narrow(gaps), tf=narrow(tf[lo:hi]),
            ))
    if parts:
        columns = [pa.array([unit] * len(parts)), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["unit", "part", "piece"])


def _places(gaps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums of `gaps` that start anew after every `n` of them."""
    total = np.cumsum(gaps)
    starts = np.cumsum(n) - n
    return total - np.repeat(total[starts] - gaps[starts], n) if len(gaps) else total


def _merged(blobs: list[bytes], group: int, groups: int, buckets: int, alphabet: Alphabet, name_weight: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a part, sorted by bucket, term and bag. With `name_weight` the bags of a path are summed, with the
    words of its name that often on top."""
    pieces = [unpacked(b) for b in blobs]
    sizes = np.array([len(p["path"]) for p in pieces])
    path, dl = pa.concat_arrays([p["path"] for p in pieces]), np.concatenate([wide(p["dl"]) for p in pieces])
    n = np.concatenate([wide(p["n"]) for p in pieces])
    doc = np.concatenate([_places(wide(p["gap"]), wide(p["n"])) for p in pieces])
    doc += np.repeat(np.cumsum(sizes) - sizes, [len(p["gap"]) for p in pieces])
    tf = np.concatenate([wide(p["tf"]) for p in pieces])
    line = pa.concat_arrays([p["line"] for p in pieces]) if name_weight is None else None
    words = pa.concat_arrays([p["term"] for p in pieces])
    if name_weight is not None:
        encoded = path.dictionary_encode()
        path, codes = encoded.dictionary, wide(encoded.indices)
        dl, doc = np.bincount(codes, dl, len(path)).astype(np.int64), codes[doc]
        found, counts = alphabet.words([re.sub(r"\.[^./]*$", "", p) for p in path.to_pylist()])
        vocabulary = Vocabulary()  # of the names alone
        numbers = vocabulary.numbers(found)
        owner = np.repeat(np.arange(len(path)), counts)[numbers >= 0]
        numbers = numbers[numbers >= 0]
        dl += name_weight * np.bincount(owner, minlength=len(path))
        here = (np.array([crc(t) for t in vocabulary.stems], np.int64) % groups == group)[numbers] if len(numbers) else numbers
        owner, numbers = owner[here.astype(bool)], numbers[here.astype(bool)]
        words = pa.concat_arrays([words, pa.array([vocabulary.stems[k] for k in numbers], pa.string())])
        n, doc = np.append(n, np.ones(len(numbers), np.int64)), np.append(doc, owner)
        tf = np.append(tf, np.full(len(numbers), name_weight))
    del pieces
    words = words.dictionary_encode()
    terms = words.dictionary.to_pylist()
    bucket = np.array([crc(t) for t in terms], np.int64) % buckets
    order = sorted(range(len(terms)), key=lambda k: (bucket[k], terms[k]))
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    keys = pa.table({"path": path} if line is None else {"path": path, "line": line})
    docs = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names])
    place = np.empty(len(path), np.int64)
    place[wide(docs)] = np.arange(len(path))
    key = np.repeat(rank[wide(words.indices)], n) * max(len(path), 1) + place[doc]
    at = np.argsort(key)
    key, tf = key[at], tf[at]
    if line is None and len(key):
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, tf = key[first], np.add.reduceat(tf, first)
    path, dl = path.take(docs), dl[wide(docs)]
    line = None if line is None else line.take(docs)
    strings, bucket = words.dictionary.take(pa.array(np.array(order, np.int64))), bucket[order]
    for lo in range(0, len(key), BATCH_ROWS):
        term, doc = np.divmod(key[lo : lo + BATCH_ROWS], len(path))
        columns = {"path": path.take(pa.array(doc))}
        if line is not None:
            columns["line_start"] = line.take(pa.array(doc))
        columns |= {
            "dl": pa.array(dl[doc], pa.int64()), "term": strings.take(pa.array(term)),
            "tf": pa.array(tf[lo : lo + BATCH_ROWS], pa.int64()), "bucket": pa.array(bucket[term], pa.int32()),
        }
        yield pa.RecordBatch.from_pydict(columns)


#: What a table of postings has, whatever the unit; `line_start` is null for a file.
ROWS = "unit string, path string, line_start bigint, dl bigint, term string, tf bigint, bucket int"


def write_bags(texts: DataFrame, text_bytes: int, path: str, units: Sequence[str], name_weight: int, file_rows: int = FILE_ROWS) -> int:
    """Write the postings of `texts` (`lexical.bag_texts`), as `write_postings` lays them out, below a directory for each
    unit: one for each bucket of terms, files of `file_rows` about, sorted by term. Returns the number of buckets.

    A path is one bag of the unit `file`: its texts, and the words of its name `name_weight` times. Two units are
    counted in one pass over the texts and written together, so that their pieces lie on the disks once.
    """
    spark = texts.sparkSession
    alphabet = folding(spark)
    postings = max(text_bytes // POSTING_BYTES, 1)
    buckets, groups = buckets_for(postings), GROUPS
    slices = max(-(-postings // (groups * file_rows)), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, alphabet, groups, slices, units)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[bytes]] = defaultdict(list)
        for batch in batches:
            for unit, part, piece in zip(*(batch.column(c).to_pylist() for c in ("unit", "part", "piece"))):
                held[unit, part].append(piece)
        for unit, part in sorted(held):
            for rows in _merged(held.pop((unit, part)), part // slices, groups, buckets, alphabet, name_weight if unit == FILE else None):
                lines = rows.column("line_start") if unit != FILE else pa.nulls(rows.num_rows, pa.int64())
                columns = [pa.array([unit]).take(pa.array(np.zeros(rows.num_rows, np.int64))), rows.column("path"), lines]
                yield pa.RecordBatch.from_arrays(
                    columns + [rows.column(c) for c in ("dl", "term", "tf", "bucket")], names=[f.split(" ")[0] for f in ROWS.split(", ")]
                )
            pa.default_memory_pool().release_unused()

    pieces = texts.mapInArrow(count, "unit string, part int, piece binary")
    rows = pieces.repartition(TASKS_A_PART * len(units) * groups * slices, "unit", "part").mapInArrow(merge, ROWS)
    with _settings(spark, {WRITERS: "64", CLEANUP: "true"}):
        out = rows.write.mode("append").option("compression", "zstd").option("parquet.dictionary.page.size", 4 << 20)
        out.partitionBy("unit", "bucket").parquet(path)
    return buckets


class _settings:
    """Rows of a task come sorted by bucket: they need no sort of Spark's, as long as few files are open at once. The
    pieces are of no use once the rows are written."""

    def __init__(self, spark: SparkSession, values: dict[str, str]) -> None:
        self.conf, self.values = spark.conf, values

    def __enter__(self) -> None:
        self.before = {name: self.conf.get(name, None) for name in self.values}
        for name, value in self.values.items():
            self.conf.set(name, value)

    def __exit__(self, *_: object) -> None:
        for name, value in self.before.items():
            self.conf.set(name, value) if value is not None else self.conf.unset(name)
