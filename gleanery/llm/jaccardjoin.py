"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row for each different text (by its set of shingles) and a column for each shingle.
Its product with its own transpose holds the overlap of each pair. Columns are dealt into blocks by
hash; each block is multiplied on its own and its overlap counts are summed over blocks.

Bounds from the sizes keep the product small and exact. A pair links only if its overlap is at least
ceil(t (m + n) / (1 + t)), so the sizes differ by at most the factor t, and the pair shares an entry
among the first n - ceil(t n) + 1 columns of each row under any common order of columns: only those
entries are multiplied. The order puts frequent shingles (counted over all documents) last. A pair whose
count cannot reach its bound even if everything not counted agreed is discarded. So is a pair whose parity
sketches (a bit for each hash range, flipped by each entry) differ in more bits than the sizes allow entries
to differ: each differing bit needs an entry that only one row has. What is left is compared shingle by
shingle.

Frequent columns that still lead a row (texts that consist of frequent shingles: large groups of near
copies) are never multiplied out. Each such row is compared with a pivot of its column; rows that come
out in one component need no further comparison. The rest are compared with the likeliest row of each
other component, and only what is then still apart with all rows of other components, so a large group
costs a few comparisons a row and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.session import attach, give_back, tidy
from gleanery.llm.textnum import U, mix, signed, word_sets
from gleanery.session import materialise, small_side

#: A column with more rows than this is frequent.
FREQUENT = 64
#: The list of frequent shingles that is sent to all executors has at most so many entries (8 bytes each):
#: beyond it the threshold rises, and columns missing from it are found in their block.
LISTED = 4_000_000
#: Entries of the matrix in a block, about.
BLOCK_ENTRIES = 500_000
#: Entries that a task holds before it sends them to their blocks.
HELD = 600_000
#: Different texts a task remembers, to send copies once; more only costs time.
REMEMBERED = 500_000
#: Pairs counted at once in a block.
PAIRS_AT_ONCE = 250_000
#: What goes with the entries of a text: its signature, its entries, how many leading ones no block has, and
#: the upper half of the last leading one.
ABOUT = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("n", "<u4"), ("k", "<u4"), ("last", "<u4")])
#: Rows of a frequent column that are compared at once on either side.
COMPARED = 512
#: Frequent shingles are told apart by so many leading bits.
SHORT = U(16)


def least_overlap(a, b, num: int, den: int):
    """The smallest overlap with den * overlap >= num * (a + b - overlap)."""
    return -((-num * (a + b)) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """Leading entries of which a linked text shares one."""
    return n - -((-num * n) // den) + 1


def _planes(x: np.ndarray) -> bytes:
    """Sorted values as differences, all lowest bytes first: many zero bytes, which shuffles compress."""
    return np.diff(x.astype(U), prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    wide = np.frombuffer(raw, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(wide).view(U).ravel(), dtype=U)


def _bytes_of(x: np.ndarray) -> bytes:
    """Small numbers, byte by byte for compression."""
    return np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _small(raw: bytes) -> np.ndarray:
    wide = np.frombuffer(raw, np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(wide).view(np.uint32).ravel()


def _signature(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one = np.bitwise_xor.reduce(mix(found ^ U(0x5851F42D4C957F2D)))
    return int(found.sum(dtype=U)), int(one)


def _sets(batches, size: int):
    """(id, set, signature) of each text with words, the first time this task sees the set."""
    seen: set = set()
    for batch in batches:
        for row, found in word_sets(batch.column("text"), size):
            if not len(found):
                continue
            key = _signature(found)
            if key in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            yield row, found, key


def _sketch(found: np.ndarray) -> bytes:
    """Parity of the entries in each hash range; twice as many ranges as entries, a power of two, 64 at least."""
    ranges = max(64, 1 << (2 * len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & U(ranges - 1), minlength=ranges) & 1 == 1).tobytes()


def _differing(one: bytes, two: bytes) -> int:
    """Entries that at least differ between two sets. Halves of a longer sketch are folded onto each other."""
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def plausible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ...) whose sketches do not rule a link out."""
    for x in ("a", "b"):
        own = classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        pairs = pairs.join(own, x)
    names = [c for c in pairs.columns if c not in ("n_a", "n_b", "sketch_a", "sketch_b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")]
            keep = [_differing(x, y) <= m + n - 2 * least_overlap(m, n, num, den) for m, n, x, y in zip(*sides)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, s1, s2, sketch): size, signature and sketch of each row's shingle set; 0 for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            keys = np.zeros((2, len(batch)), U)
            sketches = [b""] * len(batch)
            for row, found in word_sets(batch.column("text"), size):
                if len(found):
                    n[row] = len(found)
                    keys[:, row] = _signature(found)
                    sketches[row] = _sketch(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *(pa.array(signed(k)) for k in keys), pa.array(sketches, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n long, s1 long, s2 long, sketch binary")


def frequent(docs: DataFrame, size: int, entries: int) -> np.ndarray:
    """The sorted leading bits of shingles that more than FREQUENT different texts have.

    Counts cover all texts. Tasks count what they hold, packed by range of hashes, and ranges add up.
    """
    bits = max(4, math.ceil(math.log2(max(1, entries / BLOCK_ENTRIES))))
    threshold = max(FREQUENT, entries // LISTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, found, _ in _sets(batches, size):
            held.append(found >> SHORT)
            n += len(found)
            if n >= HELD:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)
        held.clear()
        give_back()

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        value, times = np.unique(np.concatenate(held), return_counts=True)
        block = (value >> U(48 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = [*cuts[1:], len(block)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block[cuts]),
                pa.array([_planes(value[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                pa.array([_bytes_of(times[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
            ],
            names=["block", "value", "times"],
        )

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = [], []
        for batch in batches:
            values += [_from_planes(x.as_py()) for x in batch.column("value")]
            times += [_small(x.as_py()) for x in batch.column("times")]
        value, times = np.concatenate(values), np.concatenate(times).astype(np.int64)
        order = np.argsort(value, kind="stable")
        value, times = value[order], times[order]
        cuts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        total = np.add.reduceat(times, cuts)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(signed(value[cuts][total > threshold]))], names=["value"])

    packs = docs.mapInArrow(tidy(count), "block long, value binary, times binary")
    found = packs.groupBy("block").applyInArrow(added, "value long").toPandas()["value"].to_numpy()
    return np.sort(found.astype(U))


PAIR = "kind int, h long, a1 long, a2 long, an int, ap int, ak int, b1 long, b2 long, bn int, bp int, bk int, c int, r int"


def overlaps(docs: DataFrame, size: int, num: int, den: int, entries: int, listed) -> DataFrame:
    """Counts of shared leading entries by block (kind 0), and leading entries in frequent columns (kind 1).

    n, p, k: a row's entries, its leading entries, and those of them that no block multiplies. r: common
    entries that may be behind the leading ones of either row, at most.
    """
    bits = max(4, math.ceil(math.log2(max(1, entries * (1 - num / den) / BLOCK_ENTRIES))))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = listed.value
        held, rows, n = [], [], 0
        for _, found, (s1, s2) in _sets(batches, size):
            p = prefix_length(len(found), num, den)
            if len(often):
                at = np.minimum(np.searchsorted(often, found >> SHORT), len(often) - 1)
                hot = often[at] == found >> SHORT
                rare = found[~hot][:p].copy()  # not a view that keeps the whole set
                more = found[hot][: p - len(rare)].copy()
            else:
                rare, more = found[:p].copy(), found[:0]
            rows.append((s1, s2, len(found), len(more), int((more if len(more) else rare)[-1]) >> 32))
            held.append((rare, more))
            n += p
            if n >= HELD:
                yield dealt(rows, held)
                held, rows, n = [], [], 0
        if held:
            yield dealt(rows, held)
        held.clear()
        give_back()

    def dealt(rows, held) -> pa.RecordBatch:
        about = np.array(rows, ABOUT)
        out: dict[str, list] = {"block": [], "about": [], "value": [], "row": []}

        def add(block: int, value: np.ndarray, row: np.ndarray) -> None:
            used, row = np.unique(row, return_inverse=True)
            out["block"].append(block)
            out["about"].append(about[used].tobytes())
            out["value"].append(_planes(value))
            out["row"].append(_bytes_of(row))

        for part in (0, 1):
            value = np.concatenate([x[part] for x in held])
            if not len(value):
                continue
            row = np.repeat(np.arange(len(held)), [len(x[part]) for x in held])
            # leading entries are a row's smallest: mixed anew, they fill all blocks alike
            block = np.zeros(len(value), np.int64) if part else (mix(value) >> U(64 - bits)).astype(np.int64)
            order = np.lexsort((value, block))
            value, row, block = value[order], row[order], block[order]
            if part:
                add(-1, value, row)
                continue
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                add(int(block[a]), value[a:b], row[a:b])
        cols = [pa.array(out["block"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("about", "value", "row"))]
        return pa.RecordBatch.from_arrays(cols, names=list(out))

    packs = materialise(docs.mapInArrow(tidy(leading), "block long, about binary, value binary, row binary"), "entries")
    blocks = packs.filter("block >= 0").groupBy("block").applyInArrow(_multiply(num, den), PAIR)
    often = packs.filter("block < 0").mapInArrow(tidy(_frequent_rows(num, den)), PAIR)
    return blocks.union(often)


def _unpack(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(about, value, row) of packed entries; each different text has one row."""
    abouts, values, rows, base = [], [], [], 0
    for batch in batches:
        for about, value, row in zip(batch.column("about"), batch.column("value"), batch.column("row")):
            abouts.append(np.frombuffer(about.as_py(), ABOUT))
            values.append(_from_planes(value.as_py()))
            rows.append(_small(row.as_py()) + np.uint32(base))
            base += len(abouts[-1])
    about = np.concatenate(abouts)
    order = np.lexsort((about["s2"], about["s1"]))
    one, two = about["s1"][order], about["s2"][order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    number = np.empty(len(order), np.uint32)
    number[order] = np.cumsum(fresh) - 1
    about, row = about[order[fresh]], number[np.concatenate(rows)]
    rows.clear()
    value = np.concatenate(values)
    values.clear()
    order = np.lexsort((row, value))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return about, value[keep], row[keep].astype(np.int64)


def _rows(kind: int, h: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, share) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(h), kind, np.int32)), pa.array(signed(h))]
    for side in (a, b):
        n = side["n"].astype(np.int64)
        cols += [pa.array(signed(side[k])) for k in ("s1", "s2")]
        cols += [pa.array(x.astype(np.int32)) for x in (n, prefix_length(n, *share), side["k"])]
    # in the common order (frequent columns last) what is not counted is behind the leading entries that end first
    ends = [(side["k"] > 0).astype(np.int64) << 32 | side["last"].astype(np.int64) for side in (a, b)]
    rest = [side["n"] - prefix_length(side["n"].astype(np.int64), *share) for side in (a, b)]
    rest = np.where(ends[0] < ends[1], rest[0], np.where(ends[0] > ends[1], rest[1], np.maximum(*rest)))
    names = [x.split(" ")[0] for x in PAIR.split(", ")]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(x.astype(np.int32)) for x in (c, rest))], names=names)


def _frequent_rows(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                about, value, row = _unpack([batch.slice(k, 1)])
                yield _rows(1, value, about[row], about[row], np.ones(len(row)), (num, den))

    return run


def _multiply(num: int, den: int):
    """The product of one block of columns with its transpose, above the bound on sizes."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, value, row = _unpack(batches)
        sizes = about["n"].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        length = np.diff([*start, len(value)])
        for m in np.flatnonzero(np.bincount(length)[FREQUENT + 1 :]) + FREQUENT + 1:
            at = (start[length == m][:, None] + np.arange(m)).ravel()
            yield _rows(1, value[at], about[row[at]], about[row[at]], np.ones(len(at)), (num, den))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, n = [], 0

        def merged():
            key, c = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(sum(map(len, held)), np.int64)])
            return key, np.bincount(c, weight, len(key)).astype(np.int64)

        for m in range(2, FREQUENT + 1):
            first = start[length == m]
            one, two = np.triu_indices(m, 1)
            step = max(1, PAIRS_AT_ONCE // len(one))
            for s in range(0, len(first), step):
                group = row[first[s : s + step, None] + np.arange(m)]
                a, b = group[:, one].ravel(), group[:, two].ravel()
                near = den * np.minimum(sizes[a], sizes[b]) >= num * np.maximum(sizes[a], sizes[b])
                held.append(a[near] * len(about) + b[near])
                n += len(held[-1])
                if n >= PAIRS_AT_ONCE:
                    keys, counts = merged()
                    held, n = [], 0
        keys, counts = merged()
        del value, row, held
        give_back()
        for s in range(0, len(keys), 20_000):
            part = keys[s : s + 20_000]
            a, b = part // len(about), part % len(about)
            yield _rows(0, np.zeros(len(part), U), about[a], about[b], counts[s : s + 20_000], (num, den))

    return run


def verified(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of document ids whose whole shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.join(small_side(ids), "doc_id", "left_semi")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                keep = []
                sides = zip(word_sets(part.column("text"), size), word_sets(part.column("other"), size))
                for (_, x), (_, y) in sides:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(tidy(run), "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) for each row of `docs`.

    Two texts link when den * intersection >= num * union of their sets of `size`-word shingles; texts
    without words link with nothing. component_id is the smallest id reachable. Ids are longs. Rows that
    share an id are one node, linked where any of their texts is. A row with a null id takes part in no
    link of its own and gets the component of the other rows with its text, else null.
    """
    spark = attach(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = materialise(profiles(docs, size), "profiles")
    classes = known.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    sketches = known.select(F.col("doc_id").alias("rep"), "s1", "s2", "sketch").dropDuplicates(["rep", "s1", "s2"])
    classes = materialise(classes.join(sketches, ["rep", "s1", "s2"], "left"), "classes")
    entries = classes.agg(F.sum("n")).first()[0] or 0
    listed = spark.sparkContext.broadcast(frequent(docs, size, entries))
    found = materialise(overlaps(docs, size, num, den, entries, listed), "overlaps")
    # A frequent column missing from the list is counted in no block: allow for it in the bound.
    slack = (
        found.filter("kind = 1").select("a1", "a2", "h", "ak").distinct()
        .groupBy("a1", "a2").agg((F.count(F.lit(1)) - F.max("ak")).alias("extra"))
        .agg(F.max("extra")).first()[0] or 0
    )
    bound = F.ceil((F.col("an") + F.col("bn")) * num / (num + den))
    pairs = (
        found.filter("kind = 0")
        .groupBy("a1", "a2", "b1", "b2")
        .agg(F.sum("c").alias("c"), *(F.first(x).alias(x) for x in ("an", "ak", "bn", "bk", "r")))
        .filter(F.col("c") + F.least("ak", "bk") + F.lit(max(0, slack)) + F.col("r") >= bound)
    )
    side = lambda x: classes.select(F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("rep").alias(x))
    pairs = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).select("a", "b", "c")
    pairs = materialise(plausible(pairs, classes, num, den), "pairs")
    often = found.filter("kind = 1").select(
        "h", F.col("an").alias("n"), F.floor(F.log(F.col("an").cast("double")) / math.log(den / num)).alias("band"),
        "a1", "a2",
    ).join(side("a"), ["a1", "a2"]).select("h", "n", "band", F.col("a").alias("id")).filter("id is not null")
    often = materialise(often, "often")
    first = _best(pairs).union(plausible(_with_pivots(often).distinct(), classes, num, den))
    first = materialise(first.distinct(), "first")
    links = materialise(verified(first, docs, size, num, den), "links")
    label = components(links)
    # then one partner of each other component for each row outside; at last all that are still apart
    tried = first
    for best in (True, False):
        rest = _apart_often(often, classes, label, num, den, best)
        rest = rest.union(_apart(pairs, label)) if best else rest
        rest = materialise(rest.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            links = links.union(materialise(verified(rest, docs, size, num, den), "links"))
            label = components(links)
        tried = tried.union(rest)
    label = materialise(label, "labels").select(F.col("id").alias("rep"), "component")
    classes = classes.join(label, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = known.drop("sketch").join(classes, ["s1", "s2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.withColumnRenamed("doc_id", id_col)


def _best(pairs: DataFrame) -> DataFrame:
    """Each text with the partner of the largest count, and with the smallest partner."""
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("x"), F.min("b").alias("y"))
    ends = best.select("a", "x").union(best.select("a", "y"))
    return ends.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b"))


def _with_pivots(often: DataFrame) -> DataFrame:
    """Rows of a frequent column with pivots of their column and of a size that can link."""
    mixed = F.xxhash64("id")
    pivots = often.groupBy("h", "band").agg(F.min_by("id", mixed).alias("x"), F.max_by("id", mixed).alias("y"))
    pivots = pivots.select("h", F.explode(F.array("x", "y")).alias("pivot"), "band")
    near = pivots.select("h", "pivot", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    met = often.join(small_side(near), ["h", "band"]).filter("id != pivot")
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    for x in ("a", "b"):
        named = label.select(F.col("id").alias(x), F.col("component").alias(f"{x}_in"))
        pairs = pairs.join(named, x, "left").withColumn(f"{x}_in", F.coalesce(f"{x}_in", x))
    met = pairs.filter("a_in != b_in")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart_often(
    often: DataFrame, classes: DataFrame, label: DataFrame, num: int, den: int, best: bool
) -> DataFrame:
    """Plausible pairs of a frequent column in different components, one end outside its largest one;
    with `best`, of a row with the members of a component in its block only the likeliest.

    The rows outside are compared with all rows of the column by their sketches, a block of either at a
    time: a pair becomes a row only if its sketches allow a link.
    """
    rows = often.join(label, "id", "left").select("h", "id", F.coalesce("component", "id").alias("part"))
    parts = rows.groupBy("h", "part").agg(F.count(F.lit(1)).alias("c"))
    main = (
        parts.groupBy("h")
        .agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("m"), F.max("c").alias("c"))
        .filter("k > 1")
        .select("h", "main", F.ceil(F.col("m") / COMPARED).alias("all"), F.ceil((F.col("m") - F.col("c")) / COMPARED).alias("odd"))
    )
    rows = rows.join(small_side(main), "h").join(classes.select(F.col("rep").alias("id"), "n", "sketch"), "id")
    rows = rows.select("h", "id", "n", "sketch", "part", "main", "all", "odd", F.xxhash64("id").alias("deal"))
    here = rows.withColumn("one", F.explode(F.sequence(F.lit(0), F.col("odd") - 1))).withColumn("two", F.pmod("deal", "all"))
    outside = (
        rows.filter("part != main")
        .withColumn("one", F.pmod("deal", "odd"))
        .withColumn("two", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    )
    names = ["h", "one", "two", "id", "n", "sketch", "part", "main"]
    both = here.select(*names, F.lit(False).alias("odd")).union(outside.select(*names, F.lit(True).alias("odd")))

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, n, part, main, odd = (table[c].to_numpy() for c in ("id", "n", "part", "main", "odd"))
        sketches = table["sketch"].to_pylist()
        length = np.array([len(x) for x in sketches])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for wide in np.unique(length[odd]):
            left = np.flatnonzero(odd & (length == wide))
            for other in np.unique(length[~odd]):
                right = np.flatnonzero(~odd & (length == other))
                if max(wide, other) > 2 * min(wide, other):
                    continue  # the sizes are too far apart
                size = min(wide, other)
                x, y = (_folded([sketches[k] for k in side], size) for side in (left, right))
                for k, own in zip(left, x):
                    near = den * np.minimum(n[right], n[k]) >= num * np.maximum(n[right], n[k])
                    near &= (part[right] != part[k]) & ((part[right] == main[right]) | (ids[k] < ids[right]))
                    at = right[near]
                    differ = np.bitwise_count(y[near] ^ own).sum(axis=1)
                    may = differ <= n[at] + n[k] - 2 * least_overlap(n[at], n[k], num, den)
                    at, differ = at[may], differ[may]
                    if best and len(at):
                        at = at[np.lexsort((ids[at], differ))]
                        at = at[np.unique(part[at], return_index=True)[1]]
                    if len(at):
                        found.append((np.minimum(ids[at], ids[k]), np.maximum(ids[at], ids[k])))
        if found:
            cols = [pa.array(np.concatenate(c)) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    return both.groupBy("h", "one", "two").applyInArrow(compare, "a long, b long").distinct()


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words, halves folded onto each other down to `size` bytes."""
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return np.ascontiguousarray(x).view(U)
