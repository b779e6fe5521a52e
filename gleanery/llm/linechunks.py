"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines says where a chunk begins, so an inserted line moves
only the boundaries next to it. Chunks that occur more than once are removed everywhere but at their first
occurrence (by id, then text, then place), after comparison with its bytes.

A repeated passage seldom begins and ends at boundaries. What it holds beyond whole chunks is found by the
shortest windows of lines: at least two lines and LEAST_WORDS words, from each line forwards and to each line
backwards, and each long line alone. Windows inside a chunk are looked up for its first occurrence alone: in
its copies they go with the chunk. So every repeated run of lines of so many words goes whole, wherever the
boundaries fall; they decide how much is looked up, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.session import attach, tidy
from gleanery.llm.textnum import NOT_NEWLINE, PLACES, SOLID, U, mix, pieces, powers, signed
from gleanery.session import materialise

#: Words of a line that counts on its own.
LONG_LINE = 25
#: Words that a window of several lines has at least.
LEAST_WORDS = 12
#: A chunk begins at every so many lines, about.
EVERY = 6
STEP, OTHER = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)
WINDOW, CHUNK = U(0), U(0x8E9D5A7C3B1F2647)
INSIDE_TYPE = "array<struct<k1:long,k2:long,first:int,end:int>>"
INSIDE = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))


def boundaries(h: np.ndarray, opens: np.ndarray, every: int = EVERY) -> np.ndarray:
    """Whether a chunk begins at each line: at the first line of a text, and where the hash of a line and the
    one before says so."""
    rolled = np.ones(len(h), U)
    rolled[1:] = mix(h[:-1] * PLACES[0] + h[1:] * PLACES[1])
    return (np.arange(len(h)) == opens) | (rolled % U(every) == 0)


def _windows(words: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end line of each long line and of each shortest window of lines."""
    long = words >= LONG_LINE
    total = np.concatenate([[0], np.cumsum(words)])
    number = np.arange(len(words))
    # the shortest window from each line on, and to each line; not again if it is the one from its first line on
    to = np.maximum(number + 2, np.searchsorted(total, total[:-1] + LEAST_WORDS))
    since = np.minimum(number - 1, np.searchsorted(total, total[1:] - LEAST_WORDS, side="right") - 1)
    ahead = np.flatnonzero(to <= closes)
    back = np.flatnonzero(since >= opens)
    back = back[to[since[back]] != back + 1]
    first, end = np.concatenate([ahead, since[back]]), np.concatenate([to[ahead], back + 1])
    longs = np.concatenate([[0], np.cumsum(long)])
    some = longs[end] - longs[first] < end - first  # windows of long lines only go line by line
    alone = np.flatnonzero(long)
    return np.concatenate([alone, first[some]]), np.concatenate([alone + 1, end[some]])


def _keys(piece, every: int) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """(chunks, number of windows inside each, windows): key, owner, first line, end line of each.

    Windows inside chunks come first, in the order of the chunks; then those that cross a boundary.
    """
    starts, ends, owner = piece.spans(NOT_NEWLINE)
    none = np.zeros(0, np.int64)
    if not len(starts):
        empty = {"k1": none.astype(U), "k2": none.astype(U), "owner": none, "first": none, "end": none}
        return empty, none, empty
    h = piece.hashes(starts, ends, fold=False)
    at = piece.spans(SOLID)[0]
    words = np.searchsorted(at, ends) - np.searchsorted(at, starts)
    n = len(h)
    opens, closes = np.searchsorted(owner, owner), np.searchsorted(owner, owner, side="right")
    up, down = powers(n + 1)
    sums = []
    for salt in (STEP, OTHER):
        sums.append(np.zeros(n + 1, U))
        np.cumsum(mix(h ^ salt) * up[:-1], out=sums[-1][1:])

    def keyed(first: np.ndarray, end: np.ndarray, kind: np.uint64) -> dict[str, np.ndarray]:
        one, two = (mix((x[end] - x[first]) * down[first] + (end - first).astype(U)) ^ kind for x in sums)
        return {"k1": one, "k2": two, "owner": owner[first], "first": first - opens[first], "end": end - opens[first]}

    begins = boundaries(h, opens, every)
    chunk = np.cumsum(begins) - 1
    from_, to = np.flatnonzero(begins), np.append(np.flatnonzero(begins)[1:], n)
    total = np.concatenate([[0], np.cumsum(words)])
    held = total[to] - total[from_]
    whole = np.flatnonzero(np.where(to - from_ > 1, held >= LEAST_WORDS, held >= LONG_LINE))
    first, end = _windows(words, opens, closes)
    inside = np.where(chunk[first] == chunk[end - 1], chunk[first], n)
    order = np.argsort(inside, kind="stable")
    inside = inside[order]
    sizes = np.searchsorted(inside, whole, side="right") - np.searchsorted(inside, whole)
    return keyed(from_[whole], to[whole], CHUNK), sizes, keyed(first[order], end[order], WINDOW)


def _chunks(every: int):
    """A row for each chunk, with the windows inside, and one for each other window, without such a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                chunks, sizes, windows = _keys(piece, every)
                n = int(sizes.sum())
                columns = {
                    name: pa.array(np.concatenate([signed(chunks[name]), signed(windows[name][n:])])) for name in ("k1", "k2")
                }
                rows = pa.array(piece.first + np.concatenate([chunks["owner"], windows["owner"][n:]]))
                columns |= {name: batch.column(name).take(rows) for name in ("doc_id", "text_key")}
                for name in ("first", "end"):
                    columns[name] = pa.array(np.concatenate([chunks[name], windows[name][n:]]).astype(np.int32))
                parts = [pa.array(signed(windows[k][:n])) for k in ("k1", "k2")]
                parts += [pa.array(windows[k][:n].astype(np.int32)) for k in ("first", "end")]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                    pa.StructArray.from_arrays(parts, fields=list(INSIDE.value_type)),
                )
                columns["inside"] = pa.concat_arrays([lists.cast(INSIDE), pa.nulls(len(windows["k1"]) - n, INSIDE)])
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _lines(text: str) -> tuple[list[str], list[int]]:
    """All lines, and which of them are not empty."""
    lines = text.split("\n")
    return lines, [k for k, x in enumerate(lines) if x]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of first occurrences."""
    for batch in batches:
        for row in batch.select(["text", "parts"]).to_pylist():
            lines, solid = _lines(row["text"])
            parts = row["parts"]
            yield pa.RecordBatch.from_pydict({
                "k1": [p["k1"] for p in parts],
                "k2": [p["k2"] for p in parts],
                "wording": ["\n".join(lines[k] for k in solid[p["first"] : p["end"]]) for p in parts],
            }, schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("wording", pa.string())]))


def _without(text: str | None, parts: list | None) -> tuple[str | None, int, int]:
    """(text, lines removed, lines) after removing the parts whose bytes are the same."""
    if not text:
        return text, 0, 0
    lines, solid = _lines(text)
    gone: set[int] = set()
    for p in parts or []:
        own = solid[p["first"] : p["end"]]
        if "\n".join([lines[k] for k in own]) == p["wording"]:
            gone.update(own)
    if not gone:
        return text, 0, len(solid)
    return "\n".join([x for k, x in enumerate(lines) if k not in gone]), len(gone), len(solid)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """`docs` with repeated passages of lines removed, and n_lines, n_removed (lines that are not empty).

    One output row for each input row and all its columns; input columns called n_lines or n_removed give
    way. Texts keep their null or empty value; a text may become empty. Rows with the same id and text are
    one document: what stays in one stays in all. Null ids are an id of their own that comes first. Lines
    end at a newline; empty lines join neither hashes nor counts. A chunk begins at one line of `every`, about.
    """
    attach(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names if c != text_col)).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
    )
    plain = base.select("doc_id", "text_key", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    cut = materialise(
        plain.mapInArrow(
            tidy(_chunks(every)), f"k1 long, k2 long, doc_id {kind}, text_key long, first int, end int, inside {INSIDE_TYPE}"
        ),
        "chunks",
    )
    place = F.struct("doc_id", "text_key", "first", "end")
    # copies of a chunk are combined before the shuffle: the windows inside are those of its first occurrence
    once = cut.filter("inside is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key", "first", "end", "inside")).alias("o"))
    once = once.select(F.col("o.doc_id").alias("doc_id"), F.col("o.text_key").alias("text_key"), F.inline("o.inside"))
    found = cut.drop("inside").unionByName(materialise(once, "inside"))
    repeated = (
        found.groupBy("k1", "k2").agg(F.min(place).alias("kept"), F.max(place).alias("last")).filter("kept != last")
    )
    repeated = materialise(repeated.select("k1", "k2", "kept"), "repeated")
    same_row = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    firsts = repeated.groupBy(F.col("kept.doc_id").alias("_id"), F.col("kept.text_key").alias("_key")).agg(
        F.collect_list(F.struct("k1", "k2", F.col("kept.first").alias("first"), F.col("kept.end").alias("end"))).alias("parts")
    )
    # with the columns of the last join, so that Spark deals the texts out once for both
    once = base.join(firsts, same_row("doc_id", "_id") & (F.col("text_key") == F.col("_key"))).select("row", "text", "parts")
    wording = once.mapInArrow(tidy(_cut), "k1 long, k2 long, wording string").groupBy("k1", "k2").agg(F.first("wording").alias("wording"))
    copies = (
        found.join(repeated, ["k1", "k2"])
        .filter(~place.eqNullSafe(F.col("kept")))
        .select("k1", "k2", "doc_id", "text_key", "first", "end")
        .join(wording, ["k1", "k2"])
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.collect_set(F.struct("first", "end", "wording")).alias("parts"))
    )
    joined = base.join(copies, same_row("doc_id", "_id") & (F.col("text_key") == F.col("_key")), "left")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                got = [_without(t.as_py(), p.as_py()) for t, p in zip(part.column("text"), part.column("parts"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array([g[0] for g in got], pa.string()),
                        pa.array([g[2] for g in got], pa.int64()),
                        pa.array([g[1] for g in got], pa.int64()),
                    ],
                    names=["row", "text", "n_lines", "n_removed"],
                )

    row = base.schema["row"].dataType.simpleString()
    out = joined.select("row", "text", "parts").mapInArrow(tidy(rebuild), f"row {row}, text string, n_lines long, n_removed long")
    kept = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*kept, "n_lines", "n_removed")
