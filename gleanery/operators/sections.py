"""Split Markdown files into heading passages, file by file inside the row: no shuffle."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The line patterns of headings and fences.
FENCE = r"^ {0,3}(`{3,}|~{3,})"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+([^\n]*?))?[ \t]*\z"
CLOSING_HASHES = r"[ \t]+#+[ \t]*\z"

_FENCE, _HEADING, _CLOSING, _HASHES = (re.compile(p.replace("\\z", "\\Z")) for p in (FENCE, HEADING, CLOSING_HASHES, r"^#+\z"))
#: What a line that opens, closes or heads anything begins with, after three blanks at most.
_MARKS = ("#", "`", "~", " ")

SECTIONS = T.ArrayType(T.StructType([
    T.StructField("line", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("heading", T.StringType()),
    T.StructField("trail", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("kept", T.BooleanType()),
]))


def heading_text(raw: str) -> str:
    """Trimmed heading without closing hashes; a heading of hashes only is empty."""
    text = raw.strip()
    return "" if _HASHES.search(text) else _CLOSING.sub("", text).strip()


def _first_body_line(lines: list[str]) -> int:
    """The line after a closed front matter block, else the first line."""
    return lines.index("---", 1) + 2 if lines[0] == "---" and "---" in lines[1:] else 1


def headings(lines: list[str]) -> list[tuple[int, str, list[str]]]:
    """Every heading outside fences with its line number and trail of ancestors.

    An open fence is closed by a run of the same mark that is at least as long, whatever follows it; while one is open,
    nothing else counts. An unclosed fence runs to the end.
    """
    first, fence, found = _first_body_line(lines), "", []
    trail: list[tuple[int, str]] = []
    for n, line in enumerate(lines, 1):
        if not line.startswith(_MARKS):
            continue
        if mark := _FENCE.search(line):
            if fence:
                fence = "" if mark[1].startswith(fence) else fence
            elif n >= first:
                fence = mark[1]
        elif not fence and n >= first and (head := _HEADING.search(line)):
            level = len(head[1])
            trail = [t for t in trail if t[0] < level] + [(level, heading_text(head[2] or ""))]
            found.append((n, trail[-1][1], [t[1] for t in trail]))
    return found


def _cut(lines: list[str]) -> str:
    """The lines without the blank ones at the end."""
    raw = "\n".join(lines)
    at = raw.find("\n", len(raw.rstrip()))
    return raw if at < 0 else raw[:at]


@F.arrow_udf(SECTIONS)
def split_file(texts: pa.Array) -> pa.Array:
    """The sections of each file."""
    counts, rows = [], []
    for text in texts.to_pylist():
        if text is None:
            counts.append(0)
            continue
        lines = text.split("\n")
        found = headings(lines)
        if not found or found[0][0] > 1:
            found = [(1, "", []), *found]
        for (n, heading, trail), last in zip(found, [*(f[0] - 1 for f in found[1:]), len(lines)]):
            own = _cut(lines[n - 1 : last])
            height = own.count("\n") + 1
            rows.append((n, height, heading, trail, own, height > 1 if trail else bool(own.strip())))
        counts.append(len(found))
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
    pieces = pa.StructArray.from_arrays(columns, names=SECTIONS.elementType.names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pieces)


def sections(files: DataFrame) -> DataFrame:
    """(path, line_start, line_end, heading, heading_path, text, kept) of every section.

    The text before the first heading is a section without heading. Trailing blank lines do not
    belong to a section. One with nothing below its heading has `kept` false, but stays in the
    trail of those below it.
    """
    # texts are cut before they become rows: no row of a section carries its whole file
    found = files.select("path", split_file("text").alias("found"))
    rows = found.select("path", F.explode("found").alias("s")).select("path", "s.*")
    return rows.select(
        "path",
        F.col("line").cast("bigint").alias("line_start"),
        (F.col("line") + F.col("height") - 1).cast("bigint").alias("line_end"),
        "heading",
        F.col("trail").alias("heading_path"),
        "text",
        "kept",
        (F.size("trail") > 0).alias("headed"),
    )


def passages(files: DataFrame) -> DataFrame:
    """The sections that hold text: the rows of the index."""
    return sections(files).filter("kept").select(
        "path", "heading", "heading_path", "line_start", "line_end", "text"
    )


def split_counters(files: DataFrame) -> DataFrame:
    """One row: files, passages and sections dropped because nothing stood below their heading."""
    counts = sections(files).agg(
        F.count_if("kept").alias("passages"),
        F.count_if(~F.col("kept") & F.col("headed")).alias("empty_dropped"),
    )
    return counts.select(
        files.agg(F.count(F.lit(1))).scalar().alias("files"), "passages", "empty_dropped"
    )
