"""Markdown corpora: directories, archives, path rules, and the checks on them."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A source is not what its configuration says."""


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every .md file below `root`, path relative to it."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[mM][dD]").option("recursiveFileLookup", "true").load(root)
    )
    plain = F.regexp_replace("path", r"^file:/*", "/")
    base = root.removeprefix("file:").rstrip("/") + "/"
    return files.select(F.replace(plain, F.lit(base), F.lit("")).alias("path"), "content")


def read_archives(spark: SparkSession, glob: str, repo: str, commit: str) -> DataFrame:
    """(path, content) of the Markdown files in gzipped tar archives, one task per archive.

    A wrong commit comment or a member outside the pinned top directory fails the job.
    """
    top = f"{repo.split('/', 1)[1]}-{commit}"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(blob), mode="r:gz") as tar:
                    for member in tar:
                        note = tar.pax_headers.get("comment", commit)
                        head, _, rel = member.name.partition("/")
                        if note != commit or head != top:
                            raise SourceError("archive does not match pinned commit")
                        outside = not rel or rel.startswith("/") or ".." in rel.split("/")
                        if not member.isfile() or outside or not rel.lower().endswith(".md"):
                            continue
                        yield pd.DataFrame({"path": [rel], "content": [tar.extractfile(member).read()]})

    blobs = spark.read.format("binaryFile").load(glob).select("content")
    return blobs.mapInPandas(unpack, "path string, content binary")


def listed(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """A file is read if an include names it or its directory and no exclude is its prefix."""
    keep = F.lit(False)
    for entry in include:
        keep = keep | (path.startswith(entry) if entry.endswith("/") else path == entry)
    for prefix in exclude:
        keep = keep & ~path.startswith(prefix)
    return keep


def decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the UTF-8 files and (path, reason) of the others.

    A leading byte order mark goes; every line end becomes a line feed."""
    raw = files.select("path", F.col("content").cast("string").alias("raw"))
    valid = F.is_valid_utf8("raw")
    text = F.regexp_replace(F.regexp_replace("raw", "^\\x{FEFF}", ""), "\r\n|\r", "\n")
    return (
        raw.filter(valid).select("path", text.alias("text")),
        raw.filter(~valid).select("path", F.lit("not utf-8").alias("reason")),
    )


def uncovered(paths: DataFrame, include: Sequence[str]) -> DataFrame:
    """(entry): include entries that match no file. The rules are few; the paths are scanned once."""
    marks = [
        F.max(F.col("path").startswith(e) if e.endswith("/") else F.col("path") == e).alias(f"m{i}")
        for i, e in enumerate(include)
    ]
    found = paths.agg(*marks)
    pairs = F.array(*[
        F.struct(F.lit(e).alias("entry"), F.coalesce(F.col(f"m{i}"), F.lit(False)).alias("hit"))
        for i, e in enumerate(include)
    ])
    return found.select(F.explode(pairs).alias("p")).filter(~F.col("p.hit")).select("p.entry")


def require_covered(paths: DataFrame, include: Sequence[str]) -> None:
    missing = [r.entry for r in uncovered(paths, include).limit(1).collect()]
    if missing:
        raise SourceError(f"include entry {missing[0]} matches no .md file")
