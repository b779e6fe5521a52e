"""The stored index: passages, postings, vocabularies and vectors as Parquet tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.embedder import Embedder, hashed
from gleanery.functions.vectors import base64_text
from gleanery.functions.words import model_text
from gleanery.operators import lexical
from gleanery.operators.scan import laid_out, running
from gleanery.params import DEFAULT_RANK, RankParams
from gleanery.plans.bags import write_bags
from gleanery.session import materialise, scratch_path

PASSAGES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("heading", T.StringType()),
    T.StructField("heading_path", T.ArrayType(T.StringType())),
    T.StructField("line_start", T.LongType()),
    T.StructField("line_end", T.LongType()),
    T.StructField("text", T.StringType()),
])
TABLES = {
    "passages": PASSAGES.simpleString(),
    "passage_terms": "path string, line_start bigint, dl int, term string, tf int",
    "file_terms": "path string, dl bigint, term string, tf bigint",
    "passage_vocabulary": "term string, df bigint",
    "file_vocabulary": "term string, df bigint",
    "vectors": "path string, line_start bigint, embedding array<tinyint>",
    "skipped": "path string, reason string",
    "meta": (
        "repo string, commit string, params string, passages bigint, passage_avgdl double, "
        "files bigint, file_avgdl double, files_read bigint, skipped bigint, empty_dropped bigint, "
        "truncated bigint, tau_salad double, tau_offtopic double, threshold double, "
        "passage_buckets int, file_buckets int"
    ),
}


#: What an index consists of besides its passages, and the tables of each part.
PARTS = ("passage", "file", "vectors")
PART_OF = {
    "passage_terms": "passage", "passage_vocabulary": "passage", "file_terms": "file", "file_vocabulary": "file",
    "vectors": "vectors",
}


class IndexMismatch(ValueError):
    """The stored index is missing a table or was built with other parameters."""


@dataclass(frozen=True)
class Meta:
    repo: str
    commit: str
    params: str
    passages: int
    passage_avgdl: float
    files: int
    file_avgdl: float
    files_read: int = 0
    skipped: int = 0
    empty_dropped: int = 0
    truncated: int = 0
    tau_salad: float = 0.0
    tau_offtopic: float | None = None
    threshold: float = 0.0
    passage_buckets: int = 0
    file_buckets: int = 0


@dataclass(frozen=True)
class Index:
    """Readers of one stored index. Nothing is held in memory but the one-row `meta`."""

    spark: SparkSession
    root: str
    meta: Meta
    params: RankParams = DEFAULT_RANK
    embedder: Embedder = hashed(DEFAULT_RANK.embedding.dim)
    parts: frozenset[str] = frozenset(PARTS)

    def __post_init__(self) -> None:
        if self.embedder.dim != self.params.embedding.dim:
            raise IndexMismatch(f"the embedder has {self.embedder.dim} components, the index {self.params.embedding.dim}")

    def table(self, name: str) -> DataFrame:
        self._require(PART_OF.get(name))
        return _read(self, name)

    def sections(self) -> DataFrame:
        """The passages, and with `kept` false the sections that hold nothing."""
        schema = T.StructType([*PASSAGES.fields, T.StructField("kept", T.BooleanType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/passages")

    def _require(self, part: str | None) -> None:
        if part and part not in self.parts:
            raise IndexMismatch(f"the index was opened without its part {part}")

    def postings(self, unit: str) -> tuple[DataFrame, int]:
        """The postings of passages or files with the bucket they lie in, and the number of buckets."""
        self._require(unit)
        return _postings(self, f"{unit}_terms"), getattr(self.meta, f"{unit}_buckets")


def _read(index: Index, name: str) -> DataFrame:
    if name == "passages":
        return index.sections().filter("kept").drop("kept")
    if name.endswith("_terms"):
        return _postings(index, name).drop("bucket")
    return index.spark.read.schema(TABLES[name]).parquet(f"{index.root}/{name}")


def _postings(index: Index, name: str) -> DataFrame:
    """Postings of both units are stored with the same types."""
    fields = [field.split(" ") for field in TABLES[name].split(", ")]
    stored = index.spark.read.schema("path string, line_start bigint, dl bigint, term string, tf bigint, bucket int")
    found = stored.parquet(f"{index.root}/terms/unit={name.removesuffix('_terms')}")
    return found.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields], "bucket")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a table that arrives in fewer splits; at scale the splits are plenty."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])


def build_index(
    passages: DataFrame,
    repo: str = "docs/fixture",
    commit: str = "0" * 40,
    params: RankParams = DEFAULT_RANK,
    counters: dict[str, int] | None = None,
    skipped: DataFrame | None = None,
    root: str | None = None,
    embedder: Embedder | None = None,
    parts: Sequence[str] = PARTS,
) -> Index:
    """Write every table of the index below a fresh directory, then open it. Of `passages` with a column `kept` all rows
    are written, but only those are passages of the index.

    With fewer `parts` the tables of the others are left out until `with_parts` adds them. Postings lie in buckets of terms, a bucket with a frequent term in several files (`write_bags`).
    """
    spark = passages.sparkSession
    embedder = embedder or hashed(params.embedding.dim)
    root = root or scratch_path(spark, "index")
    fields = [F.col(f.name).cast(f.dataType) for f in PASSAGES.fields]
    kept = F.col("kept") if "kept" in passages.columns else F.lit(True).alias("kept")
    passages = spread(passages.select(*fields, kept), "path", "line_start")
    passages.write.option("compression", "zstd").parquet(f"{root}/passages")

    if skipped is None:
        skipped = spark.createDataFrame([], TABLES["skipped"])
    skipped.write.parquet(f"{root}/skipped")
    meta = Meta(repo, commit, json.dumps(params.as_dict(), sort_keys=True), 0, 0.0, 0, 0.0, **(counters or {}))
    return with_parts(Index(spark, root, meta, params, embedder, frozenset()), *parts)


def with_parts(index: Index, *parts: str) -> Index:
    """`index` with those of `parts` written that it lacks; its passages are always there. The meta row follows the
    last part."""
    stored, params, changes = index.table("passages"), index.params, {}
    missing = [part for part in PARTS if part in parts and part not in index.parts]
    if not missing:
        return index
    units = [unit for unit in ("passage", "file") if unit in missing]
    if units:
        size = stored.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = write_bags(lexical.bag_texts(stored, params), size, f"{index.root}/terms", units, params.path_weight)
        changes |= {f"{unit}_buckets": buckets for unit in units}
    for unit in units:
        lexical.document_frequency(_read(index, f"{unit}_terms")).write.parquet(f"{index.root}/{unit}_vocabulary")
    if "passage" in missing:
        stats = lexical.corpus_stats(_read(index, "passage_terms"), stored).first()
        changes |= {"passages": stats["n_bags"], "passage_avgdl": stats["avgdl"]}
    if "file" in missing:
        nameless = lexical.file_bags(stored.filter("path is null"), params).select("tf")  # of no file, but of the words
        counts = _read(index, "file_terms").select("tf").unionByName(nameless)
        stats = lexical.corpus_stats(counts, stored.select("path").distinct()).first()
        changes |= {"files": stats["n_bags"], "file_avgdl": stats["avgdl"]}
    if "vectors" in missing:
        text = model_text(F.col("text"), F.col("heading_path"))
        stored.select(
            "path", "line_start", index.embedder.passage(text).alias("embedding")
        ).write.option("compression", "zstd").parquet(f"{index.root}/vectors")
    index = replace(index, meta=replace(index.meta, **changes), parts=index.parts | set(missing))
    return write_meta(index) if index.parts == frozenset(PARTS) else index


def write_meta(index: Index, **changes: float | None) -> Index:
    """Publish the one-row table last: an index without it is not complete."""
    meta = replace(index.meta, **changes)
    row = tuple(getattr(meta, name.split()[0]) for name in TABLES["meta"].split(", "))
    frame = index.spark.createDataFrame([row], TABLES["meta"])
    frame.coalesce(1).write.mode("overwrite").parquet(f"{index.root}/meta")
    return replace(index, meta=meta)


def open_index(
    spark: SparkSession, root: str, params: RankParams = DEFAULT_RANK, embedder: Embedder | None = None
) -> Index:
    """Read the meta row and refuse an index built with other parameters. Questions need the embedder it was built with."""
    rows = spark.read.schema(TABLES["meta"]).parquet(f"{root}/meta").limit(2).collect()
    if len(rows) != 1:
        raise IndexMismatch(f"{root} has no single meta row")
    stored = json.loads(rows[0]["params"])
    expected = params.fingerprint()
    shared = {**stored, "embedding": {
        k: v for k, v in stored.get("embedding", {}).items() if k in expected["embedding"]
    }}
    if shared != json.loads(json.dumps(expected)):
        raise IndexMismatch("the index was built with different retrieval parameters")
    return Index(spark, root, Meta(**rows[0].asDict()), params, embedder or hashed(params.embedding.dim))


def fingerprint(table: DataFrame) -> DataFrame:
    """One row: how many rows and an order-free digest of their content, summed map-side."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns))), 256)
    piece = lambda at: F.sum(
        F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")
    )
    return table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.concat_ws("-", *[piece(at).cast("string") for at in (1, 9, 17, 25)]).alias("digest"),
    )


def canonical_lines(index: Index) -> DataFrame:
    """Passages as canonical JSON lines in (path, line_start) order, vectors in base64.

    A range-partitioned sort: the lines of each output file follow those of the one before."""
    joined = index.table("passages").join(index.table("vectors"), ["path", "line_start"])
    return joined.select(
        "path", "line_start",
        F.to_json(F.struct(
            base64_text(F.col("embedding")).alias("embedding"), "heading", "heading_path", "line_end", "line_start",
            "path", "text",
        )).alias("line"),
    ).orderBy("path", "line_start")


LEAF_LINES = 1024


def digest_tree(lines: DataFrame, order: Sequence[str], line: str = "line", leaf: int = LEAF_LINES) -> tuple[str, int]:
    """(root hash, lines) of a table of lines in an order, whatever partitions it lies in.

    Lines are numbered by running counts; each `leaf` of them are hashed together, each `leaf` of those hashes again,
    up to one. No task has more than `leaf` lines of a node, and the driver sees the root alone.
    """
    stored = laid_out(lines.withColumn("_hash", F.sha2(F.col(line), 256)), [], order, ["_hash"])
    level = running(stored, [], {"_n": ("sum", F.lit(1).cast("long"))}).select((F.col("_n") - 1).alias("_n"), "_hash")
    count = stored.count()
    n = count
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_hash"))), lambda x: x["_hash"]), "\n")
        level = level.groupBy(F.floor(F.col("_n") / leaf).alias("_n")).agg(F.sha2(joined, 256).alias("_hash"))
        n = -(-n // leaf)
        if n <= 1:
            root = level.first()
            return (root["_hash"] if root else hashlib.sha256(b"").hexdigest()), count
        level = materialise(level, "digests")


def export(index: Index, path: str) -> tuple[str, int]:
    """Write the canonical lines as sorted text parts below a new path; (root hash, lines)."""
    lines = canonical_lines(index)
    lines.select("line").write.text(path)
    return digest_tree(lines, ["path", "line_start"])


def publish(index: Index, pointer: str) -> str:
    """Point a small text file at a complete index, in one step for readers: the pointer is written beside its place
    and renamed over it by the file system, so that at any moment one whole pointer is there. Returns the digest of
    the index's lines, which stands in the pointer too."""
    digest, _ = digest_tree(canonical_lines(index), ["path", "line_start"])
    point(index.spark, pointer, json.dumps({"digest": digest, "root": index.root}, sort_keys=True).encode())
    return digest


def point(spark: SparkSession, pointer: str, content: bytes) -> None:
    """Write `content` beside `pointer` and rename it over the old one.

    A local file system has no rename with overwriting: Hadoop would delete the old file first, and for a moment
    there were none. Its plain rename replaces a file in one step, but not the checksum file beside it, so there the
    pointer is written without one."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    new, old = fs.Path(f"{pointer}.{uuid.uuid4().hex}"), fs.Path(pointer)
    store = new.getFileSystem(conf)
    local = store.getUri().getScheme() == "file"
    store = store.getRaw() if local else store
    out = store.create(new)
    out.write(bytearray(content))
    out.close()
    if local:
        store.delete(fs.Path(old.getParent(), f".{old.getName()}.crc"), False)  # of a pointer written with one
        if not store.rename(new, old):
            raise OSError(f"the pointer {pointer} could not be replaced")
        return
    files = fs.FileContext.getFileContext(store.getUri(), conf)
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    files.rename(new, old, over)


def published(spark: SparkSession, pointer: str, params: RankParams = DEFAULT_RANK, embedder: Embedder | None = None) -> Index:
    """The index that a pointer names now."""
    return open_index(spark, json.loads(spark.read.text(pointer).first()[0])["root"], params, embedder)


def require_commit(index: Index, pinned: str) -> None:
    """A question set counts only against the commit its line numbers were taken from."""
    if index.meta.commit != pinned:
        raise IndexMismatch(f"the questions are pinned to {pinned}, the index was built from {index.meta.commit}")
