"""A corpus from raw documents to tokens: five stages, each a written table that the next one reads.

Rows that share a doc_id stand and fall together. Rows with a null doc_id pass the filters, since
decisions are made by id. Extra columns are carried along, whatever their names; only in the last stage
its own n_tokens, ids, ids_sha256 and decoded_sha256 take the place of columns called so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.bpe import DIGESTS, digests
from gleanery.llm.jaccardjoin import jaccard_components
from gleanery.llm.linechunks import dedup_lines
from gleanery.llm.neighbours import toxicity
from gleanery.llm.session import attach
from gleanery.llm.winnow import contamination
from gleanery.session import materialise, scratch_path, small_side

TOKENIZER = "word_bpe_49k.json"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` without the ids listed; the list is written first, and sent to the executors only if a count shows
    it small."""
    ids = materialise(ids.select("doc_id").distinct(), "dropped")
    return docs.join(small_side(ids), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents predicted toxic go."""
    labels = attach(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, toxicity(docs, labels).filter("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated passages go, and documents of which nothing else is left; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.lit(0).alias("_"), *[F.struct(F.col(f"`{c}`").alias("x")).alias(f"k{i}") for i, c in enumerate(others)])
    out = dedup_lines(docs.select("doc_id", "text", row.alias("row")))
    out = out.filter(~F.coalesce((F.col("n_removed") > 0) & (F.trim("text") == ""), F.lit(False)))
    kept = {c: F.col(f"row.k{i}.x") for i, c in enumerate(others)}
    if "n_chars" in kept:
        changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(kept["n_chars"])
        kept["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the document with the smallest id stays."""
    return _without(docs, jaccard_components(docs).filter("doc_id != component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents of which a twentieth is benchmark text go."""
    items = attach(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contamination(docs, items).filter("contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of each document, with digests of the ids and of the decoded text."""
    import public_tokenizers

    own = (*DIGESTS, "ids")
    keep = [c for c in docs.columns if c not in ("doc_id", "text", *own)]
    return digests(docs, public_tokenizers.path(TOKENIZER), ids=True, keep=keep)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: Nearest neighbours, content-defined chunks and components are beyond SQL: tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
