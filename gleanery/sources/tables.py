"""Readers and writers of result tables: transcripts, signals, sweeps, verdicts, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNALS = (
    "set string, id string, label string, hard_negative int, in_top5 int, rank string, "
    "top1 double, top2 double, margin double, pmargin double, top1_printed_global double, "
    "top1_shown double, files string"
)
TEXT_BLOCKS = ("text", "thinking", "redacted_thinking")
MESSAGE = (
    "type string, message struct<id:string,model:string,content:string,usage:struct<"
    "input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,"
    "output_tokens:bigint>>"
)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """A signals file; `none` for a missing rank becomes null."""
    rows = spark.read.schema(SIGNALS).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.withColumn("rank", F.expr("try_cast(rank AS int)")).withColumnRenamed("id", "qid")


def write_sweep(counts: DataFrame, path: str) -> None:
    """One line per cell: pooled counts, then each set's. The grid is small by construction."""
    named = F.concat("set", F.lit("_"), F.col("name"))
    long = counts.unpivot(
        ["set", "t", "m"], ["b1_num", "b1_den", "b2_num", "b2_den"], "name", "value"
    ).withColumn("column", named)
    wide = long.groupBy("t", "m").pivot("column").agg(F.first("value"))
    wide.orderBy("t", "m").coalesce(1).write.option("header", True).csv(path)


def read_transcripts(spark: SparkSession, glob: str) -> DataFrame:
    """Records of transcript files, one JSON object per line, in file order.

    (agent, line, type, mid, model, usage fields, prompt, texts, tool_uses). A record or block of an
    unknown kind, or an assistant record without id, model, usage or blocks, fails the job.
    """
    lines = spark.read.format("text").load(glob).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line"),  # orders the lines of a file, whichever split read them
    )
    return parse_records(lines.filter(F.trim("value") != "").select(
        F.regexp_extract("file", r"agent-([^/]*)\.jsonl$", 1).alias("agent"), "line", "value"
    ))


def parse_records(lines: DataFrame) -> DataFrame:
    """(agent, line, value) -> typed records."""
    parsed = lines.select("agent", "line", F.from_json("value", MESSAGE).alias("r"))
    kind, msg = F.col("r.type"), F.col("r.message")
    blocks = F.from_json(msg["content"], "array<struct<type:string,text:string>>")
    said = kind == "assistant"
    complete = msg["id"].isNotNull() & msg["model"].isNotNull() & msg["usage"].isNotNull()
    known = F.forall(blocks, lambda b: b["type"].isin(*TEXT_BLOCKS) | b["type"].endswith("tool_use"))
    good = (kind == "user") | (said & complete & F.coalesce(known, F.lit(False)))
    checked = parsed.filter(~kind.eqNullSafe(F.lit("attachment"))).withColumn(
        "type", F.when(good, kind).otherwise(
            F.raise_error(F.lit("a transcript record has an unknown shape")).cast("string"))
    )
    return checked.select(
        "agent", "line", "type", msg["id"].alias("mid"), msg["model"].alias("model"),
        "r.message.usage.*",
        F.when(kind == "user", msg["content"]).alias("prompt"),
        F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]).alias("texts"),
        F.coalesce(F.size(F.filter(blocks, lambda b: b["type"].endswith("tool_use"))), F.lit(0))
        .alias("tool_uses"),
    )


def toml_text(value: Column) -> Column:
    """A TOML string: JSON escapes, and DEL escaped too."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)
    return F.replace(quoted, F.lit("\x7f"), F.lit("\\u007f"))


def verdict_tables(verdicts: DataFrame) -> DataFrame:
    """(qid, text): one TOML table per verdict."""
    return verdicts.select("qid", F.concat(
        F.lit("[[verdict]]\nid = "), toml_text(F.col("qid").cast("string")),
        F.lit("\nverdict = "), toml_text(F.col("verdict")),
        F.lit("\ninput_sha256 = "), toml_text(F.col("input_sha256")), F.lit("\n"),
    ).alias("text"))


def key_tables(sample: DataFrame) -> DataFrame:
    """(run_id, text): the membership table of each sampled question."""
    return sample.select("run_id", F.concat(
        F.lit("["), "run_id", F.lit("]\nset = "), toml_text(F.col("set")),
        F.lit("\nid = "), toml_text(F.col("qid").cast("string")), F.lit("\n"),
    ).alias("text"))
