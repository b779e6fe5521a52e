"""Payloads for the judge, replies applied to them, and the integrity of verdict sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.formats import excerpt, fixed
from gleanery.functions.verdicts import (
    DIFFERENT_INPUT,
    FORGED_MARKER,
    UNREADABLE,
    forges_boundary,
    verdict_category,
    verdict_token,
)
from gleanery.functions.words import body_text, heading_label, squeeze_space
from gleanery.params import BLOCK_ID, JUDGE_ERROR, TOP_OF_FILE

VERDICTS = ("ANSWERABLE", "NOT_ANSWERABLE", "JUDGE_ERROR")
LETTERS = "abcdefghij"


def _letter() -> Column:
    return F.substring(F.lit(LETTERS), F.col("passage_rank"), F.lit(1))


def payloads(questions: DataFrame, shown: DataFrame) -> DataFrame:
    """(qid, payload, input_sha256, forged) from results that carry the passage text.

    A question has at most top_k files of per_file_cap passages, so its block list is bounded.
    """
    label = F.concat(F.col("rank").cast("string"), _letter())
    block = F.concat(
        F.when(F.col("passage_rank") == 1, F.format_string("File %d: %s\n", "rank", "path"))
        .otherwise(""),
        F.lit("--- passage "), label, F.lit(" | heading: "),
        heading_label(F.col("heading_path"), TOP_OF_FILE),
        F.format_string(" | lines %d-%d ---\n", "line_start", "line_end"),
        F.col("text"), F.lit("\n--- end passage "), label, F.lit(" ---\n\n"),
    )
    blocks = shown.select(
        "qid", F.struct("rank", "passage_rank", block.alias("block")).alias("b"),
        forges_boundary(F.col("text")).alias("forged"),
    ).groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), ""
        ).alias("blocks"),
        F.max("forged").alias("forged"),
    )
    text = F.concat(
        F.lit(f"=== {BLOCK_ID} ===\nQuestion: "), squeeze_space(F.col("question")), F.lit("\n\n"),
        F.col("blocks"), F.lit(f"=== end {BLOCK_ID} ===\n"),
    )
    return questions.join(blocks, "qid").select("qid", text.alias("payload"), "forged").withColumn(
        "input_sha256", F.sha2("payload", 256)
    )


def apply_replies(prepared: DataFrame, replies: DataFrame) -> DataFrame:
    """(qid, token, category): a reply counts only if it was given for this very payload.

    A payload with a passage line that looks like one of its own markers is never judged.
    """
    joined = prepared.select("qid", F.col("input_sha256").alias("_want"), "forged").join(replies, "qid", "left")
    category = (
        F.when(F.coalesce("forged", F.lit(False)), FORGED_MARKER)
        .when(F.col("input_sha256").isNotNull() & (F.col("input_sha256") != F.col("_want")),
               DIFFERENT_INPUT)
        .when(F.col("reply").isNull(), UNREADABLE)
        .otherwise(verdict_category(F.col("reply")))
    )
    return joined.withColumn("category", category).select(
        "qid",
        F.when(F.col("category").isNotNull(), JUDGE_ERROR)
        .otherwise(verdict_token(F.col("reply"))).alias("token"),
        "category",
    )


def verdict_faults(questions: DataFrame, prepared: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(qid, fault): every reason for which a verdict set is refused. Empty means usable."""
    given = verdicts.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(~F.col("verdict").isin(*VERDICTS)).alias("bad_token"),
        F.min("input_sha256").alias("low"), F.max("input_sha256").alias("high"),
    )
    known = questions.select("qid", F.lit(True).alias("known"))
    both = (
        given.withColumn("given", F.lit(True))
        .join(known, "qid", "full")
        .join(prepared.select("qid", F.col("input_sha256").alias("want")), "qid", "left")
    )
    faults = F.array_compact(F.array(
        F.when(F.col("known").isNull(), "not a question in the eval set"),
        F.when(F.col("n") > 1, "appears more than once"),
        F.when(F.col("bad_token"), "verdict outside the domain"),
        F.when(
            F.col("given") & F.col("known")
            & ((F.col("low") != F.col("want")) | (F.col("high") != F.col("want"))),
            "hash is not the payload's",
        ),
        F.when(F.col("given").isNull(), "no verdict for this eval question"),
    ))
    return both.select("qid", F.explode(faults).alias("fault"))


def result_text(
    shown: DataFrame, questions: DataFrame, top: DataFrame, repo: str, commit: str,
    mode: str, reference: float,
) -> DataFrame:
    """(qid, text): the printed result of each question, passages quoted by excerpt."""
    body = excerpt(body_text(F.col("text"), F.col("heading_path")))
    block = F.concat(
        F.when(F.col("passage_rank") == 1, F.concat(
            F.format_string("%d. %s  (score %s)\n", "rank", "path", fixed(F.col("score"), 4)),
            F.lit("   "), F.col("file_url"), F.lit("\n"),
        )).otherwise(""),
        F.lit("   "), _letter(),
        F.format_string(". lines %d-%d  Heading: ", "line_start", "line_end"),
        heading_label(F.col("heading_path"), TOP_OF_FILE), F.lit("\n      "), F.col("url"),
        F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(""),
    )
    blocks = shown.select(
        "qid", F.struct("rank", "passage_rank", block.alias("block")).alias("b")
    ).groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n"
        ).alias("blocks")
    )
    head = F.concat(
        F.lit("Sources for: "), F.col("question"),
        F.lit(f"\nDocs: {repo} @ {commit}\nRanking: {mode}  no text generated\n"),
        F.format_string(
            "Top score: %s (best passage similarity; ingest reference %s, reported only: "
            "retrieval does not decide whether the docs answer)",
            fixed(F.col("top_score"), 3), fixed(F.lit(reference), 3),
        ),
        F.lit("\n\n"),
    )
    return questions.join(blocks, "qid").join(top, "qid").select(
        "qid",
        F.concat(head, "blocks", F.lit("\n\nThese are sources, not an answer.")).alias("text"),
    )
