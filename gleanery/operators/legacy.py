"""Earlier ranking and confidence methods, kept for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.lexical import idf
from gleanery.operators.topk import top_k
from gleanery.params import DEFAULT_RANK, RankParams
from gleanery.session import materialise, small_side


def capped(scores: DataFrame, params: RankParams = DEFAULT_RANK, score: str = "score") -> DataFrame:
    """First `top_k` passages by score with at most `per_file_cap` of a file."""
    order = [F.desc(score), F.asc("path"), F.asc("line_start")]
    near = top_k(scores, ["qid", "path"], order, params.per_file_cap, rank="in_file")
    return top_k(near, ["qid"], order, params.top_k).drop("in_file")


def coverage(
    terms: DataFrame, vocabulary: DataFrame, n_bags: Column, best: DataFrame, bags: DataFrame
) -> DataFrame:
    """(qid, coverage): share of the asked idf mass that the best passage holds.

    A term the corpus does not know counts in full below the line.
    """
    asked = terms.join(vocabulary, "term", "left").select(
        "qid", "term", idf(n_bags, F.coalesce("df", F.lit(0))).alias("idf")
    )
    mass = asked.groupBy("qid").agg(F.sum("idf").alias("asked"))
    held = (
        bags.join(small_side(best.select("qid", "path", "line_start")), ["path", "line_start"])
        .select("qid", "term").join(asked, ["qid", "term"])
        .groupBy("qid").agg(F.sum("idf").alias("held"), F.max("idf").alias("most"))
    )
    return mass.join(held, "qid", "left").select(
        "qid",
        F.round(F.coalesce("held", F.lit(0.0)) / F.col("asked"), 9).alias("coverage"),
        F.round(F.coalesce(F.col("held") - F.col("most"), F.lit(0.0)), 9).alias("corroboration"),
    )


def reason(n_terms: Column, n_matched: Column, confidence: Column, tau: Column) -> Column:
    """Why a question gets no hits, in the fixed order; `ok` if it gets them."""
    return (
        F.when(n_terms == 0, "no-searchable-words")
        .when(n_matched == 0, "no-passage-matched")
        .when(confidence < tau, "below-threshold")
        .otherwise("ok")
    )


def combined(passage: DataFrame, file: DataFrame) -> DataFrame:
    """Half the passage score plus half its file's, each divided by the question's best.

    The best of a question is one aggregate row per question, not a window over its candidates. Files and best
    scores are written and counted: where they are small, no pair of question and passage is shuffled."""
    file = small_side(materialise(file, "file-scores"))
    both = passage.withColumnRenamed("score", "p").join(
        file.withColumnRenamed("score", "f"), ["qid", "path"]
    )
    most = both.groupBy("qid").agg(F.max("p").alias("pmax"), F.max("f").alias("fmax"))
    return both.join(small_side(materialise(most, "best-scores")), "qid").select(
        "qid", "path", "line_start",
        F.round(0.5 * F.col("p") / F.col("pmax") + 0.5 * F.col("f") / F.col("fmax"), 9).alias("score"),
    )
