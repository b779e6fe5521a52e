"""Second-stage ranking: the shown passages of the first files, scored in pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.vectors import model_words
from gleanery.functions.words import model_text
from gleanery.operators.topk import top_k
from gleanery.params import DEFAULT_RANK, RankParams


def token_overlap(question: Column, passage: Column) -> Column:
    """Offline scorer: how many distinct words the two share."""
    shared = F.array_intersect(model_words(question), model_words(passage))
    return F.size(shared).cast("double")


def finite(score: Column) -> Column:
    """The score, or an error if it is no finite number."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("the reranker returned a non-finite score")).cast("double")).otherwise(score)


def rerank(
    questions: DataFrame,
    shown: DataFrame,
    scorer: Callable[[Column, Column], Column] = token_overlap,
    params: RankParams = DEFAULT_RANK,
) -> DataFrame:
    """(qid, path, score, first_rank, rank): best pair score per file, by (-score, first rank).

    `shown` holds only the first `candidates` files of each question, with the passage text.
    """
    text = model_text(F.col("text"), F.col("heading_path"))
    pairs = shown.join(questions, "qid").select(
        "qid", "path", F.col("rank").alias("first_rank"),
        finite(scorer(F.col("question"), text)).alias("pair"),
    )
    best = pairs.groupBy("qid", "path", "first_rank").agg(F.max("pair").alias("score"))
    return top_k(best, ["qid"], [F.desc("score"), F.asc("first_rank")], params.top_k)


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
