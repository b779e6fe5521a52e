"""Hybrid file retrieval for a batch of questions: lexical list, dense list, fusion, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.formats import file_link, passage_link
from gleanery.functions.vectors import model_words, similarity
from gleanery.functions.words import squeeze_space
from gleanery.operators import dense, lexical, scoring
from gleanery.operators.fusion import rrf
from gleanery.operators.topk import top_k
from gleanery.params import NOTHING
from gleanery.plans.index import Index
from gleanery.plans.postings import bucket_of
from gleanery.session import materialise, small_side


#: Pairs of question and bag that a task scores at most: its memory hangs on them.
PAIRS_A_TASK = 1_000_000


def _has_words() -> Column:
    """At least one model token; false for a null question."""
    text = F.coalesce(F.col("question"), F.lit(""))
    return (squeeze_space(text) != "") & (F.size(model_words(text)) > 0)


def searchable(questions: DataFrame) -> DataFrame:
    """Questions with at least one model token; `unsearchable` has the others."""
    return questions.filter(_has_words())


def unsearchable(questions: DataFrame) -> DataFrame:
    """(qid, error) of the questions that `searchable` leaves out, so that none is lost unseen."""
    return questions.filter(~_has_words()).select("qid", F.lit(NOTHING).alias("error"))


def embedded(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, embedding) of each question."""
    return questions.select("qid", index.embedder.query(F.col("question")).alias("embedding"))


def _weights(index: Index, questions: DataFrame, unit: str, bags: int, buckets: int) -> DataFrame:
    """(qid, term, idf, bucket) of the asked terms, written once: stemming is the costly part of a question."""
    weights = lexical.weigh(lexical.query_terms(questions), index.table(f"{unit}_vocabulary"), F.lit(bags))
    return materialise(weights.withColumn("bucket", bucket_of(F.col("term"), buckets)), "weights")


def _tasks(weights: DataFrame, bags: int) -> int | None:
    """Tasks for scoring `bags` with the questions of `weights`; None where Spark's own number will do."""
    tasks = -(-bags * weights.select("qid").distinct().count() // PAIRS_A_TASK)
    return max(tasks, weights.sparkSession.sparkContext.defaultParallelism) if tasks > 1 else None


def file_scores(index: Index, questions: DataFrame) -> DataFrame:
    """Whole-file BM25 of every file that shares a term with a question."""
    postings, buckets = index.postings("file")
    weights = _weights(index, questions, "file", index.meta.files, buckets)
    return lexical.bm25(
        postings, weights, F.lit(index.meta.file_avgdl), ("path",), index.params, regroup=True,
        tasks=_tasks(weights, index.meta.files),
    )


def passage_scores(
    index: Index, questions: DataFrame, chosen: DataFrame | None = None
) -> DataFrame:
    """Passage BM25; `chosen` (qid, path) restricts the pairs scored, not the corpus statistics."""
    postings, buckets = index.postings("passage")
    weights = _weights(index, questions, "passage", index.meta.passages, buckets)
    return lexical.bm25(
        postings, weights, F.lit(index.meta.passage_avgdl), lexical.PASSAGE, index.params, regroup=True, chosen=chosen,
        tasks=_tasks(weights, index.meta.passages),
    )


def _best(index: Index, questions: DataFrame, unit: str, depth: int, chosen: DataFrame | None = None) -> DataFrame:
    """(qid, keys, score, rank): the first `depth` of each question, or of each question and chosen file, by BM25."""
    postings, buckets = index.postings(unit)
    bags, avgdl = (index.meta.files, index.meta.file_avgdl) if unit == "file" else (index.meta.passages, index.meta.passage_avgdl)
    keys = ("path",) if unit == "file" else lexical.PASSAGE
    groups = ["qid"] if chosen is None else ["qid", "path"]
    order = [F.desc("score"), *[F.asc(k) for k in keys if k not in groups]]
    weights = _weights(index, questions, unit, bags, buckets)
    batch = scoring.asked(weights, chosen)
    if batch:
        found = scoring.best(postings, weights, batch, avgdl, keys, index.params, depth, chosen, bags)
    else:  # a batch that is too large to send to every task
        found = lexical.bm25(
            postings, weights, F.lit(avgdl), keys, index.params, regroup=True, chosen=chosen, tasks=_tasks(weights, bags),
        )
    return top_k(found, groups, order, depth)


def best_files(index: Index, questions: DataFrame, depth: int) -> DataFrame:
    """(qid, path, score, rank): the first files of each question by whole-file BM25."""
    return _best(index, questions, "file", depth)


def best_passages(index: Index, questions: DataFrame, chosen: DataFrame, depth: int) -> DataFrame:
    """(qid, path, line_start, score, rank): the first passages of each chosen (qid, path) by BM25."""
    return _best(index, questions, "passage", depth, chosen)


def fused_files(index: Index, questions: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, path, score) of every file in either list."""
    emb = index.params.embedding
    lists = [
        best_files(index, questions, emb.fusion_depth),
        dense.file_dense(index.table("vectors"), queries, emb.fusion_depth),
    ]
    return rrf(lists, ["qid", "path"], emb.rrf_k, emb.fusion_depth)


def ranked_files(index: Index, questions: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(qid, path, score, rank) by (-score, path)."""
    fused = fused_files(index, questions, queries)
    return top_k(fused, ["qid"], [F.desc("score"), F.asc("path")], keep)


def shown_passages(
    index: Index, questions: DataFrame, queries: DataFrame, files: DataFrame
) -> DataFrame:
    """(qid, path, line_start, within, passage_rank): the passages shown of each ranked file."""
    emb = index.params.embedding
    chosen = files.select("qid", "path")
    lex = best_passages(index, questions, chosen, emb.fusion_depth)
    near = dense.within_files(index.table("vectors"), queries, chosen, emb.fusion_depth)
    fused = rrf([lex, near], ["qid", "path", "line_start"], emb.rrf_k, emb.fusion_depth)
    return top_k(
        fused.withColumnRenamed("score", "within"), ["qid", "path"],
        [F.desc("within"), F.asc("line_start")], index.params.per_file_cap, rank="passage_rank",
    )


def first_files(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, path, score, rank) of the files of the result, written once."""
    asked = searchable(questions)
    return materialise(ranked_files(index, asked, embedded(index, asked), index.params.top_k), "files")


def retrieve(index: Index, questions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The ranked result, one row per shown passage.

    (qid, rank, path, score, passage_rank, line_start, within). The ranked files of the batch are
    written once: three later steps read them and each would repeat the whole ranking. `files` are
    those of `first_files`, where they are at hand.
    """
    asked = searchable(questions)
    queries = embedded(index, asked)
    files = first_files(index, questions) if files is None else files
    shown = shown_passages(index, asked, queries, files)
    return files.join(shown, ["qid", "path"]).select(
        "qid", "rank", "path", "score", "passage_rank", "line_start", "within"
    )


def with_text(index: Index, results: DataFrame) -> DataFrame:
    """Add the passage fields and both links to a result. The result is the small side."""
    fields = index.table("passages").select(
        "path", "line_start", "line_end", "heading_path", "text"
    )
    repo, commit = index.meta.repo, index.meta.commit
    return (
        fields.join(small_side(results), ["path", "line_start"])
        .withColumn("file_url", file_link(repo, commit, F.col("path")))
        .withColumn("url", passage_link(
            repo, commit, F.col("path"), F.col("line_start"), F.col("line_end")
        ))
    )


def top_scores(index: Index, questions: DataFrame) -> DataFrame:
    """(qid, top_score): the best similarity over every passage of the index."""
    best = dense.top_similarity(index.table("vectors"), embedded(index, searchable(questions)))
    return best.select("qid", similarity(F.col("top_dot")).alias("top_score"))


def ranking_mode(index: Index, reranked: bool = False) -> str:
    emb = index.params.embedding
    if not reranked:
        return f"file-rrf-v1:hybrid:{emb.model}@{emb.revision}"
    from gleanery.params import DEFAULT_RERANK as rr

    return (
        f"file-rerank-v1:hybrid:{emb.model}@{emb.revision}"
        f"+ce:{rr.model}@{rr.revision}:n{rr.candidates}"
    )
