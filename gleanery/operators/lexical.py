"""Bags of terms and BM25 over them, for whole batches of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.porter import stem_counts, stem_words
from gleanery.functions.words import body_text, path_stem, s_stem, words
from gleanery.operators.topk import top_k
from gleanery.params import DEFAULT_RANK, RankParams
from gleanery.session import small_side

PASSAGE = ("path", "line_start")
SCORE_DIGITS = 9  # scores are ranked at this precision: sums arrive in any order


def _stem_plain(tokens: Column) -> Column:
    return F.transform(tokens, s_stem)


STEMMERS = {
    "porter-1980": stem_words,
    "s-stemmer": _stem_plain,
    "none": lambda tokens: tokens,
}


def tokens_of(text: Column, stemmer: str = "porter-1980") -> Column:
    """Tokenise: fold case, take runs of letters and digits, drop stopwords, stem."""
    return STEMMERS[stemmer](words(text))


def passage_words(params: RankParams = DEFAULT_RANK) -> Column:
    """Unstemmed words of a passage with its heading trail and path repeated by weight."""
    head = words(F.array_join("heading_path", " "))
    trail = words(path_stem(F.col("path")))
    parts = [words(body_text(F.col("text"), F.col("heading_path")))]
    parts += [head] * params.heading_weight + [trail] * params.path_weight
    return F.concat(*parts)


def bag_texts(passages: DataFrame, params: RankParams = DEFAULT_RANK) -> DataFrame:
    """(path, line_start, first, body, extra) of passages with a path: the words of `first` and `body` are those of
    the passage's text, which its file counts, and those of `body` and `extra` the ones of `passage_words`, with
    `extra` null where they are."""
    text, below = F.coalesce("text", F.lit("")), F.locate("\n", F.col("text"))
    cut = F.when(below > 0, F.substring_index("text", "\n", 1)).otherwise(text)
    parts = [F.array_join("heading_path", " ")] * params.heading_weight + [path_stem(F.col("path"))] * params.path_weight
    extra = F.concat(F.lit(""), *[p for part in parts for p in (part, F.lit(" "))])
    return passages.filter(F.col("path").isNotNull()).select(
        *PASSAGE, F.when(F.size("heading_path") > 0, cut).otherwise("").alias("first"),
        F.coalesce(body_text(F.col("text"), F.col("heading_path")), F.lit("")).alias("body"),
        F.when(F.col("text").isNotNull(), extra).alias("extra"),
    )


def _counted(rows: DataFrame, keys: Sequence[str], stemmer: str) -> DataFrame:
    """(keys, dl, term, tf) from rows with a `_words` array."""
    if stemmer == "porter-1980":
        pairs = stem_counts("_words")
        return rows.select(*keys, F.size("_words").alias("dl"), F.explode(pairs).alias("p")).select(
            *keys, "dl", "p.term", "p.tf"
        )
    stemmed = rows.select(
        *keys, F.size("_words").alias("dl"), F.explode(STEMMERS[stemmer](F.col("_words"))).alias("term")
    )
    return stemmed.groupBy(*keys, "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def passage_bags(
    passages: DataFrame, params: RankParams = DEFAULT_RANK, stemmer: str = "porter-1980"
) -> DataFrame:
    """Postings (path, line_start, dl, term, tf). With Porter this is a narrow map: no shuffle."""
    rows = passages.select(*PASSAGE, passage_words(params).alias("_words"))
    return _counted(rows, PASSAGE, stemmer)


def file_bags(
    passages: DataFrame, params: RankParams = DEFAULT_RANK, stemmer: str = "porter-1980"
) -> DataFrame:
    """Postings (path, term, tf). Words are counted per passage, then summed map-side per file, so a
    file holding much of the corpus is spread over its terms."""
    body = _counted(
        passages.select("path", words(F.col("text")).alias("_words")), ("path",), stemmer
    ).drop("dl")
    names = passages.select("path").distinct().select(
        "path", words(path_stem(F.col("path"))).alias("_words")
    )
    named = _counted(names, ("path",), stemmer).select(
        "path", "term", (F.col("tf") * params.path_weight).alias("tf")
    )
    return body.unionByName(named).groupBy("path", "term").agg(F.sum("tf").alias("tf"))


def lengths(bags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bag length of every bag that has a term: the sum of its counts."""
    return bags.groupBy(*keys).agg(F.sum("tf").alias("dl"))


def corpus_stats(bags: DataFrame, units: DataFrame) -> DataFrame:
    """One row: bags (one per row of `units`, empty ones too), total and average length."""
    counted = units.agg(F.count(F.lit(1)).alias("n_bags"))
    total = F.coalesce(bags.agg(F.sum("tf")).scalar(), F.lit(0))
    average = F.when(F.col("n_bags") > 0, total / F.col("n_bags")).otherwise(F.lit(0.0))
    return counted.select("n_bags", total.alias("total_dl"), average.alias("avgdl"))


def document_frequency(bags: DataFrame) -> DataFrame:
    return bags.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def query_terms(questions: DataFrame, stemmer: str = "porter-1980") -> DataFrame:
    """(qid, term): each distinct term of each question once."""
    tokens = F.array_distinct(tokens_of(F.col("question"), stemmer))
    return questions.select("qid", F.explode(tokens).alias("term"))


def weigh(terms: DataFrame, vocabulary: DataFrame, n_bags: Column) -> DataFrame:
    """(qid, term, idf) of the asked terms the corpus knows. The asked side is the small one."""
    return small_side(terms).join(vocabulary, "term").select(
        "qid", "term", idf(n_bags, F.col("df")).alias("idf")
    )


def bm25(
    bags: DataFrame,
    weights: DataFrame,
    avgdl: Column,
    keys: Sequence[str],
    params: RankParams = DEFAULT_RANK,
    regroup: bool = False,
    chosen: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """(qid, keys, score) for every bag sharing a term with a question.

    With `regroup` the matching postings are placed by bag first, so that scoring and the local
    top-k need no further shuffle and only the survivors travel; `tasks` says to how many tasks, since
    Spark sees the size of the postings but not that of the scores they grow to. `chosen` (qid, path) leaves out
    every other pair before anything is summed. Where bags and weights both have a `bucket`, they are
    joined on it too, and a scan of the bags reads the buckets of the weights alone.
    """
    on = [c for c in ("bucket", "term") if c in bags.columns and c in weights.columns]
    # an idf is positive: the filter only tells the optimiser that this side is worth pruning by
    weights = small_side(weights).filter(F.col("idf") > 0)
    if chosen is not None:
        chosen = small_side(chosen)
        bags = bags.join(chosen.select("path").distinct(), "path", "left_semi")
    if regroup:
        asked = bags.join(weights, on, "left_semi")
        bags = asked.repartition(*([tasks] if tasks else []), *[F.col(k) for k in keys])
    norm = params.k1 * (1 - params.b + params.b * F.col("dl") / avgdl)
    part = F.col("idf") * F.col("tf") * (params.k1 + 1) / (F.col("tf") + F.col("_norm"))
    matched = bags.withColumn("_norm", norm).join(weights, on)
    if chosen is not None:
        matched = matched.join(chosen, ["qid", "path"], "left_semi")
    return (
        matched.withColumn("_part", part)
        .groupBy("qid", *keys)
        .agg(F.round(F.sum("_part"), SCORE_DIGITS).alias("score"))
        .filter(F.col("score") > 0)
    )


def ranked_passages(scores: DataFrame, depth: int) -> DataFrame:
    """Best passages of each question by (-score, path, line_start)."""
    order = [F.desc("score"), F.asc("path"), F.asc("line_start")]
    return top_k(scores, ["qid"], order, depth)


def ranked_files(scores: DataFrame, depth: int) -> DataFrame:
    """Best files of each question by (-score, path)."""
    return top_k(scores, ["qid"], [F.desc("score"), F.asc("path")], depth)
