"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is 13 consecutive words of a benchmark item; an item of fewer words is one window. For windows
of t words, every run of w = t - k + 1 consecutive k-word hashes has its smallest value kept (k is 5, or
t if that is less). A text that holds a whole window holds that run, so it keeps the same value: joining
the kept values of texts and items finds every pair that shares a window, with about 2 / (w + 1) of the
values. Each hit is then extended: all windows of those texts are compared with the items' windows, and
the words inside any occurrence are counted once, overlapping windows merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import at_most, materialise, small_side

WINDOW = 13
GRAM = 5
# Everything in ASCII that is no letter or digit separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts that still have capitals.
UNFOLDED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column, separators: str = SEPARATORS) -> Column:
    """The words of a text that is lower-cased already; an empty text has none."""
    return F.filter(F.split(text, separators), lambda x: x != "")


def folded(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)


def window_hashes(array: str, t: int) -> Column:
    """A hash of each run of t words of the array column, in order."""
    grams = F.transform(
        F.col(array), lambda x, i: F.xxhash64(F.lit(t), x, *(F.get(F.col(array), i + k) for k in range(1, t)))
    )
    return F.slice(grams, F.lit(1), F.greatest(F.size(array) - (t - 1), F.lit(0)))


def kept(df: DataFrame, array: str, t: int, out: str) -> DataFrame:
    """Adds the distinct winnowed values of windows of t words.

    Whoever explodes them takes explode_outer: explode() has a filter on the array's size pushed below
    the projections, where it would compute the inner arrays again for every element.
    """
    k = min(GRAM, t)
    w = t - k + 1
    df = df.withColumn("_grams", window_hashes(array, k))
    if w > 1:
        least = F.transform(
            F.col("_grams"), lambda x, i: F.least(x, *(F.get(F.col("_grams"), i + j) for j in range(1, w)))
        )
        least = F.slice(least, F.lit(1), F.greatest(F.size("_grams") - (w - 1), F.lit(0)))
    else:
        least = F.col("_grams")
    # the window's length is part of the value
    return df.withColumn(out, F.transform(F.array_distinct(least), lambda x: F.xxhash64(F.lit(t), x))).drop("_grams")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    share: int = 20,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, items) for each row of `docs`.

    contaminated: n_hit > 0 and share * n_hit >= n_words. One row for each input row: repeated rows and
    null ids each get their own result, told apart by id and text. Null and empty texts have no words.
    Items without words or without an id have no windows; rows that share an item id are one item.
    Other columns of either table are ignored.
    """
    docs = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_key", F.xxhash64("text"))
    items = (
        items.select(F.col(item_col).cast("string").alias("item_id"), words(folded(F.col(item_text))).alias("words"))
        .filter(F.col("item_id").isNotNull() & (F.size("words") > 0))
        .withColumn("t", F.least(F.size("words"), F.lit(WINDOW)))
    )
    items = materialise(items, "items")
    lengths = sorted(r[0] for r in items.select("t").distinct().collect())  # thirteen at most
    n_words = F.size(words(F.col("text"), UNFOLDED))  # counting needs no folding
    if not lengths:
        hits = None
    else:
        hits = _hits(docs, items, lengths)
    base = docs.select("doc_id", "text_key", n_words.cast("long").alias("n_words"))
    if hits is None:
        out = base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    else:
        spans = materialise(hits, "spans")
        spans = F.broadcast(spans) if at_most(spans, 100_000) else spans
        s = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_hit", "items")
        out = base.join(s, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


def _hits(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, n_hit, items) of texts with windows of items."""
    wins = _all([
        items.filter(F.col("t") == t).select(
            "item_id", F.lit(t).alias("t"), F.explode_outer(F.array_distinct(window_hashes("words", t))).alias("h")
        )
        for t in lengths
    ])
    wins = wins.groupBy("h").agg(F.first("t").alias("t"), F.collect_set("item_id").alias("ids"))

    found = docs.select("doc_id", "text_key", words(folded(F.col("text"))).alias("words"))
    low_prints = _all([
        kept(items.filter(F.col("t") == t), "words", t, "p").select(F.explode_outer("p").alias("p")) for t in lengths
    ]).distinct()
    names = []
    for t in lengths:
        found = kept(found, "words", t, f"p{t}")
        names.append(f"p{t}")
    values = F.concat(*names) if len(names) > 1 else F.col(names[0])
    found = found.select("doc_id", "text_key", F.explode_outer(values).alias("p"))
    low_prints = materialise(low_prints, "prints")
    met = found.join(small_side(low_prints), "p", "left_semi").select("doc_id", "text_key").distinct()
    met = materialise(met, "met").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    texts = docs.join(
        small_side(met), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi"
    )
    texts = texts.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", words(folded(F.col("text"))).alias("words"))
    places = _all([
        texts.select("doc_id", "text_key", F.posexplode_outer(window_hashes("words", t)).alias("at", "h")) for t in lengths
    ])
    places = places.join(small_side(materialise(wins, "windows")), "h")
    before = Window.partitionBy("doc_id", "text_key").orderBy("at", "t").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("t")
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    new = F.greatest(end - F.greatest("at", reached), F.lit(0))
    places = places.select("doc_id", "text_key", "ids", new.alias("new"))
    return places.groupBy("doc_id", "text_key").agg(
        F.sum("new").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
