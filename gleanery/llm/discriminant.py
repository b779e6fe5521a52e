"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives some twenty numbers (lengths, shares of kinds of characters, repetition of words, pairs
of words and lines), bent by logarithms and logits towards a bell shape. Each class has a mean and a
covariance, shrunk towards the pooled one and a multiple of the identity; its Cholesky factor is computed
once and cached. A text's score is the difference of the two log densities, from Mahalanobis distances
by triangular solves, turned into a rate by a monotone fit on the labelled rows.

Class sums are taken by Spark over all labelled rows to learn from; only sums of fixed size reach the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.neighbours import held_out
from gleanery.llm.session import attach, tidy
from gleanery.llm.textnum import ALNUM, NOT_NEWLINE, PLACES, SOLID, mix, pieces
from gleanery.session import materialise

#: Share of the pooled covariance in each class's own, and of the mean variance on the diagonal.
SHRINK, RIDGE = 0.15, 0.02
#: Cells of the histogram of log-density differences from which rates are fitted.
CELLS = 400
#: Differences beyond this are equal.
WIDEST = 400.0
THRESHOLD = 0.3

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[44, 46]] = True
MARK = ~(ALNUM | STOP | ~SOLID)
KINDS = [UPPER, DIGIT, STOP, MARK, ~NOT_NEWLINE, np.arange(256) >= 128]

NAMES = [
    "bytes", "words", "word_length", "upper", "digits", "stops", "marks", "newlines", "other_scripts",
    "distinct_words", "repeats", "distinct_pairs", "top_word", "marked_words", "upper_words", "lone_marks",
    "distinct_lines", "words_a_line", "long_words", "short_words",
]


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The log odds of a share, half a count added to both sides."""
    return np.log((part + 0.5) / (whole - part + 0.5))


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    parts = [_statistics(piece) for piece in pieces(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values, count of the most frequent one) of each text."""
    n, top = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            own = np.sort(values[a:b])
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            n[k], top[k] = len(cuts) - 1, np.diff(cuts).max()
    return n, top


def _statistics(piece) -> np.ndarray:
    size = np.diff(piece.offsets)
    counts = [_sums(kind[piece.data], piece.offsets) for kind in KINDS]
    letters = _sums(LETTER[piece.data], piece.offsets)
    starts, ends, owner = piece.spans(SOLID)
    bounds = piece.bounds(owner)
    words = np.diff(bounds)
    hashes = piece.hashes(starts, ends)
    distinct, top = _distinct(hashes, bounds)
    same = np.zeros(len(hashes), bool)
    pairs = hashes.copy()
    if len(hashes) > 1:
        inside = owner[1:] == owner[:-1]
        same[1:] = inside & (hashes[1:] == hashes[:-1])
        pairs[1:] = np.where(inside, mix(hashes[:-1] * PLACES[0] + hashes[1:] * PLACES[1]), hashes[1:])
    distinct_pairs, _ = _distinct(pairs, bounds)
    # marks and capitals by word
    def by_word(table):
        total = np.concatenate([[0], np.cumsum(table[piece.data], dtype=np.int64)])
        return total[ends] - total[starts]

    marks, upper, length = by_word(MARK), by_word(UPPER), ends - starts
    solid = by_word(ALNUM)
    each = lambda flags: _sums(flags, bounds)
    lines = piece.spans(NOT_NEWLINE)
    line_bounds = piece.bounds(lines[2])
    n_lines = np.diff(line_bounds)
    distinct_lines, _ = _distinct(piece.hashes(lines[0], lines[1], fold=False), line_bounds)
    return np.column_stack([
        np.log1p(size),
        np.log1p(words),
        np.log((_sums(length, bounds) + 1) / (words + 1)),
        _logit(counts[0], np.maximum(letters, counts[0])),
        *(_logit(c, size) for c in counts[1:]),
        _logit(distinct, words),
        _logit(each(same), words),
        _logit(distinct_pairs, words),
        _logit(top, words),
        _logit(each(marks > 0), words),
        _logit(each(upper > 1), words),
        _logit(each(solid == 0), words),
        _logit(distinct_lines, n_lines),
        np.log((words + 1) / (n_lines + 1)),
        _logit(each(length > 14), words),
        _logit(each(length < 4), words),
    ])


@dataclass
class Discriminant:
    """Two classes, each with its mean and the Cholesky factor of its shrunk covariance."""

    means: np.ndarray
    factors: list[np.ndarray]
    offsets: np.ndarray
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.full(1, 0.5)))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 over class 0, with the classes' shares."""
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(offset - 0.5 * (z * z).sum(axis=0))
        return np.clip(logs[1] - logs[0], -WIDEST, WIDEST)

    def rate(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.difference(x), *self.curve)


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
    """The classes from their counts, sums and sums of products."""
    means = sums / n[:, None]
    own = [q / c - np.outer(m, m) for q, c, m in zip(squares, n, means)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / n.sum()
    width = len(pooled)
    factors, offsets = [], []
    for cov, c in zip(own, n):
        weight = (c + 0.0) / (c + width)  # fewer rows than numbers: closer to the pooled one
        cov = (1 - SHRINK) * weight * cov + (1 - (1 - SHRINK) * weight) * pooled
        cov = (1 - RIDGE) * cov + RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-3))
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        offsets.append(np.log(c / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, factors, np.array(offsets))


def rates(middle: np.ndarray, ones: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of label rates to log-density differences, ends kept off 0 and 1."""
    base = (ones.sum() + 0.5) / (total.sum() + 1.0)
    blocks: list[list[float]] = []
    for x, k, n in zip(middle, ones, total):
        if n:
            blocks.append([float(k), float(n), x * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    if not blocks:
        return np.zeros(1), np.array([base])
    x = np.array([b[2] / b[1] for b in blocks])
    y = np.maximum.accumulate([(b[0] + base) / (b[1] + 1.0) for b in blocks])
    # beyond the outer knots the rate still moves a little, so that order is kept
    return (
        np.concatenate([[min(-WIDEST, x[0]) - 1], x, [max(WIDEST, x[-1]) + 1]]),
        np.concatenate([[y[0] * 0.5], y, [1 - (1 - y[-1]) * 0.5]]),
    )


def quality(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 5,
    remainder: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, held_out, score, predicted) for each row of `docs`; score is the rate of label 1.

    Learns from all labelled rows whose crc32 of the id as text does not leave `remainder`. One output row
    for each input row, repeated rows and null ids included; a null text counts as empty and is scored. If
    a class has no labelled rows, every score is the smoothed rate of label 1 (0.5 without labels). Labels
    that are null or neither 0 nor 1 are passed over; of several for an id the larger counts.
    """
    spark = attach(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    measured = materialise(docs.mapInArrow(tidy(measure), f"doc_id {kind}, x array<double>"), "statistics")
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .filter(~held_out(F.col("doc_id"), modulus, remainder))
    )
    learned = materialise(measured.join(known, "doc_id").select("y", "x"), "learned")
    width = len(NAMES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            y = batch.column("y").to_numpy()
            x = _matrix(batch.column("x"))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        place = np.tile(np.arange(total.shape[1]), 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], total.shape[1])), pa.array(place), pa.array(total.ravel())],
            names=["y", "place", "value"],
        )

    sums = np.zeros((2, 1 + width + width * width))
    rows = learned.mapInArrow(tidy(add), "y long, place long, value double").groupBy("y", "place").agg(F.sum("value").alias("v"))
    for r in rows.collect():
        sums[r["y"], r["place"]] = r["v"]
    n = sums[:, 0]
    if n.min() >= 2:
        model = fit(n, sums[:, 1 : 1 + width], sums[:, 1 + width :].reshape(2, width, width))
        model.curve = _curve(learned, spark.sparkContext.broadcast(model))
    else:
        rate = (n[1] + 0.5) / (n.sum() + 1.0)
        model = None
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.full(len(batch), rate) if sent.value is None else sent.value.rate(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    out = measured.mapInArrow(tidy(score), f"doc_id {kind}, score double")
    return out.select(
        F.col("doc_id").alias(id_col),
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _curve(learned: DataFrame, sent) -> tuple[np.ndarray, np.ndarray]:
    """Rates by cells of the log-density difference, cells finer around 0."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.arcsinh(sent.value.difference(_matrix(batch.column("x"))))
            at = np.clip(np.floor((z / np.arcsinh(WIDEST) + 1) / 2 * CELLS), 0, CELLS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["cell", "y"])

    ones, total = np.zeros(CELLS), np.zeros(CELLS)
    rows = learned.mapInArrow(tidy(cell), "cell long, y int").groupBy("cell").agg(F.sum("y").alias("k"), F.count("y").alias("n"))
    for r in rows.collect():
        ones[r["cell"]], total[r["cell"]] = r["k"], r["n"]
    middle = np.sinh(((np.arange(CELLS) + 0.5) / CELLS * 2 - 1) * np.arcsinh(WIDEST))
    return rates(middle, ones, total)
