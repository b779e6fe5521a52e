"""Quality rules: a few counted rules, then a logistic regression on hashed word and character n-grams.

The counts of a text (short words, symbols, repeated lines, repeated eight-word windows) fail what is plainly
junk. Every other text is judged by a logistic regression over hashed features: words, pairs of words and
runs of four characters, each text's counts damped by a logarithm and scaled to length one by kind. It is
fitted by Adagrad on labelled quality rows; a part of them that it has not seen turns its scores into
probabilities (a logistic curve with the sampling undone), which are held against a fixed threshold.

Everything is counted over Arrow batches in numpy, one pass over the documents. 64-bit hashes stand for words,
lines and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.neighbours import held_out
from gleanery.llm.session import attach, tidy
from gleanery.llm.textnum import NOT_NEWLINE, PLACES, SOLID, U, Piece, mix, pieces
from gleanery.session import materialise, small_side

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
LEAST_WORDS, MOST_REPEATED = 20, 30
#: A text is kept if the probability of label 1 reaches this.
THRESHOLD = 0.3
#: Features by kind (a power of two each), and characters in a run.
BITS, KINDS, RUN = 16, 3, 4
#: Labelled rows of each class that the regression is fitted on, about; rows are taken by a hash of their id.
LEARN_ROWS = 3_000
#: One in so many of them is left for the calibration.
CALIBRATE = 4
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.3, 1e-5
WIDTH = KINDS << BITS
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _twice(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether its text has it elsewhere too, and whether it had it before."""
    order = np.lexsort((values, owner))
    same = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again, before = np.zeros(len(values), bool), np.zeros(len(values), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    before[order[1:]] = same
    return again, before


def _counts(piece: Piece, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    bounds = piece.bounds(owner)
    solid = SOLID[piece.data]
    begins = (piece.data & 0xC0) != 0x80
    lines = piece.spans(NOT_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = filled[lines[1]] > filled[lines[0]]
    a, b, of = (x[full] for x in lines)
    _, before = _twice(piece.hashes(a, b, fold=False), of)
    covered = np.zeros(len(words), bool)
    if len(words) >= WINDOW:
        n = len(words) - WINDOW + 1
        whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        rolled = np.zeros(n, U)
        for k in range(WINDOW):
            rolled += words[k : n + k] * PLACES[k]
        again, _ = _twice(mix(rolled[whole]), owner[whole])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, whole[again], 1)
        np.add.at(edge, whole[again] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
    return np.column_stack([
        np.diff(bounds),
        _sums(solid & begins, piece.offsets),
        _sums(SYMBOLS[piece.data], piece.offsets),
        _sums(before, piece.bounds(of)),
        _sums(covered, bounds),
    ])


def _features(piece: Piece, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, weight) of each feature of each text, by text."""
    shift = U(64 - BITS)
    keys = [mix(words) >> shift]
    owners = [owner]
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    keys.append((mix(words[inside] * PLACES[1] + words[inside + 1] * PLACES[2]) >> shift) + U(1 << BITS))
    owners.append(owner[inside])
    at = np.flatnonzero((piece.data & 0xC0) != 0x80)
    text = np.searchsorted(piece.offsets[1:], at, side="right")
    if len(at) > RUN:
        # a character is a run of bytes; four of them and the start of the fifth give the run's bytes
        whole = np.flatnonzero(text[: len(at) - RUN + 1] == text[RUN - 1 :])
        stop = np.append(at, len(piece.data))[whole + RUN]
        keys.append((piece.hashes(at[whole], stop) >> shift) + U(2 << BITS))
        owners.append(text[whole])
    key = np.concatenate(owners).astype(np.int64) * WIDTH + np.concatenate(keys).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    of, feature = np.divmod(key, WIDTH)
    value = 1 + np.log(count)
    group = of * KINDS + (feature >> BITS)
    norm = np.sqrt(np.bincount(group, value * value, len(piece) * KINDS))
    return of, feature, value / norm[group]


def measure(column: pa.Array, weights: np.ndarray | None = None) -> Iterator[tuple]:
    """For each piece of a column: counts by text, and the features, or with `weights` the scores."""
    for piece in pieces(column):
        starts, ends, owner = piece.spans(SOLID)
        words = piece.hashes(starts, ends, fold=False)
        counts = _counts(piece, starts, ends, owner, words)
        # features fold capitals: these words are hashed again
        of, feature, value = _features(piece, owner, piece.hashes(starts, ends))
        if weights is None:
            yield counts, (of, feature, value)
        else:
            yield counts, weights[-1] + np.bincount(of, value * weights[feature], len(piece))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weights of the features, and last the constant, by Adagrad over mini-batches in a fixed order."""
    w, seen = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-6)
    draw = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            part = order[first : first + BATCH]
            feature = np.concatenate([rows[k][0] for k in part])
            value = np.concatenate([rows[k][1] for k in part])
            of = np.repeat(np.arange(len(part)), [len(rows[k][0]) for k in part])
            z = w[-1] + np.bincount(of, value * w[feature], len(part))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            slope = np.bincount(feature, error[of] * value, WIDTH)
            at = np.flatnonzero(slope)
            slope = slope[at] / len(part) + DECAY * w[at]
            seen[at] += slope * slope
            w[at] -= RATE * slope / np.sqrt(seen[at])
            seen[-1] += error.mean() ** 2
            w[-1] -= RATE * error.mean() / np.sqrt(seen[-1])
    return w


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve of y on z, by Newton steps, held near 1 and 0 by a prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = weight * p * (1 - p)
        g = np.array([(weight * (p - y) * z).sum() + (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the labelled rows of one task: one row of weights, slope and constant."""
    rows, y, late, weight = [], [], [], []
    for batch in batches:
        y += batch.column("y").to_pylist()
        late += batch.column("late").to_pylist()
        weight += batch.column("weight").to_pylist()
        for f, v in zip(batch.column("feature"), batch.column("value")):
            rows.append((f.values.to_numpy(), v.values.to_numpy()))
    y, late, weight = np.array(y, float), np.array(late, bool), np.array(weight, float)
    if len(set(y[~late].tolist())) < 2:  # nothing to tell apart
        return
    w = fit([r for r, l in zip(rows, late) if not l], y[~late])
    z = np.array([w[-1] + (w[f] * v).sum() for (f, v), l in zip(rows, late) if l])
    a, b = calibrate(z, y[late], weight[late] / weight.mean()) if late.any() else (1.0, 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([a]), pa.array([b])], names=["w", "a", "b"])


def _sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, modulus: int, remainder: int) -> DataFrame:
    """(y, late, weight, text) of about LEARN_ROWS labelled documents of each class, one of each id."""
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .filter(~held_out(F.col("doc_id"), modulus, remainder))
    )
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("y").alias("n")).collect()}
    share = {y: min(1.0, LEARN_ROWS / n.get(y, 1)) for y in (0, 1)}
    spot = F.pmod(F.xxhash64(F.lit("rules"), F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)
    taken = known.filter(spot < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    found = docs.join(small_side(taken), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    late = F.pmod(F.xxhash64(F.lit("late"), F.col("doc_id").cast("string")), F.lit(CALIBRATE)) == 0
    return found.select("y", late.alias("late"), F.when(F.col("y") == 1, 1 / share[1]).otherwise(1 / share[0]).alias("weight"), "text")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 5,
    remainder: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept, held_out).

    One row for each input row, repeated rows and null ids included; other columns are not carried along. A
    null text counts as empty: no words, so it fails. `score` is the probability of label 1. Labels of ids whose
    crc32 leaves `remainder` are never learned; labels that are null or neither 0 nor 1 are passed over, and of
    several for an id the larger counts. Without labels of both classes every score is 0.5. `labels` needs the
    id column under the same name.
    """
    spark = attach(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for counts, (of, feature, value) in measure(batch.column("text")):
                cuts = pa.array(np.searchsorted(of, np.arange(len(counts) + 1)), pa.int32())
                part = batch.slice(first, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("y"), part.column("late"), part.column("weight"),
                        pa.ListArray.from_arrays(cuts, pa.array(feature, pa.int32())),
                        pa.ListArray.from_arrays(cuts, pa.array(value, pa.float32())),
                    ],
                    names=["y", "late", "weight", "feature", "value"],
                )
                first += len(counts)

    sample = _sample(docs, labels, label, id_col, modulus, remainder)
    schema = "y int, late boolean, weight double, feature array<int>, value array<float>"
    rows = materialise(sample.mapInArrow(tidy(features), schema), "rule-features")
    # sorted, so that the fit doesn't depend on how the rows lie
    rows = rows.repartition(1).sortWithinPartitions("y", "late", F.size("feature"), F.xxhash64("feature", "value"))
    model = rows.mapInArrow(tidy(_learn), "w binary, a double, b double").first()
    weights = np.frombuffer(model["w"], np.float32).copy() if model else np.zeros(WIDTH + 1, np.float32)
    slope, constant = (model["a"], model["b"]) if model else (1.0, 0.0)
    sent = spark.sparkContext.broadcast(weights)  # of a fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(measure(batch.column("text"), sent.value))
            counts = np.concatenate([c for c, _ in got]) if got else np.zeros((0, len(COUNTS)), np.int64)
            z = np.concatenate([z for _, z in got]) if got else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(slope * z + constant, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.T), pa.array(score)],
                names=["doc_id", *COUNTS, "score"],
            )

    out = docs.mapInArrow(tidy(judge), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select(
        F.col("doc_id").alias(id_col), *COUNTS, failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= THRESHOLD)).alias("kept"),
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
    )
