"""Language-model scores: a gated recurrent network with class-factored output, in numpy.

Word counts of all documents to learn from give the base probabilities. The most frequent words form
classes; the network, reading the words so far, predicts the class and then the word in it, and one more
class stands for all other words, which share it by their base probabilities. It starts as the base
model (its biases are the words' frequencies) and is trained by backpropagation truncated to windows,
the state carried from window to window: in each round every task trains on its part of a share of the
documents, and the weights are averaged. The shares of all rounds together are every document, each once. A document's score carries the state through the whole text.

Words beyond a bounded table of frequent ones are joined with their counts by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.neighbours import held_out
from gleanery.llm.session import attach, tidy
from gleanery.llm.textnum import SOLID, U, pieces, signed
from gleanery.session import materialise

#: Frequent words sent to every executor with their counts: 16 bytes each.
TABLE = 1_000_000
CLASSES, WORDS_A_CLASS, HIDDEN = 40, 40, 16
#: Training: rounds, each on another share of the documents, together all; streams, window, step size.
ROUNDS, STREAMS, WINDOW, RATE = 2, 96, 16, 0.08
#: Slopes are cut off beyond this.
STEEPEST = 0.1
#: Steps, and states, that are held before their outputs are computed.
HELD_STEPS, HELD_STATES = 96, 60_000
#: Words of documents that are scored together: the longest documents of one batch alone leave steps of few documents.
HELD_TOKENS = 4_000_000
#: Hashes a task holds while counting.
HELD_WORDS = 3_000_000
#: The end of a document, as a word; no word has this hash by more than chance.
END = U(0x5E2D58D8B3BCDEE5)
#: Weights averaged by one task.
FAN_IN = 32


@dataclass
class Network:
    """Weights. A word is (class, place); the input table has a row for each word, other words, the start."""

    inputs: np.ndarray
    state: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def fresh(cls, shares: np.ndarray, other: float, seed: int = 3) -> Network:
        """The base model: `shares` of the predicted words in order of frequency, `other` of the rest."""
        rng = np.random.default_rng(seed)
        full = np.zeros(CLASSES * WORDS_A_CLASS)
        full[: len(shares)] = shares
        full = full.reshape(CLASSES, WORDS_A_CLASS)
        by_class = np.append(full.sum(axis=1), other)
        with np.errstate(divide="ignore"):
            class_bias = np.maximum(np.log(by_class), -60.0)
            word_bias = np.maximum(np.log(full), -60.0)
        small = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        return cls(
            small(CLASSES * WORDS_A_CLASS + 2, 3 * HIDDEN),
            small(HIDDEN, 3 * HIDDEN),
            np.zeros((HIDDEN, CLASSES + 1), np.float32),
            class_bias.astype(np.float32),
            np.zeros((CLASSES, HIDDEN, WORDS_A_CLASS), np.float32),
            word_bias.astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def packed(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpacked(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def step(self, h: np.ndarray, word: np.ndarray, keep: bool = False):
        """The state after reading `word`; with `keep` also what the way back needs."""
        new, back = _gated(h, _thirds(self.inputs[word]), _thirds(self.state))
        return (new, (h, word, *back)) if keep else new

    def log_shares(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each word (of its class, for other words)."""
        scores = states @ self.to_class + self.class_bias
        kind = np.minimum(words // WORDS_A_CLASS, CLASSES)
        out = scores[np.arange(len(words)), kind]
        out -= _log_sum(scores)
        rows, classes = _by_class(kind)
        scores = self._in_class(states[rows], classes)
        near = scores[np.arange(len(rows)), words[rows] % WORDS_A_CLASS]
        near -= _log_sum(scores)
        out[rows] += near
        return out

    def _in_class(self, states: np.ndarray, classes: list[tuple[int, slice]]) -> np.ndarray:
        """Scores of the words of each state's class; the states lie in order of their classes."""
        out = np.empty((len(states), WORDS_A_CLASS), states.dtype)
        for c, at in classes:
            np.matmul(states[at], self.to_word[c], out=out[at])
            out[at] += self.word_bias[c]
        return out

    def train(self, words: np.ndarray, begins: np.ndarray, rate: float = RATE) -> None:
        """One pass over a run of documents (words with ends, and where documents begin)."""
        other = CLASSES * WORDS_A_CLASS
        if not len(words):
            return
        streams = min(STREAMS, -(-len(words) // WINDOW))  # few words are few streams
        length = -(-len(words) // streams)
        before = np.concatenate([[other + 1], words[:-1]])
        before[begins] = other + 1
        fill = streams * length - len(words)  # the last streams end early: places that count for nothing
        shape = lambda x, empty: np.concatenate([x, np.full(fill, empty, x.dtype)]).reshape(streams, length).T
        target, source, reset = shape(words, other), shape(before, other + 1), shape(begins, True)
        counts = shape(np.ones(len(words), np.float32), 0)
        h = np.zeros((streams, HIDDEN), np.float32)
        grown = [np.full(p.shape, 1e-4, np.float32) for p in self.parts()]
        for start in range(0, length, WINDOW):
            end = min(start + WINDOW, length)
            kept, states = [], []
            read, state = _thirds(self.inputs[source[start:end]]), _thirds(self.state)
            live = (~reset[start:end])[:, :, None].astype(np.float32)
            for t in range(end - start):
                before = h * live[t]
                h, back = _gated(before, read[:, t], state)
                kept.append((before, source[start + t], *back))
                states.append(h)
            grads = self._backward(kept, live, np.stack(states), target[start:end], counts[start:end])
            for p, g, total in zip(self.parts(), grads, grown):
                np.clip(g, -STEEPEST, STEEPEST, out=g)
                total += g * g
                g *= rate
                g /= np.sqrt(total)
                p -= g

    def _backward(self, kept, resets, states, target, counts=None) -> list[np.ndarray]:
        flat, words = states.reshape(-1, HIDDEN), target.ravel()
        counts = np.ones(len(words), np.float32) if counts is None else counts.ravel()
        scale = (counts / max(counts.sum(), np.float32(1)))[:, None]
        kind = np.minimum(words // WORDS_A_CLASS, CLASSES)
        p = _soft(flat @ self.to_class + self.class_bias)
        p[np.arange(len(words)), kind] -= 1
        p *= scale
        d_to_class, d_class_bias = flat.T @ p, p.sum(axis=0)
        d_flat = p @ self.to_class.T
        d_to_word, d_word_bias = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        rows, classes = _by_class(kind)
        near = flat[rows]
        q = _soft(self._in_class(near, classes))
        q[np.arange(len(rows)), words[rows] % WORDS_A_CLASS] -= 1
        q *= scale[rows]
        d_near = np.empty_like(near)
        for c, at in classes:
            np.matmul(near[at].T, q[at], out=d_to_word[c])
            np.matmul(q[at], self.to_word[c].T, out=d_near[at])
            d_word_bias[c] = q[at].sum(axis=0)
        d_flat[rows] += d_near
        d_states = d_flat.reshape(states.shape)
        h, z, r, m, n = (np.stack([back[k] for back in kept]) for k in (0, 2, 3, 4, 5))
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (h - n) * z * (1 - z), m * r * (1 - r)
        d_n, d_g = np.empty_like(h), np.empty((*h.shape[:2], 3 * HIDDEN), h.dtype)
        d_h = np.zeros_like(states[0])
        for t in range(len(kept) - 1, -1, -1):
            d_h += d_states[t]
            np.multiply(d_h, by_n[t], out=d_n[t])
            np.multiply(d_h, by_z[t], out=d_g[t, :, :HIDDEN])
            np.multiply(d_n[t], by_r[t], out=d_g[t, :, HIDDEN : 2 * HIDDEN])
            np.multiply(d_n[t], r[t], out=d_g[t, :, 2 * HIDDEN :])
            d_h *= z[t]
            d_h += d_g[t] @ self.state.T
            d_h *= resets[t]
        d_state = h.reshape(-1, HIDDEN).T @ d_g.reshape(-1, 3 * HIDDEN)
        d_g[:, :, 2 * HIDDEN :] = d_n
        d_inputs = np.zeros_like(self.inputs)
        read = np.concatenate([back[1] for back in kept])
        order = np.argsort(read.astype(np.int16), kind="stable")  # a radix sort: numbers of words are small
        read = read[order]
        at = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
        d_inputs[read[at]] = np.add.reduceat(d_g.reshape(-1, 3 * HIDDEN)[order], at)
        return [d_inputs, d_state, d_to_class, d_class_bias, d_to_word, d_word_bias]

    def documents(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log probability of each document, its end included, the state carried through."""
        other = CLASSES * WORDS_A_CLASS
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        first, length = bounds[:-1][order], length[order]
        total = np.zeros(len(order))
        h = np.zeros((len(order), HIDDEN), np.float32)
        states, targets, owners, n = [], [], [], 0
        inputs, state = _thirds(self.inputs), _thirds(self.state)
        for t in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -t, side="left"))  # documents longer than t
            read = words[first[:active] + t - 1] if t else np.full(active, other + 1)
            h, _ = _gated(h[:active], inputs.take(read, axis=1), state)
            states.append(h)
            targets.append(words[first[:active] + t])
            owners.append(active)
            n += active
            if n >= HELD_STATES or len(states) >= HELD_STEPS:
                self._settle(states, targets, owners, total)
                states, targets, owners, n = [], [], [], 0
        if states:
            self._settle(states, targets, owners, total)
        out = np.zeros(len(order))
        out[order] = total
        return out

    def _settle(self, states, targets, owners, total) -> None:
        logs = self.log_shares(np.concatenate(states), np.concatenate(targets))
        at = 0
        for active in owners:
            total[:active] += logs[at : at + active]
            at += active


def _thirds(x: np.ndarray) -> np.ndarray:
    """The columns for the two gates and the new state as three arrays, so that each lies in one piece."""
    return np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:-1], 3, HIDDEN), -2, 0))


def _gated(h: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The next state, and what the way back needs; `a` and `state` in thirds."""
    g = h @ state
    gates = a[:2] + g[:2]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r, m = *gates, g[2]
    n = r * m
    n += a[2]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (z, r, m, n)


def _log_sum(scores: np.ndarray) -> np.ndarray:
    """Overwrites the scores."""
    top = scores.max(axis=1)
    scores -= top[:, None]
    top += np.log(np.exp(scores, out=scores).sum(axis=1))
    return top


def _soft(scores: np.ndarray) -> np.ndarray:
    """In place of the scores."""
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Rows with predicted words in order of their classes, and where each class lies among them."""
    order = np.argsort(kind.astype(np.int16), kind="stable")  # a radix sort
    cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
    return order[: cuts[-1]], [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words with ends, bounds) of each piece of a column of texts."""
    for piece in pieces(column):
        starts, ends, owner = piece.spans(SOLID)
        bounds = piece.bounds(owner)
        hashes = np.insert(piece.hashes(starts, ends), bounds[1:], END)
        yield piece.first, hashes, bounds + np.arange(len(bounds))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def counted() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c.astype(np.int64))], names=["h", "c"])

    for batch in batches:
        for _, hashes, _ in _tokens(batch.column("text")):
            held.append(hashes)
            n += len(hashes)
            if n >= HELD_WORDS:
                yield counted()
                held, n = [], 0
    if held:
        yield counted()


@dataclass
class Words:
    """The frequent words: ordered hashes, log10 of base probabilities, numbers in the network."""

    hashes: np.ndarray
    log_base: np.ndarray
    number: np.ndarray

    def __post_init__(self) -> None:
        #: Places of the words of the network, of which most text consists: few enough to be searched fast.
        self.predicted = np.flatnonzero(self.number < CLASSES * WORDS_A_CLASS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in the table, -1 for words beyond it. Words of the network are looked for first."""
        at = _places(self.hashes[self.predicted], h)
        near = at >= 0
        at[near] = self.predicted[at[near]]
        at[~near] = _places(self.hashes, h[~near])
        return at

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers in the network, that of other words for all beyond it."""
        at = _places(self.hashes[self.predicted], h)
        near = at >= 0
        out = np.full(len(h), CLASSES * WORDS_A_CLASS)
        out[near] = self.number[self.predicted[at[near]]]
        return out


def _places(ordered: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of `h` in ordered hashes, -1 for those not there."""
    if not len(ordered):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
    at[ordered[at] != h] = -1
    return at


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word of `docs` occurs, ends included."""
    return docs.select("text").mapInArrow(tidy(_count), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _averaged(packs: DataFrame, tasks: int) -> np.ndarray | None:
    """The average of packed weights by their numbers of words, a few at a time in tasks."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for batch in batches:
            for w, raw in zip(batch.column("weight").to_pylist(), batch.column("pack")):
                part = np.frombuffer(raw.as_py(), np.float32).astype(np.float64) * w
                total, weight = (part if total is None else total + part), weight + w
        yield _pack(key[0].as_py(), weight, total / weight)

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        packs = packs.withColumn("task", F.pmod("task", F.lit(tasks)).cast("long")).groupBy("task").applyInArrow(add, PACK)
    rows = packs.collect()
    if not rows:
        return None
    weight = sum(r["weight"] for r in rows)
    return sum(np.frombuffer(r["pack"], np.float32).astype(np.float64) * (r["weight"] / weight) for r in rows)


PACK = "task long, weight long, pack binary"


def _pack(task: int, weight: int, flat: np.ndarray) -> pa.RecordBatch:
    raw = flat.astype(np.float32).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array([task], pa.int64()), pa.array([weight], pa.int64()), pa.array([raw], pa.binary())],
        names=["task", "weight", "pack"],
    )


def train(docs: DataFrame, words, network: Network) -> Network:
    """The network after ROUNDS of training, each on the documents that a hash of their text deals to it: all in all."""
    spark = docs.sparkSession
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(network)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            net = sent.value.unpacked(sent.value.packed())
            weight = 0
            for batch in batches:
                parts, begins = [], []
                for _, hashes, bounds in _tokens(batch.column("text")):
                    number = words.value.numbers(hashes)
                    start = np.zeros(len(hashes), bool)
                    start[bounds[:-1]] = True
                    parts.append(number)
                    begins.append(start)
                if parts:
                    net.train(np.concatenate(parts), np.concatenate(begins))
                    weight += sum(map(len, parts))
            if weight:
                yield _pack(TaskContext.get().partitionId(), weight, net.packed())

        chosen = docs.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == turn).select("text")
        packs = materialise(chosen.mapInArrow(tidy(work), PACK), "weights")
        flat = _averaged(packs, packs.count())
        if flat is not None:
            network = network.unpacked(flat)
    return network


def _score(batches: Iterator[pa.RecordBatch], vocabulary: Words, network: Network, log_other: float) -> Iterator[pa.RecordBatch]:
    """Rows of `score_documents` but for words beyond the table, which are listed. Batches are scored together."""
    names = ["doc_id", "text_key", "held_out", "n_tokens", "n_known", "base", "other", "rare"]
    order_of = [*names[:-1], "network", "rare"]
    rare_type = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
    held, parts, n = [], [], 0

    def settled() -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])
        logs = network.documents(np.concatenate([p[0] for p in parts]), bounds) / math.log(10)
        at = 0
        for rows in held:
            yield rows.append_column("network", pa.array(logs[at : at + rows.num_rows])).select(order_of)
            at += rows.num_rows

    for batch in batches:
        rows = []
        for _, hashes, bounds in _tokens(batch.column("text")):
            place = vocabulary.find(hashes)
            found = place >= 0
            log_base = np.where(found, vocabulary.log_base[place], 0.0) if len(vocabulary.hashes) else np.zeros(len(hashes))
            numbers = np.where(found, vocabulary.number[place], CLASSES * WORDS_A_CLASS) if len(vocabulary.hashes) else np.full(len(hashes), CLASSES * WORDS_A_CLASS)
            outside = numbers == CLASSES * WORDS_A_CLASS
            known = np.add.reduceat(found.astype(np.int64), bounds[:-1])
            base = np.add.reduceat(log_base, bounds[:-1])
            rest = np.add.reduceat(np.where(outside, log_base - log_other, 0.0), bounds[:-1])
            parts.append((numbers.astype(np.int16), np.diff(bounds)))
            n += len(hashes)
            for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                if known[k] == b - a:
                    rows.append((b - a, known[k], base[k], rest[k], []))
                    continue
                far, times = np.unique(hashes[a:b][~found[a:b]], return_counts=True)
                rare = [{"h": x, "n": y} for x, y in zip(signed(far).tolist(), times.tolist())]
                rows.append((b - a, known[k], base[k], rest[k], rare))
        if not rows:
            continue
        every = pa.array(np.arange(batch.num_rows))  # copies: a view would hold the texts of the batch
        held.append(pa.RecordBatch.from_arrays(
            [
                *(batch.column(x).take(every) for x in names[:3]),
                *(pa.array([int(r[k]) for r in rows], pa.int64()) for k in (0, 1)),
                *(pa.array([float(r[k]) for r in rows], pa.float64()) for k in (2, 3)),
                pa.array([r[4] for r in rows], rare_type),
            ],
            names=names,
        ))
        if n >= HELD_TOKENS:
            yield from settled()
            held, parts, n = [], [], 0
    if held:
        yield from settled()


def score_documents(
    docs: DataFrame, modulus: int = 5, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`.

    Learns from all rows whose crc32 of the id as text does not leave `remainder`. One output row for each
    input row, repeated rows and null ids included (null ids are learned from). A null text is empty and
    has one token, its end. Without any text to learn from both scores are 0. Other columns are ignored.
    """
    spark = attach(docs.sparkSession)
    docs = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        held_out(F.col(id_col), modulus, remainder).alias("held_out"),
    )
    learned = docs.filter("not held_out")
    counts = materialise(word_counts(learned), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    whole = total + 0.5 * (distinct + 1)
    table = counts.orderBy(F.desc("c"), "h").limit(TABLE).toArrow()
    h, c = table["h"].to_numpy().astype(U), table["c"].to_numpy().astype(np.float64)
    least = int(c.min()) if len(c) else 0
    predicted = min(len(h), CLASSES * WORDS_A_CLASS)
    shares = (c[:predicted] + 0.5) / whole
    other = max(1.0 - shares.sum(), 0.5 / whole)
    order = np.argsort(h)
    number = np.minimum(np.arange(len(h)), CLASSES * WORDS_A_CLASS).astype(np.int32)
    words = spark.sparkContext.broadcast(Words(h[order], np.log10((c[order] + 0.5) / whole), number[order]))
    network = spark.sparkContext.broadcast(train(learned, words, Network.fresh(shares, other)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, text_key long, held_out boolean, n_tokens long, n_known long, base double, other double, "
        "network double, rare array<struct<h:long,n:int>>"
    )
    log_other = math.log10(other)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, words.value, network.value, log_other)

    scored = materialise(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(tidy(score), schema), "scored")
    rare = scored.select("doc_id", "text_key", F.explode("rare").alias("w")).select("doc_id", "text_key", "w.h", "w.n")
    beyond = counts.filter(F.col("c") <= least)  # the table holds all words of larger counts
    share = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(whole))
    rare = rare.join(beyond, "h", "left").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.sum("n").alias("rare_n"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * share).alias("rare_base"),
    )
    joined = scored.withColumn("own", F.aggregate("rare", F.lit(0).cast("long"), lambda a, w: a + w["n"])).drop("rare").join(
        rare, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left"
    )
    # rows with the same id and text are summed together above: each gets its own part
    part = lambda c: F.coalesce(F.col(c) * F.col("own") / F.col("rare_n"), F.lit(0.0))
    return joined.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.round(part("rare_known")).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + part("rare_base")).alias("base_score"),
        (F.col("network") + F.col("other") + part("rare_base") - F.col("own") * log_other).alias("score"),
    )
