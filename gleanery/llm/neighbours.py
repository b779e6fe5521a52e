"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (lower-cased) and their first bytes; those kept are the ones that labelled toxic texts
have and clean ones lack, by a likelihood ratio over groups of copies, so that one much-copied text
cannot make its words terms. Inverse document frequencies of the terms cover all documents. The labelled
examples form an inverted index in blocks with the largest weight of each term in each block; blocks are
read in order of the most they can add, until none can reach the k nearest: the result is exact.

The nearest examples vote with their cosines; the vote is turned into a rate by a monotone fit to the
examples' own votes, each with itself left out. The nearest examples are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.session import attach, tidy
from gleanery.llm.textnum import ALNUM, U, mix, pieces, signed
from gleanery.session import materialise, small_side

#: Labelled examples learned from, at most; those with the smallest hashes of their ids are taken.
MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
#: Terms, at most, and the groups of copies that each needs.
MAX_TERMS, MIN_GROUPS = 8_192, 3
#: The likelihood ratio that a term needs grows with the number of terms tried, of which some look good by
#: chance: twice its logarithm, and this.
BEYOND_CHANCE = 4.0
#: Terms that are tried, at most: the most frequent of toxic texts.
MAX_TRIED = 500_000
#: First bytes of words that are terms of their own.
PREFIXES = (4, 6)
NEAREST = 15
#: Weight of the rate of texts without terms in each vote.
PRIOR_WEIGHT = 0.25
BLOCK = 64
THRESHOLD = 0.3


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hash of each term place, hashes of the words alone) of each text."""
    column = pc.utf8_lower(column.cast(pa.large_string()))
    for piece in pieces(column):
        starts, ends, owner = piece.spans(ALNUM)
        whole = piece.hashes(starts, ends, fold=False)
        parts, owners = [whole], [owner]
        for k, n in enumerate(PREFIXES, start=1):
            longer = ends - starts > n
            cut = piece.hashes(starts[longer], starts[longer] + n, fold=False)
            parts.append(mix(cut + U(k)))
            owners.append(owner[longer])
        who = np.concatenate(owners)
        order = np.argsort(who, kind="stable")
        terms = np.concatenate(parts)[order]
        bounds, own = piece.bounds(who[order]), piece.bounds(owner)
        for k in range(len(piece)):
            yield piece.first + k, terms[bounds[k] : bounds[k + 1]], whole[own[k] : own[k + 1]]


def _examples(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, y) of the labelled rows to learn from, bounded in each class."""
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .filter(~held_out(F.col("doc_id"), modulus, remainder))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    known = materialise(known, "known")
    by_hash = F.xxhash64("doc_id")
    one = known.filter("y = 1").orderBy(by_hash, "doc_id").limit(MAX_TOXIC)
    two = known.filter("y = 0").orderBy(by_hash, "doc_id").limit(MAX_CLEAN)
    return materialise(one.union(two), "examples")


def _groups(texts: DataFrame, only=None) -> DataFrame:
    """(term, y, n): groups of copies that have the term. Texts with the same least word are a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("y").to_numpy()
            seen: list[set] = [set(), set()]
            pairs: list[list] = [[], []]
            for row, terms, words in term_hashes(batch.column("text")):
                if not len(words):
                    continue
                got = np.unique(terms)
                if only is not None:
                    got = got[_place(only.value, got) >= 0]
                pairs[label[row]].append((got, np.full(len(got), words.min(), U)))
            for y in (0, 1):
                if pairs[y]:
                    both = np.stack([np.concatenate([p[k] for p in pairs[y]]) for k in (0, 1)])
                    both = np.unique(both, axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(both[0])), pa.array(signed(both[1])), pa.array(np.full(both.shape[1], y, np.int32))],
                        names=["term", "copies", "y"],
                    )

    rows = texts.mapInArrow(tidy(run), "term long, copies long, y int").distinct()
    return rows.groupBy("term", "y").agg(F.count(F.lit(1)).alias("n"))


def _place(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in an ordered array, or -1."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def _likelihood_ratio(n1: np.ndarray, n0: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """Twice the log likelihood ratio of a term's share in two classes, negative where clean texts have more."""
    def part(k, n, p):
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    p1, p0, p = n1 / all1, n0 / all0, (n1 + n0) / (all1 + all0)
    ratio = 2 * (part(n1, all1, p1) + part(n0, all0, p0) - part(n1, all1, p) - part(n0, all0, p))
    return np.where(p1 > 3 * p0, ratio, -1.0)


def choose_terms(texts: DataFrame) -> np.ndarray:
    """The ordered hashes of the terms; `texts` has (doc_id, text, y) of the examples."""
    spark = texts.sparkSession
    tried = _groups(texts.filter("y = 1")).filter(F.col("n") >= MIN_GROUPS)
    tried = tried.orderBy(F.desc("n"), "term").limit(MAX_TRIED).select("term", F.col("n").alias("n1")).toPandas()
    if not len(tried):
        return np.zeros(0, U)
    order = np.argsort(tried["term"].to_numpy().astype(U))
    term, n1 = tried["term"].to_numpy().astype(U)[order], tried["n1"].to_numpy()[order].astype(float)
    sent = spark.sparkContext.broadcast(term)
    clean = _groups(texts.filter("y = 0"), sent).toPandas()
    n0 = np.zeros(len(term))
    n0[_place(term, clean["term"].to_numpy().astype(U))] = clean["n"].to_numpy()
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratio = _likelihood_ratio(n1, n0, max(sizes.get(1, 0), n1.max()), max(sizes.get(0, 0), n0.max(), 1))
    best = np.lexsort((term, -ratio))[:MAX_TERMS]
    return np.sort(term[best[ratio[best] >= 2 * np.log(len(term)) + BEYOND_CHANCE]])


def _vectors(docs: DataFrame, terms) -> DataFrame:
    """(doc_id, at: places of terms, tf: their counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            at, tf = [none] * len(batch), [none] * len(batch)
            for row, found, _ in term_hashes(batch.column("text")):
                place = _place(terms.value, found)
                place = place[place >= 0]
                if len(place):
                    at[row], tf[row] = np.unique(place, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.list_(pa.int32())) for x in (at, tf))],
                names=["doc_id", "at", "tf"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, at array<int>, tf array<int>")


@dataclass
class BlockMaxIndex:
    """Postings of each term in order of blocks, with each block's largest weight."""

    ids: np.ndarray
    labels: np.ndarray
    idf: np.ndarray

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        # rows with the same strongest term stand together, which makes the blocks' maxima tight
        rows = [self.weights(at, tf) for at, tf in vectors]
        lead = [int(at[np.argmax(w)]) for (at, _), w in zip(vectors, rows)]
        order = np.lexsort((self.ids, lead))
        self.ids, self.labels = self.ids[order], self.labels[order]
        self.where = {int(i): k for k, i in enumerate(self.ids)}
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([vectors[k][0] for k in order]) if len(order) else np.zeros(0, int)
        doc = np.repeat(np.arange(len(order)), [len(rows[k]) for k in order])
        weight = np.concatenate([rows[k] for k in order]) if len(order) else np.zeros(0)
        by_term = np.lexsort((doc, term))
        self.term_at = np.searchsorted(term[by_term], np.arange(len(self.idf) + 1))
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.block_of, self.block_max, self.block_at = [], [], []
        for t in range(len(self.idf)):
            a, b = self.term_at[t], self.term_at[t + 1]
            block, first = np.unique(self.doc[a:b] // BLOCK, return_index=True)
            self.block_of.append(block)
            self.block_at.append(np.append(a + first, b))
            self.block_max.append(np.maximum.reduceat(self.weight[a:b], first) if b > a else np.zeros(0))
        return self

    def weights(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[at]
        return w / np.sqrt((w * w).sum())

    def nearest(self, at: np.ndarray, tf: np.ndarray, k: int, but: int | None = None) -> list[tuple[int, float, int]]:
        """(id, cosine, label) of the k nearest examples with a positive cosine, ties by id; `but` is left out."""
        query = self.weights(at, tf)
        most = np.zeros(self.blocks)
        for t, q in zip(at, query):
            most[self.block_of[t]] += q * self.block_max[t]
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        score, found, least, step = np.zeros(self.blocks * BLOCK), [], -1.0, 4
        start = 0
        while start < len(order) and most[order[start]] >= least - 1e-12:
            part = np.sort(order[start : start + step])
            start += step
            step *= 2
            for t, q in zip(at, query):
                places = np.searchsorted(self.block_of[t], part)
                for p, block in zip(places, part):
                    if p < len(self.block_of[t]) and self.block_of[t][p] == block:
                        a, b = self.block_at[t][p], self.block_at[t][p + 1]
                        score[self.doc[a:b]] += q * self.weight[a:b]
            docs = (part[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            docs = docs[(docs < len(self.ids))]
            docs = docs[score[docs] > 0]
            if but is not None and but in self.where:
                docs = docs[docs != self.where[but]]
            found.append(docs)
            near = np.concatenate(found)
            if len(near) >= k:
                least = np.partition(score[near], -k)[-k]
        near = np.concatenate(found) if found else np.zeros(0, int)
        rounded = np.round(score[near], 12)
        near = near[np.lexsort((self.ids[near], -rounded))[:k]]
        return [(int(self.ids[d]), float(round(min(score[d], 1.0), 12)), int(self.labels[d])) for d in near]


def vote(near: list[tuple[int, float, int]], rate: float) -> float:
    weight = sum(c for _, c, _ in near)
    return (sum(c * y for _, c, y in near) + PRIOR_WEIGHT * rate) / (weight + PRIOR_WEIGHT)


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit of labels to votes, smoothed towards the votes, for interpolation."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []
    for v, y in zip(votes[order], labels[order]):
        blocks.append([v + y, 2.0, v * 1.0, 1.0])  # each vote counts as one more example of its own rate
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[2] / b[3] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    modulus: int = 4,
    remainder: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, held_out, score, predicted, evidence) for each row of `docs`.

    Learns from labelled rows whose crc32 of the id as text does not leave `remainder`: at most MAX_TOXIC
    and MAX_CLEAN of them. One output row for each input row, repeated rows and null ids included. A text
    without terms (null and empty ones too) gets the rate of such examples and no evidence. Without
    labelled rows of both classes nothing is learned and every score is the rate known, or 0. Labels that
    are null or neither 0 nor 1 are passed over; an id labelled twice is toxic if one label says so.
    """
    spark = attach(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    examples = _examples(docs, labels, label, modulus, remainder)
    texts = docs.join(small_side(examples), "doc_id").dropDuplicates(["doc_id"])
    texts = materialise(texts, "texts")
    terms = choose_terms(texts)
    vectors = materialise(_vectors(docs, spark.sparkContext.broadcast(terms)), "vectors")
    total = max(1, vectors.count())
    df = np.zeros(len(terms))
    for r in vectors.select(F.explode("at").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        df[r["t"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 1
    rows = _vectors(texts.select("doc_id", "text"), spark.sparkContext.broadcast(terms)).join(examples, "doc_id").toPandas()
    filled = rows[rows["at"].map(len) > 0]
    bare = rows[rows["at"].map(len) == 0]
    rate = float(bare["y"].sum() / (len(bare) + 1)) if len(rows) else 0.0
    index = BlockMaxIndex(filled["doc_id"].to_numpy().astype(np.int64), filled["y"].to_numpy().astype(np.int64), idf)
    index.fill([(np.asarray(a), np.asarray(b)) for a, b in zip(filled["at"], filled["tf"])])
    sent = spark.sparkContext.broadcast(index)
    own = materialise(
        spark.createDataFrame(filled[["doc_id", "at", "tf", "y"]], "doc_id long, at array<int>, tf array<int>, y int")
        .repartition(spark.sparkContext.defaultParallelism)
        .mapInArrow(tidy(_voter(sent, rate, True)), "doc_id long, y int, vote double"),
        "votes",
    ).toPandas()
    x, y = monotone(own["vote"].to_numpy(), own["y"].to_numpy()) if len(own) else (np.array([0.0]), np.array([0.0]))
    curve = spark.sparkContext.broadcast((x, y))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = vectors.mapInArrow(
        tidy(_voter(sent, rate, False, curve)), f"doc_id {kind}, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"
    )
    return out.select(
        F.col("doc_id").alias(id_col),
        held_out(F.col("doc_id"), modulus, remainder).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "evidence",
    )


EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def _voter(sent, rate: float, own: bool, curve=None):
    """Votes of the examples, each without itself, or scores and evidence of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = sent.value, {}
        for batch in batches:
            votes, evidence = [], []
            for doc_id, at, tf in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "tf"))):
                if not at:
                    votes.append(rate)
                    evidence.append([])
                    continue
                key = (doc_id if own else None, *at, -1, *tf)
                near = seen.get(key)
                if near is None:
                    near = index.nearest(np.array(at), np.array(tf), NEAREST, doc_id if own else None)
                    if not own and len(seen) < 100_000:
                        seen[key] = near
                value = vote(near, rate)
                if not own:
                    value = float(np.interp(value, *curve.value))
                votes.append(value)
                evidence.append([{"doc_id": i, "cosine": c, "label": y} for i, c, y in near[:3]])
            if own:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("y"), pa.array(votes, pa.float64())], names=["doc_id", "y", "vote"]
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(votes, pa.float64()), pa.array(evidence, EVIDENCE)],
                    names=["doc_id", "score", "evidence"],
                )

    return run
