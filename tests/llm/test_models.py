"""Fitted operators: quality, toxicity, language-model scores; and the pipeline."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import discriminant, neighbours, recurrent

from .conftest import sentence


def crc(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.fixture(scope="module")
def labelled(spark):
    """600 documents: one in five shouts (quality 0), one in six has a bad word (toxic 1)."""
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        text, good, toxic = sentence(rng, rng.randrange(30, 80)), i % 5 != 0, i % 6 == 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        if toxic:
            words = text.split(" ")
            words[7] = rng.choice(("vileone", "viletwo", "rotter", "Rotter."))
            text = " ".join(words)
        docs.append((i, text, 0.5))
        labels.append((i, int(good), int(toxic)))
    labels += [(5000, 1, 1), (None, 1, 0), (3, None, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i: (q, t) for i, q, t in labels[:600]},
    )


def test_quality(labelled, odd, none):
    docs, labels, truth = labelled
    rows = discriminant.quality(docs, labels).collect()
    assert {r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in rows} == {True}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]][0] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    got = discriminant.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    # the text alone decides: copies score alike
    assert len({r["score"] for r in got if r["doc_id"] in (0, 20)}) == 1
    blank = discriminant.quality(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in blank] == [0.5]
    assert discriminant.quality(none, labels).collect() == []


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(1)
    x = [rng.standard_normal((200, 3)) * [1, 2, 1], rng.standard_normal((300, 3)) + 1]
    model = discriminant.fit(
        np.array([200.0, 300.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x])
    )
    point = rng.standard_normal((5, 3))
    logs = []
    for k, n in ((0, 200), (1, 300)):
        cov = model.factors[k] @ model.factors[k].T
        d = point - model.means[k]
        logs.append(math.log(n / 500) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.difference(point), logs[1] - logs[0])


def test_toxicity(labelled, odd, none):
    docs, labels, truth = labelled
    rows = neighbours.toxicity(docs, labels).collect()
    assert {r["held_out"] == (crc(r["doc_id"], 4) == 2) for r in rows} == {True}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    bad = next(r for r in held if truth[r["doc_id"]][1])
    assert bad["evidence"] and all(not crc(e["doc_id"], 4) == 2 for e in bad["evidence"])
    got = neighbours.toxicity(odd, labels).collect()  # no labelled id has bad words here
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in neighbours.toxicity(odd, labels.limit(0)).collect()} == {0}
    assert neighbours.toxicity(none, labels).collect() == []


def test_block_max_index_is_exact():
    rng = np.random.default_rng(4)
    n, terms = 700, 40
    vectors = []
    for _ in range(n):
        at = np.sort(rng.choice(terms, rng.integers(1, 6), replace=False))
        vectors.append((at, rng.integers(1, 4, len(at))))
    index = neighbours.BlockMaxIndex(rng.permutation(n).astype(np.int64), rng.integers(0, 2, n), rng.uniform(1, 4, terms))
    ids = index.ids.copy()
    index.fill(vectors)
    dense = np.zeros((n, terms))
    for k, (at, tf) in enumerate(vectors):
        dense[k, at] = index.weights(at, tf)
    for k in range(0, n, 13):
        cos = np.round(dense @ dense[k], 12)
        want = sorted(((-c, i) for c, i in zip(cos, ids) if c > 0 and i != ids[k]))[:15]
        got = index.nearest(*vectors[k], 15, int(ids[k]))
        assert [i for i, _, _ in got] == [i for _, i in want]
        assert np.allclose([c for _, c, _ in got], [-c for c, _ in want])


def base_scores(rows):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts = collections.Counter(w for i, ws in tokens for w in ws if i is None or crc(i, 5) != 1)
    whole = sum(counts.values()) + 0.5 * (len(counts) + 1)
    return sum(counts.values()), [
        (i, len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.5) / whole) for w in ws)) for i, ws in tokens
    ]


@pytest.mark.parametrize("table", [20, 1_000_000])
def test_language_model(odd, none, monkeypatch, table):
    """A small table of frequent words sends the others through the join: same base scores."""
    monkeypatch.setattr(recurrent, "TABLE", table)
    rows = recurrent.score_documents(odd).collect()
    total, want = base_scores([(r["doc_id"], r["text"]) for r in odd.collect()])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in rows), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6
    assert {r["train_tokens"] for r in rows} == {total}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert recurrent.score_documents(none).collect() == []


def test_shares_sum_to_one_and_state_is_carried():
    rng = np.random.default_rng(2)
    size = recurrent.CLASSES * recurrent.WORDS_A_CLASS
    net = recurrent.Network.fresh(np.full(size, 0.8 / size), 0.2)
    words = rng.integers(0, size + 1, 4000)
    begins = np.zeros(4000, bool)
    begins[::50] = True
    net.train(words, begins)
    states = rng.standard_normal((1, recurrent.HIDDEN)).astype(np.float32)
    every = net.log_shares(np.repeat(states, size + 1, axis=0), np.arange(size + 1))
    assert abs(np.exp(every.astype(np.float64)).sum() - 1) < 1e-4
    bounds = np.array([0, 900, 900 + 1, 4000])
    got = net.documents(words, bounds)
    h, want = np.zeros((1, recurrent.HIDDEN), np.float32), 0.0
    for t in range(900):
        h = net.step(h, np.array([words[t - 1] if t else size + 1]))
        want += float(net.log_shares(h, words[t : t + 1])[0])
    assert abs(got[0] - want) < 1e-2


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    size = recurrent.CLASSES * recurrent.WORDS_A_CLASS
    net = recurrent.Network.fresh(np.full(size, 0.8 / size), 0.2)
    net = recurrent.Network(*(p.astype(np.float64) + 0.05 * rng.standard_normal(p.shape) for p in net.parts()))
    words = rng.integers(0, size + 1, (5, 3))

    def forward(network, keep=False):
        h, kept, states = np.zeros((3, recurrent.HIDDEN)), [], []
        for t in range(5):
            h, back = network.step(h, words[t - 1] if t else np.full(3, size + 1), keep=True)
            kept.append(back)
            states.append(h)
        if keep:
            return kept, np.stack(states)
        return -network.log_shares(np.stack(states).reshape(-1, recurrent.HIDDEN), words.ravel()).mean()

    kept, states = forward(net, True)
    grads = net._backward(kept, [np.ones((3, 1))] * 5, states, words)
    for k, (p, g) in enumerate(zip(net.parts(), grads)):
        flat, grad = p.ravel(), g.ravel()
        for at in np.argsort(-np.abs(grad))[:4]:
            old = flat[at]
            values = []
            for d in (1e-5, -1e-5):
                flat[at] = old + d
                values.append(forward(net))
            flat[at] = old
            assert abs((values[0] - values[1]) / 2e-5 - grad[at]) < 1e-4 + 1e-3 * abs(grad[at]), k


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    from gleanery.llm import bpe, jaccardjoin, linechunks, winnow

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = ids(neighbours.toxicity(docs, labels).filter("predicted = 1"))
    one = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert one.columns == docs.columns and ids(one) == ids(docs) - toxic
    two = corpus_pipeline.drop_repeated_lines(spark, one, sf_dir).cache()
    cut = {r["doc_id"]: r["text"] for r in linechunks.dedup_lines(one).collect()}
    assert two.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in two.collect()} == {i: t for i, t in cut.items() if t.strip()}
    assert two.filter("n_chars != length(text)").isEmpty()
    three = corpus_pipeline.drop_near_copies(spark, two, sf_dir).cache()
    assert ids(three) == ids(jaccardjoin.jaccard_components(two).filter("doc_id = component_id"))
    four = corpus_pipeline.drop_contaminated(spark, three, sf_dir).cache()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(four) == ids(three) - ids(winnow.contamination(three, bench).filter("contaminated"))
    out = corpus_pipeline.tokenize(spark, four, sf_dir)
    import public_tokenizers

    want = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(four, public_tokenizers.path(corpus_pipeline.TOKENIZER)).collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in out.collect()} == want
    assert corpus_pipeline.run(spark, sf_dir).count() == len(want)


def test_every_document_to_learn_from_trains_the_network(spark, monkeypatch):
    rows = [(k, f"word{k} and some more text of document {k}") for k in range(60)] + [(60, ""), (61, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size = recurrent.CLASSES * recurrent.WORDS_A_CLASS
    net = recurrent.Network.fresh(np.full(size, 0.8 / size), 0.2)
    words = spark.sparkContext.broadcast(recurrent.Words(np.array([recurrent.END]), np.zeros(1), np.zeros(1, np.int32)))
    packs = []
    averaged = recurrent._averaged
    monkeypatch.setattr(recurrent, "_averaged", lambda p, n: packs.append(p.groupBy().sum("weight").first()[0]) or averaged(p, n))
    recurrent.train(docs, words, net)
    assert sum(packs) == sum(len(text.split()) + 1 for _, text in rows)


def test_training_learns_from_the_last_word_and_from_few_words():
    size = recurrent.CLASSES * recurrent.WORDS_A_CLASS
    for n in (1, 5, recurrent.STREAMS * 3 + 7):
        net = recurrent.Network.fresh(np.full(size, 0.8 / size), 0.2)
        words = np.zeros(n, np.int64)
        words[-1] = 41  # the second class only occurs at the end
        begins = np.zeros(n, bool)
        begins[0] = True
        before = net.class_bias.copy()
        net.train(words, begins)
        assert net.word_bias[1, 1] > recurrent.Network.fresh(np.full(size, 0.8 / size), 0.2).word_bias[1, 1]
        assert np.isfinite(net.packed()).all() and (net.class_bias != before).any()


def test_words_of_the_network_are_found_in_their_own_table():
    rng = np.random.default_rng(8)
    hashes = np.sort(rng.choice(1 << 60, 5000, replace=False).astype(np.uint64))
    number = np.minimum(rng.permutation(5000), recurrent.CLASSES * recurrent.WORDS_A_CLASS).astype(np.int32)
    words = recurrent.Words(hashes, np.zeros(5000), number)
    asked = np.concatenate([hashes, hashes + np.uint64(1), np.zeros(1, np.uint64)])
    place = {h: k for k, h in enumerate(hashes.tolist())}
    want = [place.get(h, -1) for h in asked.tolist()]
    assert words.find(asked).tolist() == want
    assert words.numbers(asked).tolist() == [number[k] if k >= 0 else recurrent.CLASSES * recurrent.WORDS_A_CLASS for k in want]
    none = recurrent.Words(hashes[:0], np.zeros(0), number[:0])
    assert none.find(asked[:3]).tolist() == [-1, -1, -1] and len(set(none.numbers(asked[:3]))) == 1


def test_documents_of_several_batches_are_scored_together():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 60)) if i % 7 else "" for i in range(240)]
    rows = pa.table({"doc_id": range(240), "text_key": range(240), "held_out": [False] * 240, "text": texts})
    (_, hashes, _), = recurrent._tokens(rows["text"].combine_chunks())
    known = np.unique(hashes)[::2]
    words = recurrent.Words(known, np.full(len(known), -3.0), np.arange(len(known), dtype=np.int32))
    calls = []

    class Counted(recurrent.Network):
        def documents(self, words, bounds):
            calls.append(len(bounds) - 1)
            return super().documents(words, bounds)

    size = recurrent.CLASSES * recurrent.WORDS_A_CLASS
    net = Counted(*recurrent.Network.fresh(np.full(size, 0.8 / size), 0.2).parts())
    got = [pa.Table.from_batches(recurrent._score(iter(rows.to_batches(n)), words, net, -1.0)) for n in (16, 240)]
    assert calls == [240, 240]  # the long documents of a small batch don't step alone
    assert got[0]["doc_id"].to_pylist() == list(range(240)) and got[0]["n_tokens"].to_pylist() == [len(t.split()) + 1 for t in texts]
    assert got[0].drop_columns("network").equals(got[1].drop_columns("network"))
    assert np.allclose(got[0]["network"].to_numpy(), got[1]["network"].to_numpy(), rtol=1e-5)
