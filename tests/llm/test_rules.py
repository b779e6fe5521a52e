"""Quality rules: base counts against plain Python, and the regression on rows held out."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import rules

from .conftest import sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def odd_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a " * 9, "a " * 8, "x\ny\nx\n x\n\n\n", "é€𝄞 é€𝄞\né€𝄞 é€𝄞", "# * $%&|<>", "one\r\none\r\n"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += ["\n".join(rng.choice(("p q", "p  q", "", "r")) for _ in range(rng.randrange(12))) for _ in range(100)]
    texts.append(sentence(rng, 8) + " " + sentence(rng, 30_000))
    return texts


def test_counts_are_those_of_plain_python():
    texts = odd_texts()
    got = np.concatenate([c for c, _ in rules.measure(pa.array(texts))])
    assert [tuple(r) for r in got.tolist()] == [brute(t) for t in texts]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        text = sentence(rng, rng.randrange(25, 80))
        docs.append((i, text if good else re.sub(r"(\w)\b", r"\1zq", text), "s"))
        labels.append((i, int(good)))
    labels += [(None, 1), (7, None), (9000, 0), (3, 1), (3, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_regression_on_rows_held_out(labelled, odd, none):
    docs, labels = labelled
    rows = rules.quality_rules(docs, labels).collect()
    assert len(rows) == 500
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["kept"] == (r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    # the same model wherever the rows lie
    again = rules.quality_rules(docs.repartition(3), labels).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in again) == sorted((r["doc_id"], round(r["score"], 9)) for r in rows)
    got = rules.quality_rules(odd, labels).collect()
    want = collections.Counter((r["doc_id"], *brute(r["text"])) for r in odd.collect())
    assert collections.Counter((r["doc_id"], *(r[c] for c in rules.COUNTS)) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert {r["score"] for r in rules.quality_rules(odd, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in rules.quality_rules(odd, labels.filter("quality = 1")).collect()} == {0.5}
    assert rules.quality_rules(none, labels).collect() == []


def test_calibration_gives_rates():
    rng = np.random.default_rng(5)
    z = rng.standard_normal(20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z - 1)))).astype(float)
    a, b = rules.calibrate(z, y, np.ones(len(z)))
    assert abs(a - 0.5) < 0.05 and abs(b + 1) < 0.1


def test_query(spark, sf_dir):
    from gleanery.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op11_quality_rules"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert tuple(got[r["doc_id"]][c] for c in rules.COUNTS) == brute(r["text"])
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for i, r in got.items() if r["held_out"] and i in truth and not r["base_failed"]]
    assert sum(r["kept"] == (truth[r["doc_id"]] == 1) for r in held) >= 0.8 * len(held)
