"""The embedder port, export and publication of an index, and files of results."""

from __future__ import annotations

import hashlib
import json
import threading

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleanery.functions import embedder as em
from gleanery.operators import rerank
from gleanery.params import DenseParams, RankParams
from gleanery.plans import index as ix
from gleanery.plans import retrieve as rt
from gleanery.sources import tables

SCHEMA = "path string, heading string, heading_path array<string>, line_start bigint, line_end bigint, text string"
SMALL = RankParams(embedding=DenseParams(dim=26))


def passages(spark, n=40):
    rows = [(f"d/{k % 5}.md", "", [], k + 1, k + 1, f"word{k} common text {chr(97 + k % 26) * 9}") for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def loader():
    """A stand-in model: how often each letter occurs, and a strong mark for the word query."""

    def letters(texts):
        out = np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], float)
        out[:, 16] += [1000.0 * t.startswith("query: ") for t in texts]
        return out

    return lambda: letters  # sent to the workers by value


def letter_model():
    return em.model("letters@1", loader(), 26, "query: ")


def test_a_second_embedder_takes_the_place_of_the_first(spark):
    index = ix.build_index(passages(spark), params=SMALL, embedder=letter_model())
    got = {r.line_start: r.embedding for r in index.table("vectors").collect()}
    assert len(got) == 40
    for r in index.table("passages").collect():
        v = loader()()(["\n" + r.text])[0]
        assert got[r.line_start] == np.rint(v / np.sqrt((v * v).sum()) * 127).astype(int).tolist()
    q = spark.createDataFrame([(1, "zzz"), (2, "")], "qid bigint, question string")
    asked = {r.qid: r.embedding for r in rt.embedded(index, q).collect()}
    assert asked[1][16] == 127 and asked[2][16] == 127  # the prefix is part of a question
    again = ix.open_index(spark, index.root, SMALL, letter_model())
    assert rt.retrieve(again, spark.createDataFrame([(1, "common zzzz")], "qid bigint, question string")).count() > 0


@pytest.mark.parametrize("bad", [lambda t: np.zeros((len(t), 5)), lambda t: np.full((len(t), 26), np.nan)])
def test_wrong_vectors_are_refused(spark, bad):
    wrong = em.model(f"bad{bad(['x']).shape}", lambda: bad, 26)
    with pytest.raises(PySparkException, match="embedder gave"):
        passages(spark, 3).select(wrong.passage(F.col("text")).alias("v")).collect()


def test_no_embedder_is_an_error_and_widths_must_fit(spark):
    with pytest.raises(PySparkException, match="no embedding model"):
        passages(spark, 3).select(em.missing(26).passage(F.col("text")).alias("v")).collect()
    assert em.packed(np.zeros((0, 26)), 0, 26).to_pylist() == []
    index = ix.build_index(passages(spark, 3), params=SMALL, embedder=em.hashed(26))
    with pytest.raises(ix.IndexMismatch, match="components"):
        ix.open_index(spark, index.root, SMALL, em.hashed(384))


def test_digest_is_that_of_the_lines_in_order_whatever_the_layout(spark):
    rows = [(k, f"line {k * 7 % 100}") for k in range(100)]
    df = spark.createDataFrame(rows, "n bigint, line string")

    def tree(texts, leaf):
        level = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
        while True:
            level = [hashlib.sha256("\n".join(level[k : k + leaf]).encode()).hexdigest() for k in range(0, len(level), leaf)]
            if len(level) == 1:
                return level[0]

    want = tree([t for _, t in rows], 4)
    assert ix.digest_tree(df.repartition(7), ["n"], leaf=4) == (want, 100)
    assert ix.digest_tree(df.coalesce(1), ["n"], leaf=4) == (want, 100)
    assert ix.digest_tree(df.filter("n != 50"), ["n"], leaf=4)[0] != want
    assert ix.digest_tree(df.limit(0), ["n"]) == (hashlib.sha256(b"").hexdigest(), 0)


def test_export_and_publication(spark, tmp_path):
    one = ix.build_index(passages(spark, 12))
    other = ix.build_index(passages(spark, 12).repartition(4))
    more = ix.build_index(passages(spark, 13))
    digest, n = ix.export(one, str(tmp_path / "lines"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert n == len(lines) == 12 and json.loads(lines[0])["path"].startswith("d/")
    pointer = str(tmp_path / "current")
    assert ix.publish(one, pointer) == digest == ix.publish(other, pointer)
    seen, stop = set(), threading.Event()

    def reader():  # while the pointer is swapped, a reader always finds one whole pointer
        while not stop.is_set():
            seen.add(json.loads(open(pointer).read())["root"])

    thread = threading.Thread(target=reader)
    thread.start()
    try:
        for index in (more, one, more):
            ix.publish(index, pointer)
    finally:
        stop.set()
        thread.join()
    assert seen <= {one.root, other.root, more.root} and other.root in seen
    assert ix.published(spark, pointer).meta.passages == 13
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("current.")] == []


def test_pointer_is_never_missing(spark, tmp_path):
    for pointer in (str(tmp_path / "current"), f"file:{tmp_path}/named"):
        place = pointer.removeprefix("file:")
        (tmp_path / f".{place.rsplit('/', 1)[1]}.crc").write_bytes(b"crc\0 of an older pointer")
        ix.point(spark, pointer, b"0")
        found, stop = [], threading.Event()

        def reader(place=place, found=found, stop=stop):
            while not stop.is_set():
                try:
                    found.append(open(place).read())
                except FileNotFoundError:
                    found.append(None)

        thread = threading.Thread(target=reader)
        thread.start()
        try:
            for k in range(1, 301):
                ix.point(spark, pointer, str(k).encode())
        finally:
            stop.set()
            thread.join()
        assert None not in found and "" not in found and len(set(found)) > 1
        assert spark.read.text(pointer).first()[0] == "300"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["current", "named"]


def test_questions_pinned_elsewhere_are_refused(spark):
    index = ix.build_index(passages(spark, 3), commit="a" * 40)
    ix.require_commit(index, "a" * 40)
    with pytest.raises(ix.IndexMismatch, match="pinned"):
        ix.require_commit(index, "b" * 40)


def test_reranker_scores_must_be_finite(spark):
    q = spark.createDataFrame([(1, "a")], "qid bigint, question string")
    shown = spark.createDataFrame([(1, "p", 1, [], "t")], "qid bigint, path string, rank int, heading_path array<string>, text string")
    for bad in ("NaN", "inf", "-inf", None):
        scorer = lambda question, text, bad=bad: F.lit(None if bad is None else float(bad)).cast("double")
        with pytest.raises(PySparkException, match="non-finite"):
            rerank.rerank(q, shown, scorer).collect()


def test_sweep_and_signals_files(spark, tmp_path):
    counts = spark.createDataFrame(
        [("s1", 0.4, 0.0, 1, 2, 3, 4), ("all", 0.4, 0.0, 5, 6, 7, 8), ("s1", 0.5, 0.0, 0, 2, 1, 4), ("all", 0.5, 0.0, 1, 6, 2, 8)],
        "set string, t double, m double, b1_num int, b1_den int, b2_num int, b2_den int",
    )
    tables.write_sweep(counts, str(tmp_path / "sweep"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sweep")).collect()
    assert [(r.t, r.all_b1_num, r.s1_b2_den) for r in back] == [("0.4", "5", "4"), ("0.5", "1", "4")]
    header = [f.split(" ")[0] for f in tables.SIGNALS.split(", ")]
    (tmp_path / "signals.csv").write_text(
        ",".join(header) + "\na,q1,answerable,0,1,2,0.9,0.8,0.1,0.05,0.9,0.9,x|y\na,q2,unanswerable,1,0,none,0.5,0.4,0.1,0.05,0.5,0.5,z\n"
    )
    rows = {r.qid: r for r in tables.read_signals(spark, str(tmp_path / "signals.csv")).collect()}
    assert rows["q1"]["rank"] == 2 and rows["q2"]["rank"] is None and rows["q1"].top1 == 0.9
    (tmp_path / "bad.csv").write_text(",".join(header) + "\na,q1,answerable,zero,1,2,0.9,0.8,0.1,0.05,0.9,0.9,x\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        tables.read_signals(spark, str(tmp_path / "bad.csv")).collect()
