from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import calibration, dense, fusion, sweep, topk
from gleanery.plans import retrieve as rt
from gleanery.plans.index import IndexMismatch, build_index, open_index
from gleanery.params import DenseParams, RankParams

DOCS = {
    "a/install.md": ["install the tool with the script", "run the installer twice"],
    "b/limits.md": ["the limit is ten questions an hour", "limits reset after an hour"],
    "c/empty.md": ["the and of"],
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        (path, "", [], i + 1, i + 1, text) for path, texts in DOCS.items() for i, text in enumerate(texts)
    ]
    schema = "path string, heading string, heading_path array<string>, line_start bigint, line_end bigint, text string"
    return build_index(spark.createDataFrame(rows, schema))


def test_retrieve_ranks_the_right_file_first(spark, index):
    q = spark.createDataFrame([(1, "How do I install it?"), (2, "hourly limits"), (3, "  ")], "qid bigint, question string")
    rows = rt.retrieve(index, q).collect()
    best = {r.qid: r.path for r in rows if r["rank"] == 1}
    assert best == {1: "a/install.md", 2: "b/limits.md"}
    assert max(r.passage_rank for r in rows) <= 2 and max(r["rank"] for r in rows) <= 3


def test_index_opens_only_with_its_parameters(spark, index):
    assert open_index(spark, index.root).meta.passages == 5
    other_pin = RankParams(embedding=DenseParams(revision="f" * 40))
    open_index(spark, index.root, other_pin)
    with pytest.raises(IndexMismatch):
        open_index(spark, index.root, RankParams(k1=1.5))


def vectors(spark, n=700, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    # few distinct vectors: many exact ties, and one file holds most rows
    pool = rng.integers(-127, 128, size=(40, dim))
    rows = [(f"f{0 if i % 3 else i % 7}", i, pool[rng.integers(40)].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, line_start bigint, embedding array<tinyint>")
    return rows, df.repartition(5)


def test_dense_ranking_with_ties_and_several_blocks(spark, monkeypatch):
    rows, df = vectors(spark)
    asked = [(q, rows[q * 31][2]) for q in range(20)]
    queries = spark.createDataFrame(asked, "qid bigint, embedding array<tinyint>")
    monkeypatch.setattr(dense, "CHUNK_ROWS", 16)
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 6)
    monkeypatch.setattr(dense, "BLOCKS_AT_ONCE", 2)
    monkeypatch.setattr(dense, "SLICES", 2)  # the survivors of five tasks are merged in two parts first
    blocks = dense.query_blocks(queries)
    assert [sorted(len(r.asked) for r in b.collect()) for b in blocks] == [[6, 6], [2, 6]]
    got = {(r.qid, r["rank"]): (r.path, r.line_start, r.dot) for r in dense.passage_dense(df, queries, 7).collect()}
    files = {(r.qid, r["rank"]): (r.path, r.dot) for r in dense.file_dense(df, queries, 3).collect()}
    for qid, vector in asked:
        dots = [(-int(np.dot(vector, v)), p, n) for p, n, v in rows]
        for at, (d, p, n) in enumerate(sorted(dots)[:7], 1):
            assert got[qid, at] == (p, n, -d)
        best = {}
        for d, p, _ in dots:
            best[p] = min(d, best.get(p, 10**9))
        for at, (d, p) in enumerate(sorted((d, p) for p, d in best.items())[:3], 1):
            assert files[qid, at] == (p, -d)
    top = {r.qid: r.top_dot for r in dense.top_similarity(df, queries).collect()}
    assert top == {q: max(int(np.dot(v, w)) for _, _, w in rows) for q, v in asked}
    chosen = [(q, f"f{q % 5}") for q in range(20)] + [(3, "f0"), (4, "none")]
    inside = dense.within_files(df, queries, spark.createDataFrame(chosen, "qid bigint, path string"), 4)
    inside = {(r.qid, r.path, r["rank"]): (r.line_start, r.dot) for r in inside.collect()}
    want = {}
    for q, path in chosen:
        dots = sorted((-int(np.dot(asked[q][1], v)), n) for p, n, v in rows if p == path)[:4]
        want |= {(q, path, at): (n, -d) for at, (d, n) in enumerate(dots, 1)}
    assert inside == want
    assert dense.passage_dense(df, queries.limit(0), 3).collect() == []


def test_order_statistics_with_an_extreme_outlier(spark, monkeypatch):
    """One huge value doesn't put the rest of its group together: it lies in many ranges, whatever the values."""
    rng = np.random.default_rng(2)
    values = [*rng.integers(0, 10**6, 1500).tolist(), 10**15]
    other = rng.integers(0, 50, 200).tolist()
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in other] + [("b", None), ("c", None)], "k string, v bigint")
    laid = []
    once = topk.laid_out
    monkeypatch.setattr(topk, "laid_out", lambda *a, **b: laid.append(once(*a, **b)) or laid[-1])
    positions = {"first": F.lit(1), "middle": F.floor((F.col("n") + 1) / 2), "last": F.col("n"), "beyond": F.col("n") + 1}
    got = {r.k: r for r in topk.order_statistics(df.repartition(3), ["k"], "v", positions, ranges=10).collect()}
    assert set(got) == {"a", "b"}
    for k, own in (("a", sorted(values)), ("b", sorted(other))):
        assert (got[k].n, got[k]["min"], got[k]["max"]) == (len(own), own[0], own[-1])
        assert (got[k].first, got[k].middle, got[k].last, got[k].beyond) == (own[0], own[(len(own) + 1) // 2 - 1], own[-1], None)
    most = laid[0].filter("k = 'a'").groupBy("_part").count().agg(F.max("count")).first()[0]
    assert most < len(set(values)) / 4
    whole = topk.order_statistics(df, [], "v", {"last": F.col("n")}).collect()
    assert [(r.n, r.last) for r in whole] == [(len(values) + len(other), 10**15)]


def test_order_statistics_and_numbers(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", float(rng.choice([1, 2, 2, 3, rng.randrange(90)]))) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: r for r in topk.median(df, ["k"], "v").collect()}
    upper = {r.k: r.upper_median for r in topk.upper_median(df, ["k"], "v").collect()}
    for k in got:
        values = sorted(v for key, v in rows if key == k)
        assert got[k].median == np.median(values) and got[k].n == len(values)
        assert upper[k] == values[len(values) // 2]
    numbers = topk.numbered(spark.range(1000).repartition(7), ["id"], "at").collect()
    assert all(r.at == r.id + 1 for r in numbers)


def test_rrf_and_null_questions(spark, index):
    lists = [spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid bigint, path string, rank int"),
             spark.createDataFrame([(1, "b", 1)], "qid bigint, path string, rank int")]
    got = {r.path: r.score for r in fusion.rrf(lists, ["qid", "path"]).collect()}
    assert got == {"a": 1 / 61, "b": 1 / 62 + 1 / 61}
    assert calibration.null_questions(index.table("passages")) is None
    assert calibration.threshold(0.4, None) == 0.4 and calibration.threshold(0.4, 0.5) == 0.5


def test_sweep_counts_equal_counting_every_cell(spark):
    rng = random.Random(4)
    rows = [
        (f"s{i % 3}", rng.choice(["answerable", "unanswerable"]), rng.choice([0, 1]),
         rng.choice([0.4, 0.67, rng.random()]), rng.choice([0.0, 0.005, rng.random() / 8])) for i in range(200)
    ]
    df = spark.createDataFrame(rows, "set string, label string, in_top5 int, top1 double, margin double")
    for r in sweep.set_counts(df).collect():
        mine = [x for x in rows if x[0] == r.set]
        no = [x for x in mine if x[1] == "unanswerable"]
        hit = [x for x in mine if x[1] == "answerable" and x[2] == 1]
        # the label decides first: an unanswerable row never counts as a hit
        refused = sum(x[3] < r.t or x[4] < r.m for x in no)
        assert (r.b1_num, r.b1_den) == (refused, len(no))
        assert (r.b2_num, r.b2_den) == (sum(not (x[3] < r.t or x[4] < r.m) for x in hit), len(hit))


def test_blocks_do_not_hold_the_batch_they_came_with():
    import numpy as np
    import pyarrow as pa

    vectors = pa.ListArray.from_arrays(pa.array([0, 2, 4], pa.int32()), pa.array([1, 2, 3, 4], pa.int8()))
    asked = pa.StructArray.from_arrays([pa.array([7, 8]), vectors, pa.array([["a"], ["a", "b"]])], names=["qid", "embedding", "paths"])
    block = dense._Block(asked)
    assert block.vectors.flags.owndata and block.vectors.tolist() == [[1, 2], [3, 4]]
    assert block.ids.buffers()[1].address != asked.field("qid").buffers()[1].address
    assert block.targets == {"a": [0, 1], "b": [1]}
    dots = dense._multiply(np.full((1, 64), -127, np.int8), np.full((1, 64), 127, np.int8))
    assert dots.dtype == np.int32 and dots.tolist() == [[-127 * 127 * 64]]


def test_batches_sent_to_python_are_bounded(spark):
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20
