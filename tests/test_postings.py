from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanery.operators import lexical
from gleanery.plans import postings as po
from gleanery.plans import retrieve as rt
from gleanery.plans.index import build_index

SCHEMA = "path string, heading string, heading_path array<string>, line_start bigint, line_end bigint, text string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [(f"d/{k % 7}.md", "", [], k, k, f"common word{k} shared{k % 5} thing") for k in range(300)]
    return build_index(spark.createDataFrame(rows, SCHEMA))


def scanned(df) -> tuple[int, str]:
    """Files that the scans of postings read, and the formatted plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    files = 0
    todo = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec" and "tf#" in node.output().toString():
            files += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return files, text


@pytest.mark.parametrize("unit", ["file", "passage"])
def test_a_question_reads_the_buckets_of_its_terms(spark, index, unit):
    def scores(words):
        q = spark.createDataFrame([(1, words)], "qid bigint, question string")
        return (rt.file_scores if unit == "file" else rt.passage_scores)(index, q)

    few, plan = scanned(scores("word17"))
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)
    whole, _ = scanned(index.postings(unit)[0].filter("tf > 0"))
    assert 0 < few <= 2 < whole
    # the same scores as over an unpruned table
    q = spark.createDataFrame([(1, "common word17 shared3 nothing"), (2, "thing")], "qid bigint, question string")
    keys = ["path"] if unit == "file" else list(lexical.PASSAGE)
    n, avg = (index.meta.files, index.meta.file_avgdl) if unit == "file" else (index.meta.passages, index.meta.passage_avgdl)
    plain = lexical.bm25(
        index.table(f"{unit}_terms"), lexical.weigh(lexical.query_terms(q), index.table(f"{unit}_vocabulary"), F.lit(n)), F.lit(avg), keys
    )
    got = (rt.file_scores if unit == "file" else rt.passage_scores)(index, q)
    assert sorted(map(tuple, got.select("qid", *keys, "score").collect())) == sorted(map(tuple, plain.select("qid", *keys, "score").collect()))
    assert got.count() > 0


def test_a_frequent_term_is_split_by_bag(spark, tmp_path):
    rows = [("hot", k, 5, 1) for k in range(1000)] + [(f"rare{k}", k, 5, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "term string, doc bigint, dl int, tf int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        n = po.write_postings(df, ["doc"], str(tmp_path / "p"), file_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert n == po.FEWEST
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(map(tuple, back.select("term", "doc", "dl", "tf").collect())) == sorted(rows)
    hot = back.filter("term = 'hot'").select("bucket").distinct().collect()
    assert len(hot) == 1
    files = list(Path(tmp_path / "p" / f"bucket={hot[0][0]}").glob("*.parquet"))
    assert len(files) >= 5  # eleven slices fall into 32 tasks
    assert back.withColumn("want", po.bucket_of(F.col("term"), n)).filter("want != bucket").isEmpty()


def test_buckets_grow_with_the_postings_within_bounds():
    assert po.buckets_for(0) == po.FEWEST
    assert po.buckets_for(po.FEWEST * po.BUCKET_ROWS + 1) == 2 * po.FEWEST
    assert po.buckets_for(10**15) == po.MOST


def test_an_index_writes_the_parts_that_are_asked_for(spark, monkeypatch):
    from gleanery.operators import calibration
    from gleanery.plans import index as ix

    rows = [(f"d/{k % 7}.md", "", [], k, k, f"common word{k} shared{k % 5} thing") for k in range(60)]
    found = build_index(spark.createDataFrame(rows, SCHEMA), parts=())
    with pytest.raises(ix.IndexMismatch):
        found.table("vectors")
    stemmed = []
    whole = calibration.eligible
    monkeypatch.setattr(calibration, "eligible", lambda df: whole(df.transform(lambda x: stemmed.append(x.count()) or x)))
    salads = calibration.null_questions(found.table("passages"), queries=2)
    assert salads.count() == 2 and stemmed[0] <= 10  # only drawn passages are stemmed
    some = ix.with_parts(found, "vectors")
    assert some.table("vectors").count() == 60 and not Path(f"{some.root}/meta").exists()
    with pytest.raises(ix.IndexMismatch):
        some.postings("passage")
