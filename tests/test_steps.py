"""Shared steps do their work once, and what a task holds is bounded."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gleanery.functions.wordpiece import basic_words, chunks, piece_ids
from gleanery.operators import calibration, legacy
from gleanery.operators.sections import sections
from gleanery.plans import retrieve as rt
from gleanery.plans.index import build_index
from gleanery.plans.ingest import run_ingest

SCHEMA = "path string, heading string, heading_path array<string>, line_start bigint, line_end bigint, text string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(n):
    return [(f"d/{k % 7}.md", "", [], k, k, f"common word{k % 9} shared{k % 5} thing") for k in range(n)]


def test_eligible_passages_are_stemmed_once(spark):
    passages = spark.createDataFrame([*rows(9), ("e.md", "", [], 1, 1, "the of and"), ("e.md", "", [], 2, 2, None)], SCHEMA)
    found = calibration.eligible(passages)
    assert plan(found.groupBy("path").agg(F.sum(F.size("terms")))).count("ArrowEvalPython") == 1
    assert sorted(r["path"] for r in found.collect()) == sorted(r[0] for r in rows(9))


def test_rows_of_sections_do_not_carry_their_file(spark):
    files = spark.createDataFrame([("a.md", "x\n# A\none\n\n## B\ntwo\n\n")], "path string, text string")
    assert re.search(r"\), \[path#\d+\], false, \[s#\d+\]", plan(sections(files)))
    assert [tuple(r) for r in sections(files).select("line_start", "line_end", "text").collect()] == [
        (1, 1, "x"), (2, 3, "# A\none"), (5, 6, "## B\ntwo")]


def test_long_sections_are_counted_at_the_bound(spark):
    files = [(f"{n}.md", " ".join("a" * n)) for n in (510, 511)] + [("i.md", "\u0130" * 511), ("b.md", "b" * 5000)]
    found = run_ingest(spark.createDataFrame(files, "path string, text string"), "r", "0" * 40, parts=())
    assert found.meta.truncated == 2  # 511 words, and 511 letters that are two words each but the last in lower case


def test_scores_are_dealt_to_tasks_by_pairs(spark, monkeypatch):
    index = build_index(spark.createDataFrame(rows(60), SCHEMA), parts=("passage", "file"))
    asked = spark.createDataFrame([(k, f"common word{k} thing") for k in range(4)], "qid bigint, question string")
    before = [sorted(map(tuple, f(index, asked).collect())) for f in (rt.passage_scores, rt.file_scores)]
    monkeypatch.setattr(rt, "PAIRS_A_TASK", 11)
    for scores, keys, tasks, same in ((rt.passage_scores, 2, 22, before[0]), (rt.file_scores, 1, 4, before[1])):
        found = scores(index, asked)
        assert re.search(rf"hashpartitioning\((path#\d+(, line_start#\d+L)?), {tasks}\), REPARTITION_BY_NUM", plan(found))
        assert sorted(map(tuple, found.collect())) == same and same


def test_earlier_scores_shuffle_no_pairs(spark):
    passage = spark.createDataFrame([(q, f"p{k % 3}", k, float(k + q + 1)) for q in range(3) for k in range(9)],
                                    "qid bigint, path string, line_start bigint, score double")
    file = spark.createDataFrame([(q, f"p{k}", float(k + 1)) for q in range(3) for k in range(2)], "qid bigint, path string, score double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = legacy.combined(passage, file)
        assert "SortMergeJoin" not in plan(found)
        got = {(r["qid"], r["path"], r["line_start"]): r["score"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 18 and got[0, "p1", 7] == 1.0 and got[0, "p0", 0] == round(0.5 / 8 + 0.25, 9)


def test_chunks_have_the_words_of_their_text():
    text = "\u0391\u03a3\u00a0a\x0bb\u2028c \u4e2d\u6587,d\x85e\u3000\u0130x\r\n"
    assert basic_words(text) == [w for chunk in chunks(text) for w in basic_words(chunk)]
    table = {"[UNK]": 0, "ab": 1, "##c": 2, "##cd": 3}
    assert piece_ids("abcd", table, 4) == piece_ids("abcd", table) == [1, 3] and piece_ids("abc", table, 4) == [1, 2]
