from __future__ import annotations

from gleanery.operators import evaluation


def test_questions_without_result_or_verdict_stay(spark):
    ranked = spark.createDataFrame(
        [(1, True, False, 2, "a", ["a"], "x, a", "x"), (2, True, False, None, None, ["b"], "x", "x"), (3, False, True, None, None, [], None, None)],
        "qid bigint, answerable boolean, hard_negative boolean, rank int, hit_path string, sources array<string>, got string, top_path string",
    )
    top = spark.createDataFrame([(1, 0.5), (2, 0.25)], "qid bigint, top_score double")
    lines = {r.qid: r.line for r in evaluation.report_lines(evaluation.outcomes(ranked, top)).collect()}
    assert lines == {
        1: "1  HIT   a (rank 2)  top score 0.50", 2: "2  MISS  expected b; got x  top score 0.25", 3: "3  ERROR nothing to search for",
    }
    verdicts = spark.createDataFrame([(1, "ANSWERABLE")], "qid bigint, verdict string")
    rows = {r.qid: r for r in evaluation.judge_rows(ranked, verdicts).collect()}
    assert {q: r.verdict for q, r in rows.items()} == {1: "ANSWERABLE", 2: "JUDGE_ERROR", 3: "JUDGE_ERROR"}
    assert evaluation.judge_bars(evaluation.judge_rows(ranked, verdicts)).first()["judge_errors"] == 2


def test_key_entries_and_commits(spark):
    key = spark.createDataFrame([("r1", "s", 1), ("r2", "s", 9)], "run_id string, set string, qid bigint")
    entries = spark.createDataFrame([("s", 1, True), ("t", 9, True)], "set string, qid bigint, answerable boolean")
    got = {r.run_id: (r.found, r.answerable) for r in evaluation.key_entries(key, entries).collect()}
    assert got == {"r1": (True, True), "r2": (False, None)}
    pinned = spark.createDataFrame([("s", "c1"), ("s", "c1"), ("t", "c2"), ("u", None)], "set string, pinned string")
    assert sorted((r.set, r.questions) for r in evaluation.commit_faults(pinned, "c2").collect()) == [("s", 2), ("u", 1)]
