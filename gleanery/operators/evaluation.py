"""Labelled question sets: hits, bars, diagnostics, reports and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.formats import fixed, percent, reaches
from gleanery.operators.topk import numbered
from gleanery.params import (
    ANSWERABLE,
    BEST_SCORE_THRESHOLD,
    JUDGE_ERROR,
    NOTHING,
    NOT_ANSWERABLE,
    REQUIRED_PERCENT,
)


def right_rank(questions: DataFrame, files: DataFrame) -> DataFrame:
    """questions plus `rank` and `hit_path`: the first ranked file among the expected sources."""
    inside = F.array_contains(F.col("sources"), F.col("path"))
    first = F.min(F.when(inside, F.struct("rank", "path")))
    # At most top_k files per question: the list of what was found is bounded.
    got = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), ", "
    )
    found = questions.select("qid", "sources").join(files, "qid").groupBy("qid").agg(
        first.alias("_first"), got.alias("got"), F.min_by("path", "rank").alias("top_path")
    )
    return questions.join(found, "qid", "left").select(
        *questions.columns,
        F.when(F.col("answerable"), F.col("_first.rank")).alias("rank"),
        F.when(F.col("answerable"), F.col("_first.path")).alias("hit_path"),
        "got", "top_path",
    )


def outcomes(ranked: DataFrame, top: DataFrame) -> DataFrame:
    """(qid, label, detail): HIT, MISS or DIAG with the line the report prints."""
    score = F.concat(F.lit("top score "), fixed(F.col("top_score"), 2))
    tag = F.when(F.col("hard_negative"), " [hard negative]").otherwise("")
    hit = F.col("rank").isNotNull()
    detail = (
        F.when(~F.col("answerable"), F.concat(F.lit("top file "), "top_path", F.lit("  "), score, tag))
        .when(hit, F.concat(F.col("hit_path"), F.format_string(" (rank %d)  ", "rank"), score))
        .otherwise(F.concat(
            F.lit("expected "), F.array_join("sources", " | "), F.lit("; got "), "got",
            F.lit("  "), score,
        ))
    )
    label = F.when(~F.col("answerable"), "DIAG").when(hit, "HIT").otherwise("MISS")
    # a question that nothing was searched for stays in the report
    lost = F.col("top_score").isNull()
    return ranked.join(top, "qid", "left").select(
        "qid", F.when(lost, "ERROR").otherwise(label).alias("label"), F.when(lost, NOTHING).otherwise(detail).alias("detail")
    )


def report_lines(results: DataFrame) -> DataFrame:
    return results.select("qid", F.format_string("%s  %-6s%s", F.col("qid").cast("string"), "label", "detail").alias("line"))


def eval_score(ranked: DataFrame) -> DataFrame:
    """One row: hits, totals, percentage and the 80% gate over answerable questions."""
    return ranked.agg(
        F.count_if(F.col("answerable") & F.col("rank").isNotNull()).alias("hits"),
        F.count_if("answerable").alias("answerable_total"),
        F.count_if(~F.col("answerable")).alias("unanswerable_total"),
    ).select(
        "*",
        percent(F.col("hits"), F.col("answerable_total")).alias("hit_rate"),
        reaches(F.col("hits"), F.col("answerable_total"), REQUIRED_PERCENT).alias("passed"),
    )


def judge_rows(ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(qid, verdict, expected, agreement) beside the question fields; a question without verdict is a judge error."""
    token = F.col("verdict")
    hit = F.col("rank").isNotNull()
    want = F.when(~F.col("answerable"), NOT_ANSWERABLE).when(hit, ANSWERABLE)
    judged = ranked.join(verdicts.select("qid", "verdict"), "qid", "left").withColumn("verdict", F.coalesce("verdict", F.lit(JUDGE_ERROR)))
    return judged.select(
        "qid", "answerable", "hard_negative", "rank", "verdict",
        F.when(~F.col("answerable"), "abstain")
        .when(hit, F.format_string("show (right file rank %d)", "rank"))
        .otherwise("show (right file not in top 5)").alias("expected"),
        F.when(want.isNull(), "n/a").when(token == want, "AGREE").otherwise("DIFF")
        .alias("agreement"),
    )


def judge_bars(rows: DataFrame) -> DataFrame:
    """One row: both abstention bars, errors, hard negatives and the end-to-end count."""
    no, hit = ~F.col("answerable"), F.col("answerable") & F.col("rank").isNotNull()
    refused, shown = F.col("verdict") == NOT_ANSWERABLE, F.col("verdict") == ANSWERABLE
    counts = rows.agg(
        F.count_if(no & refused).alias("abstained"),
        F.count_if(no).alias("unanswerable_total"),
        F.count_if(hit & shown).alias("shown"),
        F.count_if(hit).alias("hit_total"),
        F.count_if("answerable").alias("answerable_total"),
        F.count_if(F.col("verdict") == JUDGE_ERROR).alias("judge_errors"),
        F.count_if(no & F.col("hard_negative") & refused).alias("hard_abstained"),
        F.count_if(no & F.col("hard_negative")).alias("hard_total"),
    )
    return counts.select(
        "*",
        reaches(F.col("abstained"), F.col("unanswerable_total"), REQUIRED_PERCENT).alias("bar1_met"),
        reaches(F.col("shown"), F.col("hit_total"), REQUIRED_PERCENT).alias("bar2_met"),
    )


def judge_summary(bars: DataFrame) -> DataFrame:
    """The two bar lines of the report."""
    def line(label: str, part: str, total: str, met: str) -> Column:
        return F.format_string(
            f"{label}%d/%d (%s)  required >= {REQUIRED_PERCENT}%%  %s", part, total,
            percent(F.col(part), F.col(total)), F.when(F.col(met), "MET").otherwise("NOT MET"),
        )

    long = "bar 2 (answerable, right file in top 5, not abstained):"
    short = "bar 1 (unanswerable abstained):"
    return bars.select(
        line(f"{short:<{len(long) + 1}}", "abstained", "unanswerable_total", "bar1_met").alias("bar1"),
        line(f"{long} ", "shown", "hit_total", "bar2_met").alias("bar2"),
        F.format_string(
            "end to end: answerable questions whose right file is shown after judging: "
            "%d/%d (diagnostic)", "shown", "answerable_total",
        ).alias("end_to_end"),
    )


def over_abstention(rows: DataFrame) -> DataFrame:
    """One row: refused hits, shown misses, and which bar each judge error belongs to."""
    hit = F.col("answerable") & F.col("rank").isNotNull()
    miss = F.col("answerable") & F.col("rank").isNull()
    error = F.col("verdict") == JUDGE_ERROR
    return rows.agg(
        F.count_if(hit & (F.col("verdict") == NOT_ANSWERABLE)).alias("over_abstained"),
        F.count_if(hit).alias("hit_total"),
        F.count_if(miss & (F.col("verdict") == ANSWERABLE)).alias("shown_without_hit"),
        F.count_if(miss).alias("miss_total"),
        F.count_if(error & ~F.col("answerable")).alias("errors_bar1"),
        F.count_if(error & hit).alias("errors_bar2"),
        F.count_if(error & miss).alias("errors_neither"),
    )


def best_score_rule(
    ranked: DataFrame, best: DataFrame, keys: tuple[str, ...] = (),
    threshold: float = BEST_SCORE_THRESHOLD,
) -> DataFrame:
    """Counts of the rule that abstains below a best similarity over the returned files."""
    low = F.col("top1") < threshold
    no, hit = ~F.col("answerable"), F.col("answerable") & F.col("rank").isNotNull()
    return ranked.join(best, "qid").groupBy(*keys).agg(
        F.count_if(no & low).alias("abstained"),
        F.count_if(no).alias("unanswerable"),
        F.count_if(hit & ~low).alias("shown"),
        F.count_if(hit).alias("hits"),
    )


def reproduces(counts: DataFrame, bar1: tuple[int, int], bar2: tuple[int, int]) -> DataFrame:
    """Sum the sets' counts and compare them with the recorded figures."""
    names = ("abstained", "unanswerable", "shown", "hits")
    total = counts.agg(*[F.sum(n).alias(n) for n in names])
    want = dict(zip(names, (*bar1, *bar2)))
    same = F.lit(True)
    for name, value in want.items():
        same = same & (F.col(name) == value)
    return total.select(*names, same.alias("reproduced"))


def derive_sample(ranked: DataFrame) -> DataFrame:
    """(run_id, set_index, qid, role): every unanswerable question, every second hit, one smoke row.

    `ranked` carries set_index and position. The order is global, so rows are numbered by ranges.
    """
    order = ["set_index", "position"]
    hits = numbered(
        ranked.filter(F.col("answerable") & F.col("rank").isNotNull()).select(*order, "qid"),
        order, "turn",
    )
    odd = hits.filter(F.col("turn") % 2 == 1).drop("turn")
    chosen = ranked.filter(~F.col("answerable")).select(*order, "qid").unionByName(odd)
    sample = numbered(chosen, order, "turn").select(
        F.format_string("r%03d", "turn").alias("run_id"), *order, "qid", F.lit("sample").alias("role")
    )
    size = sample.agg((F.count(F.lit(1)) + 1).alias("turn"))  # the smoke row is numbered after the sample
    smoke = hits.filter(F.col("turn") == 2).drop("turn").join(F.broadcast(size)).select(
        F.format_string("r%03d", "turn").alias("run_id"), *order, "qid", F.lit("smoke").alias("role")
    )
    return sample.unionByName(smoke)


def per_set_counts(sample: DataFrame) -> DataFrame:
    return sample.groupBy("set_index", "role").agg(F.count(F.lit(1)).alias("rows"))


def sample_faults(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Sets whose count differs from the registered one."""
    joined = counts.join(
        expected.withColumnRenamed("rows", "want"), ["set_index", "role"], "full"
    )
    return joined.filter(~F.col("rows").eqNullSafe(F.col("want")))


GATE_REFUSALS = (
    "no_confident_match", "empty_question", "unusable_question", "too_long", "bad_request",
    "body_too_large",
)


def gate_rows(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """(qid, kind, verdict): PASS, FAIL or NOT RUN for each question of a service gate."""
    joined = questions.join(responses, "qid", "left")
    shown = F.size(F.array_intersect("sources", "files")) > 0
    passed = F.when(F.col("kind") == "answerable", (F.col("outcome") == "answer") & shown).otherwise(
        F.col("outcome").isin(*GATE_REFUSALS) & (F.size("files") == 0)
    )
    return joined.select(
        "qid", "kind", "seconds",
        F.when(F.col("outcome").isNull(), "NOT RUN").when(passed, "PASS").otherwise("FAIL")
        .alias("verdict"),
    )


def gate_bars(rows: DataFrame) -> DataFrame:
    ran = F.col("verdict") != "NOT RUN"
    yes = F.col("kind") == "answerable"
    return rows.agg(
        F.count_if(~yes & (F.col("verdict") == "PASS")).alias("bar1"),
        F.count_if(~yes & ran).alias("bar1_total"),
        F.count_if(yes & (F.col("verdict") == "PASS")).alias("bar2"),
        F.count_if(yes & ran).alias("bar2_total"),
    )


def result_faults(results: DataFrame) -> DataFrame:
    """(qid, fault): broken invariants of a result. Empty means every result is well formed."""
    files = results.groupBy("qid", "path").agg(
        F.min("rank").alias("rank"), F.count_distinct("rank").alias("ranks"),
        F.count(F.lit(1)).alias("rows"), F.count_distinct("line_start").alias("starts"),
    )
    each = files.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("distinct_ranks"),
        F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.max(F.col("ranks") > 1).alias("moved"), F.max(F.col("rows") != F.col("starts")).alias("twice"),
    )
    faults = F.array_compact(F.array(
        F.when((F.col("low") != 1) | (F.col("high") != F.col("n"))
               | (F.col("distinct_ranks") != F.col("n")), "ranks are not 1..n"),
        F.when(F.col("moved"), "a file has two ranks"),
        F.when(F.col("twice"), "a passage is repeated"),
    ))
    return each.select("qid", F.explode(faults).alias("fault"))


def key_entries(key: DataFrame, entries: DataFrame) -> DataFrame:
    """A sample key (run_id, set, qid) with the fields of the entries it names; `found` is false where no set has it."""
    named = entries.withColumn("_there", F.lit(True))
    return key.join(named, ["set", "qid"], "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


def commit_faults(questions: DataFrame, commit: str) -> DataFrame:
    """(set, pinned, indexed, questions) of each set of `questions` (set, pinned) that the index's commit doesn't fit."""
    return questions.filter(~F.col("pinned").eqNullSafe(F.lit(commit))).groupBy("set", "pinned").agg(
        F.count(F.lit(1)).alias("questions")
    ).withColumn("indexed", F.lit(commit))
