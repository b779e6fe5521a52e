"""Abstention rules over per-question signals: grids, best cells, frontier, leave-one-set-out.

Questions are never paired with cells. Each is reduced to the last grid step it still passes, those
steps are counted, and suffix sums over the fixed grid give every cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.formats import reaches

# The registered grids.
T_GRID = [round(0.40 + 0.01 * i, 2) for i in range(51)]
M_GRID = [round(0.005 * i, 3) for i in range(21)]
COUNTS = ("b1_num", "b1_den", "b2_num", "b2_den")


def signals(ranked: DataFrame, files: DataFrame, file_sims: DataFrame, passage_sims: DataFrame,
            shown_sims: DataFrame, top: DataFrame) -> DataFrame:
    """One row per question: best, second and margin over the returned files, plus three variants.

    `file_sims` (qid, path, sim) is the best similarity of each returned file; `passage_sims` (qid,
    sim) holds at least the two best passages of the returned files; `shown_sims` (qid, sim) the
    shown passages; `top` (qid, top_score) the best of all passages.
    """
    def best_two(df: DataFrame, first: str, second: str) -> DataFrame:
        # max_by-style: a bounded list per question, two values are kept
        ordered = F.reverse(F.array_sort(F.collect_list("sim")))
        return df.groupBy("qid").agg(ordered.alias("s")).select(
            "qid", F.element_at("s", 1).alias(first), F.try_element_at("s", F.lit(2)).alias(second)
        )

    per_file = best_two(file_sims, "top1", "top2")
    per_passage = best_two(passage_sims, "_p1", "_p2")
    shown = shown_sims.groupBy("qid").agg(F.max("sim").alias("top1_shown"))
    names = files.groupBy("qid").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]),
            "|",
        ).alias("files")
    )
    joined = ranked.drop("got", "top_path")
    for side in (per_file, per_passage, shown, names, top):
        joined = joined.join(side, "qid")
    return joined.select(
        "set", "qid",
        F.when(F.col("answerable"), "answerable").otherwise("unanswerable").alias("label"),
        F.col("hard_negative").cast("int").alias("hard_negative"),
        F.when(F.col("answerable"), F.col("rank").isNotNull().cast("int")).alias("in_top5"),
        "rank", "top1", "top2",
        (F.col("top1") - F.col("top2")).alias("margin"),
        (F.col("_p1") - F.col("_p2")).alias("pmargin"),
        F.col("top_score").alias("top1_printed_global"), "top1_shown", "files",
    )


def _steps(value: Column, grid: list[float]) -> Column:
    """How many grid values the signal reaches: it passes the first that many."""
    marks = F.array(*[F.lit(g) for g in grid])
    return F.size(F.filter(marks, lambda g: value >= g))


def _family(family: str) -> tuple[list[float | None], list[float | None]]:
    if family == "threshold":
        return list(T_GRID), [None]
    if family == "margin":
        return [None], list(M_GRID)
    return list(T_GRID), list(M_GRID)


def _grid(spark: SparkSession, family: str) -> DataFrame:
    ts, ms = _family(family)
    rows = [(i, j, t, m) for i, t in enumerate(ts) for j, m in enumerate(ms)]
    return spark.createDataFrame(rows, "ti int, mi int, t double, m double")


def set_counts(
    rows: DataFrame, family: str = "combined", tkey: str = "top1", mkey: str = "margin"
) -> DataFrame:
    """(set, t, m, four counts): bar 1 and bar 2 of every cell for every set."""
    ts, ms = _family(family)
    no = F.col("label") == "unanswerable"
    hit = ~no & (F.col("in_top5") == 1)
    passed_t = F.lit(1) if ts == [None] else _steps(F.col(tkey), ts)
    passed_m = F.lit(1) if ms == [None] else _steps(F.col(mkey), ms)
    buckets = rows.filter(no | hit).groupBy(
        "set", (passed_t - 1).alias("ti"), (passed_m - 1).alias("mi")
    ).agg(F.count_if(no).alias("no"), F.count_if(hit).alias("hit"))
    totals = buckets.groupBy("set").agg(F.sum("no").alias("b1_den"), F.sum("hit").alias("b2_den"))
    # One line of grid cells per set; the grid has a fixed number of cells.
    cells = totals.select("set", F.explode(F.sequence(F.lit(0), F.lit(len(ts) - 1))).alias("ti"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ms) - 1))).alias("mi"))
    dense = cells.join(buckets, ["set", "ti", "mi"], "left")
    after_m = Window.partitionBy("set", "ti").orderBy(F.desc("mi")).rowsBetween(
        Window.unboundedPreceding, 0)
    after_t = Window.partitionBy("set", "mi").orderBy(F.desc("ti")).rowsBetween(
        Window.unboundedPreceding, 0)
    for name in ("no", "hit"):
        dense = dense.withColumn(name, F.sum(F.coalesce(F.col(name), F.lit(0))).over(after_m))
    for name in ("no", "hit"):
        dense = dense.withColumn(name, F.sum(name).over(after_t))
    named = dense.join(F.broadcast(_grid(rows.sparkSession, family)), ["ti", "mi"])
    return named.join(totals, "set").select(
        "set", "t", "m", (F.col("b1_den") - F.col("no")).alias("b1_num"), "b1_den",
        F.col("hit").alias("b2_num"), "b2_den",
    )


def pooled(counts: DataFrame) -> DataFrame:
    return counts.groupBy("t", "m").agg(*[F.sum(c).alias(c) for c in COUNTS])


def with_pooled(counts: DataFrame) -> DataFrame:
    """Every set and, as set POOLED, their sum."""
    return counts.unionByName(pooled(counts).withColumn("set", F.lit("POOLED")))


def min_fraction() -> Column:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return F.least(share("b1_num", "b1_den"), share("b2_num", "b2_den"))


def _choice(*extra: str) -> Column:
    """Best cell: highest smaller bar, then lowest t, then lowest m."""
    cell = F.struct(
        (-min_fraction()).alias("neg"), F.coalesce("t", F.lit(0.0)).alias("tk"),
        F.coalesce("m", F.lit(0.0)).alias("mk"), "t", "m", *COUNTS, *extra,
    )
    return F.min(cell).alias("c")


def best_cell(cells: DataFrame) -> DataFrame:
    return cells.agg(_choice()).select(
        "c.t", "c.m", *[f"c.{c}" for c in COUNTS], (-F.col("c.neg")).alias("min_frac")
    )


def family_summary(cells: DataFrame) -> DataFrame:
    """One row: the best cell and how many cells meet both bars at 90% and at 80%."""
    def both(p: int) -> Column:
        return reaches(F.col("b1_num"), F.col("b1_den"), p) & reaches(
            F.col("b2_num"), F.col("b2_den"), p)

    return cells.agg(
        _choice(), F.count(F.lit(1)).alias("cells"),
        F.count_if(both(90)).alias("both_90"), F.count_if(both(80)).alias("both_80"),
    ).select(
        "c.t", "c.m", *[f"c.{c}" for c in COUNTS], (-F.col("c.neg")).alias("min_frac"),
        "cells", "both_90", "both_80",
    )


def pareto(cells: DataFrame) -> DataFrame:
    """Cells not dominated on (bar 1, bar 2); the first cell in (t, m) order per distinct pair.

    One pass over the distinct pairs from the highest bar 1 down, keeping those that raise bar 2.
    The window has no partition, but its input is at most one row per grid cell.
    """
    pairs = cells.groupBy("b1_num", "b2_num").agg(
        F.min(F.struct("t", "m", "b1_den", "b2_den")).alias("c")
    )
    above = Window.orderBy(F.desc("b1_num"), F.desc("b2_num")).rowsBetween(
        Window.unboundedPreceding, -1)
    best = F.max("b2_num").over(above)
    kept = pairs.withColumn("_best", best).filter(
        F.col("_best").isNull() | (F.col("b2_num") > F.col("_best"))
    )
    out = kept.select("c.t", "c.m", "b1_num", "c.b1_den", "b2_num", "c.b2_den")
    return out.withColumn("min_frac", min_fraction())


def leave_one_out(counts: DataFrame) -> DataFrame:
    """(held_out, cell, train and test counts): choose the cell on the other sets, score it here.

    The training counts of a fold are the pooled counts less the set's own."""
    total = pooled(counts).select("t", "m", *[F.col(c).alias(f"all_{c}") for c in COUNTS])
    same = F.col("l.t").eqNullSafe(F.col("r.t")) & F.col("l.m").eqNullSafe(F.col("r.m"))
    folds = counts.alias("l").join(F.broadcast(total.alias("r")), same).select(
        "l.set", "l.t", "l.m",
        *[(F.col(f"r.all_{c}") - F.col(f"l.{c}")).alias(c) for c in COUNTS],
        *[F.col(f"l.{c}").alias(f"test_{c}") for c in COUNTS],
    )
    tests = tuple(f"test_{c}" for c in COUNTS)
    chosen = folds.groupBy("set").agg(_choice(*tests))
    ok = reaches(F.col("c.test_b1_num"), F.col("c.test_b1_den"), 80) & reaches(
        F.col("c.test_b2_num"), F.col("c.test_b2_den"), 80)
    return chosen.select(
        F.col("set").alias("held_out"), "c.t", "c.m",
        *[F.col(f"c.{c}").alias(f"train_{c}") for c in COUNTS], *[f"c.{c}" for c in tests],
        ok.alias("both_80"),
    )


def pooled_folds(folds: DataFrame) -> DataFrame:
    return folds.agg(
        *[F.sum(f"test_{c}").alias(c) for c in COUNTS],
        F.count_if("both_80").alias("folds_80"), F.count(F.lit(1)).alias("folds"),
    )


def score_groups(rows: DataFrame) -> DataFrame:
    """Rows by group hit, miss or unans, once under their set and once under POOLED."""
    group = (
        F.when(F.col("label") == "unanswerable", "unans")
        .when(F.col("in_top5") == 1, "hit").otherwise("miss")
    )
    return rows.withColumn("grp", group).withColumn(
        "set", F.explode(F.array(F.col("set"), F.lit("POOLED")))
    )


def integrity(rows: DataFrame) -> DataFrame:
    """One row: sizes, uniqueness of (set, id), and how often the top-1 variants differ."""
    differs = lambda c: F.count_if(F.abs(F.col("top1") - F.col(c)) > 1e-12)
    keys = rows.groupBy("set", "qid").count().agg(
        F.coalesce(F.max("count"), F.lit(1)).alias("most")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == "answerable").alias("answerable"),
        F.count_if(F.col("label") == "unanswerable").alias("unanswerable"),
        F.count_if(F.col("in_top5") == 1).alias("hits"),
        F.count_if(F.col("in_top5") == 0).alias("misses"),
        differs("top1_printed_global").alias("global_differs"),
        differs("top1_shown").alias("shown_differs"),
    ).withColumn("unique_ids", keys.scalar() == 1)
