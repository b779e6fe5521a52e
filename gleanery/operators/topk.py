"""Top-k per group and exact order statistics that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.scan import laid_out, running
from gleanery.session import materialise, small_side


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    slices: int = 1,
) -> DataFrame:
    """The first `k` rows of each group under a total order, with their rank.

    Catalyst limits each group inside every input partition before the shuffle. With `slices`
    the survivors are merged in two steps, so that one hot group is not merged by one task.
    """
    if slices > 1:
        part = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.spark_partition_id() % slices)
            .withColumn("_near", F.row_number().over(part))
            .filter(F.col("_near") <= k)
            .drop("_slice", "_near")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: dict[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """Exact values at 1-based positions of each group's sorted `value`, with the group's n, min and max.

    `positions` maps an output name to a position computed from the column `n`, the group size. Equal values are
    counted first, map-side. The counts of different values are dealt to ranges of (keys, value) and summed up
    over the ranges, so that a group of any size and any spread of values, outliers included, lies in many
    tasks; a position is found in the one range that its running count falls in.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    stored = laid_out(counted, keys, ["_v"], ranges=ranges)
    span = stored.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), pos.cast("bigint").alias("pos")) for name, pos in positions.items()])
    wanted = span.select(*keys, F.explode(wanted).alias("w")).select(*keys, "w.name", "w.pos")
    summed = running(stored, keys, {"_to": ("sum", F.col("_c"))})
    hit = _join(summed, small_side(wanted), keys).filter((F.col("_to") - F.col("_c") < F.col("pos")) & (F.col("pos") <= F.col("_to")))
    found = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in positions])
    return _join(span, found, keys)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """On the keys; without keys `right` has a row or a few, and goes to all tasks."""
    if keys:
        return left.join(right, keys)
    return left.withColumn("_one", F.lit(1)).join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one")


def nearest_rank(quantile: float) -> Column:
    """Position of the nearest-rank quantile: ceil(q n)."""
    return F.ceil(F.lit(quantile) * F.col("n"))


def median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """True median with the group's n, min and max."""
    n = F.col("n")
    out = order_statistics(
        df, keys, value, {"_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1}
    )
    return out.withColumn("median", (F.col("_a") + F.col("_b")) / 2.0).drop("_a", "_b")


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The upper of the two middle values when n is even."""
    return order_statistics(df, keys, value, {"upper_median": F.floor(F.col("n") / 2) + 1})


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Global row numbers under a total order, without one task that sees every row.

    The rows are range-partitioned and written once, so that the numbers of a partition can start
    where the counts of those before it end.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stored = materialise(ranged, "numbered")
    counts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        stored.withColumn("_near", F.row_number().over(inside))
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(name, F.col("_start") + F.col("_near"))
        .drop("_part", "_start", "_near")
    )


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables side by side."""
    return _join(left, right, [])
