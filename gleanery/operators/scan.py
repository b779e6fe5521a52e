"""Running totals over ordered groups of any size: a group is never one task's work.

Rows are dealt to ranges of their order and written once. Each range adds up its own rows; what the ranges
before it hold of the same group is a table with at most one row for each range, which is added on top.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import materialise

#: How values of a kind are gathered, and how two results are joined (both in any grouping).
KINDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None, ranges: int | None = None) -> DataFrame:
    """`df` in ranges of (keys, order), nulls first, written once with `_part`, the range, and `_at`, the place.

    `keep` names the columns that are wanted afterwards; columns that only order the rows need not be among them.
    Spark picks the number of ranges by size unless `ranges` says it.
    """
    ranged = df.repartitionByRange(*([ranges] if ranges else []), *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    return materialise(ranged.select(*(keep or df.columns), "_part", "_at"), "ranges")


def running(stored: DataFrame, keys: Sequence[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """`stored`, as `laid_out` gives it for these keys, with running values up to and with each row.

    `values` maps a name to a kind of KINDS and a column. Null values are passed over; a value is null until the
    first that isn't. Null keys are a group like any other.
    """
    own = stored.withColumns({f"_v_{name}": column for name, (_, column) in values.items()})
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("_part", *keys).agg(*[KINDS[kind][0](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in values.items()])
    carry = totals.select(
        F.col("_part").alias("_cpart"), *[F.col(k).alias(f"_ck_{n}") for n, k in enumerate(keys)],
        F.count(F.lit(1)).over(before).alias("_parts"),
        *[KINDS[kind][0](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    ).filter("_parts > 0")  # a range goes on with one group at most: no more rows than ranges
    same = [F.col(k).eqNullSafe(F.col(f"_ck_{n}")) for n, k in enumerate(keys)]
    local = own.withColumns({f"_l_{name}": KINDS[kind][0](f"_v_{name}").over(inside) for name, (kind, _) in values.items()})
    joined = local.join(F.broadcast(carry), reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_cpart")), "left")

    def whole(name: str, kind: str) -> Column:
        a, b = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        return F.coalesce(KINDS[kind][1](a, b), a, b)

    return joined.select(*stored.columns, *[whole(name, kind).alias(name) for name, (kind, _) in values.items()])
