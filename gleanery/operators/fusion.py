"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60
FUSION_DEPTH = 100


def rrf(
    lists: Sequence[DataFrame], keys: Sequence[str], k: int = RRF_K, depth: int = FUSION_DEPTH
) -> DataFrame:
    """(keys, score): sum of 1/(k + rank) over the first `depth` of each list.

    Each list has `keys` and `rank`. A key occurs at most twice, and adding two numbers gives the
    same bits in either order, so ties are exact.
    """
    first, *rest = [df.filter(F.col("rank") <= depth).select(*keys, "rank") for df in lists]
    rows = first
    for df in rest:
        rows = rows.unionByName(df)
    share = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    return rows.groupBy(*keys).agg(F.sum(share).alias("score"))
