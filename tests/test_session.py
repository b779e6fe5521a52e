from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.session import small_side


def hinted(df) -> bool:
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


def test_a_side_is_broadcast_only_below_both_bounds(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("long text"), F.array("id").alias("list"))
    assert hinted(small_side(df))
    assert not hinted(small_side(df, rows=99))
    assert not hinted(small_side(df, size=90_000))
    assert hinted(small_side(df.limit(0)))
