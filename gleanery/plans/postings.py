"""Postings laid out by term, so that a question batch reads only the parts its terms lie in.

Terms are dealt to buckets by hash; a bucket is a partition directory. A bucket whose postings would make one
large file, as that of a frequent term does, is split further by bag into slices of bounded size, each a file
sorted by term. A join of weighted terms with the postings on (bucket, term) is pruned while it runs: Spark hands
the buckets of the broadcast terms to the scan (dynamic partition pruning), and within a file row groups whose
range of terms misses are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import materialise

#: Postings that a bucket should hold, and that a file may hold.
BUCKET_ROWS, FILE_ROWS = 20_000_000, 4_000_000
#: Tasks for each file, so that few of the files that hashing deals out fall to the same task.
TASKS_A_FILE = 3
#: Directories, at least and at most. Few are enough while everything fits a handful of files.
FEWEST, MOST = 16, 4_096


def buckets_for(postings: int) -> int:
    """A power of two, so that a larger corpus splits buckets instead of dealing terms anew."""
    n = FEWEST
    while n < MOST and postings > n * BUCKET_ROWS:
        n *= 2
    return n


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def write_postings(bags: DataFrame, keys: Sequence[str], path: str, file_rows: int = FILE_ROWS) -> int:
    """Write `bags` (keys, term, ...; a written table: it is read twice) by bucket. Returns the number of buckets."""
    buckets = buckets_for(bags.count())
    placed = bags.withColumn("bucket", bucket_of(F.col("term"), buckets))
    slices = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("_slices"))
    slices = materialise(slices, "slices")
    spread = placed.join(F.broadcast(slices), "bucket")  # MOST rows at most
    spread = spread.withColumn("_slice", F.pmod(F.xxhash64(*keys), F.col("_slices")))
    files = slices.agg(F.sum("_slices")).first()[0] or 1
    (
        spread.repartition(TASKS_A_FILE * files, "bucket", "_slice").sortWithinPartitions("bucket", "term").drop("_slices", "_slice")
        .write.partitionBy("bucket").parquet(path)
    )
    return buckets
