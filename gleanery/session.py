"""Session settings and the two guards every operator uses: shared storage and size checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(app: str = "gleanery", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and the local bench. A cluster passes its own session instead."""
    return attach(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", os.environ.get("GLEANERY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows and bytes of a batch sent to Python at once, unless the session names numbers of its own: what a worker holds
#: hangs on these, not on the size of a partition.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 2_000), "spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, 16 << 20)}


def attach(spark: SparkSession) -> SparkSession:
    """Pin UTC, bound what is sent to Python, and make this package importable in the workers, once per application."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, (usual, ours) in BATCH.items():
        if spark.conf.get(name).rstrip("bB") == str(usual):
            spark.conf.set(name, str(ours))
    sc = spark.sparkContext
    if getattr(sc, "_gleanery_attached", False):
        return spark
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="gleanery-code-")) / "gleanery.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(bundle))
    sc._gleanery_attached = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="gleanery-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 128 << 20


def small_side(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if a count of rows and bytes shows it is small; else it is left to a
    shuffled join."""
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_width(df)).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= rows and (seen["bytes"] or 0) <= size else df


def _width(df: DataFrame) -> Column:
    """About the bytes of a row: texts and lists by their lengths, all else eight."""
    total = F.lit(0).cast("long")
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total += F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total += F.lit(8)
    return total


def at_most(df: DataFrame, rows: int) -> bool:
    """True when `df` has no more than `rows` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows
