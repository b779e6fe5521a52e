"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

The index is built once and timed as `ingest`; every other figure reads it, warm, and is the time to
compute all rows of the query without bringing them to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from gleanery.plans import catalog
from gleanery.plans import fixtures as fx
from gleanery.plans.retrieve import retrieve
from gleanery.session import local_session

HEADLINES = (
    "bm25_files", "bm25_passages", "dense_top", "rrf_files", "dense_passages", "tok_words",
    "md_sections", "limit_rolling", "spend_days", "rerank_files", "sweep_combined", "transcript_usage",
)


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("gleanery-bench", cores=cores, shuffle=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    consume(fx.table(spark, sf_dir, "region"))  # session start is not a query
    times = {"ingest": timed(lambda: fx.index_of(spark, sf_dir))}
    index, questions = fx.index_of(spark, sf_dir), fx.questions(spark, sf_dir)
    times["retrieve"] = timed(lambda: consume(retrieve(index, questions)))
    times["signals"] = timed(lambda: consume(catalog.signals_of(spark, sf_dir)))
    for name in HEADLINES:
        times[name] = timed(lambda name=name: consume(catalog.QUERIES[name](spark, sf_dir)))
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": cores, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    return 0


if __name__ == "__main__":
    sys.exit(main())
