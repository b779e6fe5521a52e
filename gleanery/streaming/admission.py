"""The rolling allowance as a stream: at most `limit` stamps of state per key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.operators.limits import MICROS, micros
from gleanery.params import DEFAULT_LIMITS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, event_id bigint, us bigint, admitted boolean"
STAMPS = "us bigint"


class Admission(StatefulProcessor):
    """Admit while fewer than `limit` admitted stamps are younger than the window.

    The state holds at most `limit` stamps per key, and a timer: when the watermark passes the end of the youngest
    stamp's window, nothing that can still come is held back by it, and the key leaves the state.
    """

    def __init__(self, limit: int, window_us: int) -> None:
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stamps = handle.getListState("stamps", STAMPS)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        held = [s[0] for s in self.stamps.get()] if self.stamps.exists() else []
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        admitted = []
        for now in batch["us"].tolist():
            held = [s for s in held if s > now - self.window_us]
            admitted.append(len(held) < self.limit)
            if admitted[-1]:
                held.append(now)
        self.stamps.put([(s,) for s in held])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer((held[-1] + self.window_us) // 1000 + 1)
        yield pd.DataFrame({
            "key": [key[0]] * len(batch), "event_id": batch["event_id"].to_numpy(),
            "us": batch["us"].to_numpy(), "admitted": admitted,
        })

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.stamps.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """List state needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def admissions(
    requests: DataFrame,
    limit: int = DEFAULT_LIMITS.admitted_per_hour,
    window_us: int = DEFAULT_LIMITS.window_seconds * MICROS,
    late: str = "1 hour",
) -> DataFrame:
    """Stream of (key, event_id, us, admitted) from a stream of (key, event_id, ts).

    Requests may come `late` after younger ones; what comes later still is not decided, as in any watermarked
    stream. A micro-batch holds the rows of a key in memory; bound its size at the source for hot keys.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("key", "event_id", micros(F.col("ts")).alias("us"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Admission(limit, window_us),
        outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )


def usage_by_day(outcomes: DataFrame, late: str = "1 day") -> DataFrame:
    """Stream of day totals from a stream of (ts, outcome): answered, refused and asked."""
    answered = F.count_if(F.col("outcome") == "answer")
    refused = F.count_if(F.col("outcome") == "no_confident_match")
    return outcomes.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(
        answered.alias("answered"), refused.alias("refused")
    ).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "answered", "refused",
        (F.col("answered") + F.col("refused")).alias("asked"),
    )
