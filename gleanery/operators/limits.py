"""Replay of a request log through rolling allowances. Admission feeds back on itself.

Ordinary keys are sorted by key and time, spilling as needed, and folded with a state of a few
stamps. A key with too many rows for one task is replayed window by window instead, all its rows
spread over the cluster.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.topk import numbered, top_k
from gleanery.params import DEFAULT_LIMITS
from gleanery.session import MAX_BROADCAST_ROWS, at_most, materialise, scratch_path, small_side

MICROS = 1_000_000
HOT_ROWS = 5_000_000
#: Before every row: the place at which an era is full from its start.
NEVER = -(1 << 62)


@dataclass(frozen=True)
class Allowance:
    """At most `limit` stamps per window. Rows where `counted` is false pass without a stamp."""

    limit: int
    counted: str | None = None  # a boolean column; None counts every accepted row


def micros(ts: Column) -> Column:
    """Event time in microseconds; zone-less stamps are read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def _steps(pdf: pd.DataFrame, allowances: Sequence[Allowance]) -> list[tuple[bool, ...]]:
    flags = [
        [True] * len(pdf) if a.counted is None else pdf[a.counted].tolist() for a in allowances
    ]
    return list(zip(*flags))


class _Fold:
    """The stamps of one key, one queue per allowance."""

    def __init__(self, allowances: Sequence[Allowance], window: int) -> None:
        self.limits, self.window = [a.limit for a in allowances], window
        self.queues: list[deque[int]] = [deque() for _ in allowances]

    def expire(self, now: int) -> None:
        for queue in self.queues:
            while queue and queue[0] <= now - self.window:
                queue.popleft()

    def full(self) -> bool:
        return any(len(q) >= limit for q, limit in zip(self.queues, self.limits))

    def admit(self, now: int, counted: tuple[bool, ...]) -> bool:
        self.expire(now)
        if self.full():
            return False
        for queue, flag in zip(self.queues, counted):
            if flag:
                queue.append(now)
        return True


def _fold_sorted(events: DataFrame, allowances: Sequence[Allowance], window: int) -> DataFrame:
    names = events.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        for pdf in batches:
            out = []
            for k, now, flags in zip(
                pdf["key"].tolist(), pdf["us"].tolist(), _steps(pdf, allowances)
            ):
                if fold is None or k != key:
                    key, fold = k, _Fold(allowances, window)
                out.append(fold.admit(now, flags))
            yield pdf.assign(admitted=pd.array(out, dtype=bool))

    sorted_rows = events.repartition("key").sortWithinPartitions("key", "us", "event_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return sorted_rows.select(*names).mapInPandas(run, f"{schema}, admitted boolean")


def _replay_hot(
    events: DataFrame, allowances: Sequence[Allowance], window: int
) -> DataFrame:
    """Hot keys window by window: `admitted` for every row, no key in one task.

    Inside a window-long block nothing admitted in the block expires, so between two expiries of
    older stamps (an era) allowances only fill up. Of the rows that leave the same stamps only the
    first few of an era can be admitted: a distributed top-k finds them, and they are folded per
    key. A row that leaves no stamp is admitted if it comes before the row that fills an allowance.
    The stamps go on to the next block.
    """
    spark = events.sparkSession
    most = max(a.limit for a in allowances)
    path, won = scratch_path(spark, "hot"), scratch_path(spark, "hot-admitted")
    blocked = events.withColumn("block", F.floor(F.col("us") / window))
    blocked.write.partitionBy("block").parquet(path)
    stored = spark.read.schema(blocked.schema).parquet(path)
    flags = [a.counted for a in allowances if a.counted]
    stamps = F.array(*(F.lit(True) if a.counted is None else F.col(a.counted) for a in allowances))
    stampless = len(flags) == len(allowances)  # rows without any stamp can occur
    out_schema = "key string, us bigint, event_id bigint, stamps array<boolean>, era int"
    none = F.array().cast("array<struct<us:bigint,stamps:array<boolean>>>")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        key, old = pdf["key"].iloc[0], pdf["old"].iloc[0]
        old = sorted(old if old is not None else [], key=lambda s: s["us"])
        fold = _Fold(allowances, window)
        for stamp in old:
            for queue, flag in zip(fold.queues, stamp["stamps"]):
                if flag:
                    queue.append(stamp["us"])
        pdf = pdf.assign(_flags=_steps(pdf, allowances)).sort_values(["us", "event_id"])
        eras = dict(iter(pdf.groupby("_era")))
        out = []
        for era in range(len(old) + 1):
            if era:
                fold.expire(old[era - 1]["us"] + window)
            if fold.full():
                out.append((key, NEVER, NEVER, None, era))
                continue
            rows = eras.get(era)
            for now, eid, flag in zip(*(rows[c] for c in ("us", "event_id", "_flags"))) if rows is not None else ():
                if any(flag) and fold.admit(now, flag):
                    out.append((key, now, eid, list(flag), era))
                    if fold.full():
                        out.append((key, now, eid, None, era))
                        break
        return pd.DataFrame(out, columns=["key", "us", "event_id", "stamps", "era"])

    held: DataFrame | None = None
    last = None
    for (block,) in stored.select("block").distinct().orderBy("block").toLocalIterator():
        rows = stored.filter(F.col("block") == block).drop("block")
        if held is None or last != block - 1:
            near = rows.withColumn("old", none)
        else:
            near = rows.join(small_side(held), "key", "left")
        ended = F.size(F.filter(F.coalesce("old", none), lambda s: s["us"] + window <= F.col("us")))
        near = near.withColumn("_era", ended).withColumn("_stamps", stamps)
        first = top_k(near, ["key", "_era", "_stamps"], [F.asc("us"), F.asc("event_id")], most)
        # A few rows of each era, key and set of stamps: the groups are small.
        settled = first.select("key", "us", "event_id", "old", "_era", *dict.fromkeys(flags)).groupBy("key").applyInPandas(
            settle, out_schema
        )
        settled.write.parquet(f"{won}/block={block}")  # also when nothing is admitted
        settled = spark.read.schema(out_schema).parquet(f"{won}/block={block}")
        if stampless:
            filled = settled.filter("stamps is null").select(
                "key", F.col("era").alias("_era"), F.struct("us", "event_id").alias("_filled")
            )
            free = near.filter(~F.exists("_stamps", lambda x: x)).join(small_side(filled), ["key", "_era"], "left")
            free = free.filter(F.col("_filled").isNull() | (F.struct("us", "event_id") < F.col("_filled")))
            free.select("key", "us", "event_id", F.col("_stamps").alias("stamps"), F.col("_era").alias("era")).write.mode(
                "append"
            ).parquet(f"{won}-free/block={block}")
        held = (
            settled.filter("stamps is not null").groupBy("key")
            .agg(F.collect_list(F.struct("us", "stamps")).alias("old"))
        )
        last = block
    chosen = spark.read.schema(out_schema).parquet(won).filter("stamps is not null").select("key", "event_id")
    if stampless:
        chosen = chosen.unionByName(spark.read.schema(out_schema).parquet(f"{won}-free").select("key", "event_id"))
    return stored.drop("block").join(
        chosen.withColumn("admitted", F.lit(True)), ["key", "event_id"], "left"
    ).withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def rolling_admission(
    events: DataFrame,
    allowances: Sequence[Allowance],
    window_us: int = DEFAULT_LIMITS.window_seconds * MICROS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`events` (key string, us, event_id, flags) plus `admitted`, by (us, event_id) per key.

    A stamp exactly one window old has expired. Refused rows leave no stamp.
    """
    sizes = events.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    hot = materialise(sizes.filter(F.col("_n") > hot_rows).select("key"), "hot-keys")
    if at_most(hot, 0):
        return _fold_sorted(events, allowances, window_us)
    hint = F.broadcast if at_most(hot, MAX_BROADCAST_ROWS) else (lambda side: side)
    usual = events.join(hint(hot), "key", "left_anti")
    busy = _replay_hot(events.join(hint(hot), "key", "left_semi"), allowances, window_us)
    folded = _fold_sorted(usual, allowances, window_us)
    return folded.unionByName(busy.select(*folded.columns))


def result_store(
    puts: DataFrame,
    ttl_us: int = DEFAULT_LIMITS.result_ttl_seconds * MICROS,
    entries: int = DEFAULT_LIMITS.result_entries,
) -> DataFrame:
    """(token, us, gone_us): until when each stored result can be read.

    It goes when its time is up or when `entries` newer ones have come, whichever is first. All
    live as long as each other, so the entry pushed out is always the one put that many before.
    """
    turn = numbered(puts, ["us", "token"], "turn")
    pushed = turn.select((F.col("turn") - entries).alias("turn"), F.col("us").alias("_pushed"))
    return turn.join(pushed, "turn", "left").select(
        "token", "us", F.least(F.col("us") + ttl_us, "_pushed").alias("gone_us")
    )


def key_capacity(
    events: DataFrame, max_keys: int, window_us: int = DEFAULT_LIMITS.window_seconds * MICROS
) -> DataFrame:
    """(slot, active_keys, within_bound): keys seen in each window-long slot or the one before.

    A bound on keys holds wherever this stays within `max_keys`. Counting is by time buckets, so no
    task sees the whole log; new keys beyond the bound are not refused.
    """
    spans = events.groupBy("key", F.floor(F.col("us") / window_us).alias("slot")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    near = spans.select("key", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    active = near.distinct().groupBy("slot").agg(F.count(F.lit(1)).alias("active_keys"))
    return active.withColumn("within_bound", F.col("active_keys") <= max_keys)

