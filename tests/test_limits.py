from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gleanery.operators import limits, spend
from gleanery.plans import fixtures as fx
from gleanery.streaming import admission

HOUR = 3_600_000_000


def greedy(rows, rules, window):
    """The rule row by row: (key, us, event_id, flag) -> admitted event ids."""
    queues, out = {}, set()
    for key, us, eid, flag in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held = queues.setdefault(key, [deque() for _ in rules])
        for q in held:
            while q and q[0] <= us - window:
                q.popleft()
        if all(len(q) < rule.limit for q, rule in zip(held, rules)):
            out.add(eid)
            for q, rule in zip(held, rules):
                if rule.counted is None or flag:
                    q.append(us)
    return out


def log(seed: int, n: int = 1500):
    rng = random.Random(seed)
    rows, now = [], 0
    for eid in range(n):
        now += rng.choice([0, 1, HOUR // 40, HOUR // 7, HOUR // 7, rng.randrange(HOUR // 3)])
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}"
        rows.append((key, now, eid, rng.random() < 0.5))
    rows.append(("edge", 0, n, True))
    rows.append(("edge", HOUR, n + 1, True))  # exactly one window later: the first has expired
    return rows


RULES = {
    "one": [limits.Allowance(3)],
    "two": [limits.Allowance(2, "flag"), limits.Allowance(5)],
    "single": [limits.Allowance(1)],
    "flagged": [limits.Allowance(2, "flag")],
    "flags only": [limits.Allowance(3, "flag"), limits.Allowance(2, "flag")],
}


@pytest.mark.parametrize("name", list(RULES))
@pytest.mark.parametrize("hot_rows", [10**9, 60])
def test_admission_equals_the_rule_row_by_row(spark, name, hot_rows):
    rows = log(len(name))
    if hot_rows == 60:  # a shorter log: the hot key is replayed window by window
        rows = rows[:150]
    df = spark.createDataFrame(rows, "key string, us bigint, event_id bigint, flag boolean")
    found = limits.rolling_admission(df.repartition(3), RULES[name], HOUR, hot_rows)
    got = {r.event_id for r in found.filter("admitted").collect()}
    assert got == greedy(rows, RULES[name], HOUR)
    assert found.count() == len(rows)


def test_result_store(spark):
    rows = [(i, t) for i, t in enumerate([0, 5, 5, 30, 700, 701, 702])]
    df = spark.createDataFrame(rows, "token bigint, us bigint")
    got = {r.token: r.gone_us for r in limits.result_store(df, 600, 3).collect()}
    assert got == {0: 30, 1: 605, 2: 605, 3: 630, 4: 1300, 5: 1301, 6: 1302}


def replay(rows, cap):
    """The counter of one day in plain order."""
    state, out = {}, {}
    for day, us, seq, kind, rid, reserved_day, amount in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = state.setdefault(day, {"spent": 0, "open": {}, "closed": False})
        flight = sum(s["open"].values())
        if kind == "reserve":
            if s["closed"]:
                out[seq] = "paused"
            elif s["spent"] + amount > cap:
                s["closed"], out[seq] = True, "closes"
            elif s["spent"] + flight + amount > cap:
                out[seq] = "busy"
            else:
                s["open"][rid], out[seq] = amount, "accepted"
        else:
            s["open"].pop(rid, None)
            s["spent"] += amount
            out[seq] = "settled"
    return out


def test_spend_log_equals_plain_replay(spark):
    rng = random.Random(3)
    rows, seq = [], 0
    for rid in range(1500):
        day = f"2024-01-{1 + rid % 5:02d}"
        at, ask = rng.randrange(10_000), rng.randrange(50, 150)
        late = rng.random() < 0.1
        rows.append((day, at, seq, "reserve", rid, day, ask))
        settle_day = f"2024-01-{2 + rid % 5:02d}" if late else day
        rows.append((settle_day, at + rng.randrange(3000), seq + 1, "settle", rid, day, ask // 2))
        seq += 2
    rows.append(("2024-02-01", 0, seq, "reserve", 9999, "2024-02-01", 10))
    cap = 3000
    schema = "day string, us bigint, seq bigint, kind string, rid bigint, reserved_day string, amount bigint"
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = {r.seq: r.decision for r in spend.spend_log(df, cap).collect()}
    assert got == replay(rows, cap)
    assert {"accepted", "busy", "closes", "paused", "settled"} == set(got.values())


def test_a_tight_day_is_replayed_in_many_ranges(spark, monkeypatch):
    """Reservations stay open over range ends, so that ranges begin otherwise than guessed."""
    rng = random.Random(4)
    rows, seq = [], 0
    for rid in range(2000):
        at, ask = rid * 10, rng.randrange(50, 150)
        rows.append(("d", at, seq, "reserve", rid, "d", ask))
        if rng.random() < 0.97:  # some never settle
            rows.append(("d", at + rng.randrange(200), seq + 1, "settle", rid, "d", ask // 4))
        seq += 2
    cap = 45_000
    df = spark.createDataFrame(rows, "day string, us bigint, seq bigint, kind string, rid bigint, reserved_day string, amount bigint")
    rounds, once = [], spend._from_open

    def counted(live, carry, cap):
        rounds.append(live.select("day", "_part").distinct().count())
        return once(live, carry, cap)

    monkeypatch.setattr(spend, "_from_open", counted)
    log = spend.spend_log(df.repartition(4), cap, ranges=12).collect()
    assert {r.seq: r.decision for r in log} == replay(rows, cap)
    assert {"accepted", "busy", "closes", "paused"} < {r.decision for r in log}
    assert rounds[0] > 5 and len(rounds) > 1 and sum(rounds) < 12 * 12 / 2
    spent = 0
    for r in sorted(log, key=lambda r: (r.us, r.seq)):
        spent += r.amount if r.kind == "settle" else 0
        assert r.spent == spent


def test_daily_cap_and_reservation(spark):
    assert spend.daily_cap("10") == 10 * 10**9 // 31
    row = spark.range(1).select(spend.reservation(F.lit(100), F.lit(50)).alias("r")).first()
    assert row.r == (100 + 50 + 64) * 2000 + 1024 * 10_000


def test_stream_admits_what_the_batch_admits(spark, sf_dir, tmp_path):
    admission.use_state_store(spark)
    day = 86_400_000_000
    events = fx.events(spark, sf_dir).select("key", "event_id", "ts", "us")
    cut = [r[0] for r in events.selectExpr("percentile(us, array(0.4, 0.7))").collect()][0]
    source = str(tmp_path / "in")
    parts = [events.filter(F.col("us") <= cut[0]),
             events.filter((F.col("us") > cut[0]) & (F.col("us") <= cut[1])),
             events.filter(F.col("us") > cut[1])]
    out = []
    for i, part in enumerate(parts):
        part.drop("us").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, event_id bigint, ts timestamp").parquet(source)
        query = (
            admission.admissions(stream, 3, day).writeStream.outputMode("append")
            .format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        out.append(i)
    got = {r.event_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = limits.rolling_admission(events.select("key", "us", "event_id"), [limits.Allowance(3)], day)
    assert got == {r.event_id: r.admitted for r in batch.collect()}


def test_keys_leave_the_stream_state_when_their_windows_have_passed(spark, tmp_path):
    admission.use_state_store(spark)
    hour = 3_600_000_000
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "key string, event_id bigint, ts timestamp"
    batches = [
        [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:10:00"), ("a", 3, "2024-01-01 00:20:00"), ("b", 4, "2024-01-01 00:30:00")],
        [("c", 5, "2024-01-01 06:00:00")],  # moves the watermark on
        [("c", 6, "2024-01-01 06:01:00"), ("a", 7, "2024-01-01 06:02:00")],
        [("c", 8, "2024-01-01 06:03:00")],
    ]

    def held():
        rows = spark.read.format("statestore").option("stateVarName", "stamps").option("flattenCollectionTypes", "true").load(state)
        return sorted((r["key"][0], r["list_element"][0]) for r in rows.collect())

    seen, states = {}, []
    for part in batches:
        rows = spark.createDataFrame([(k, i, None) for k, i, _ in part], "key string, event_id bigint, x string")
        times = F.create_map(*[F.lit(x) for _, i, t in part for x in (i, t)])
        rows.select("key", "event_id", times[F.col("event_id").cast("int")].cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            admission.admissions(stream, 2, hour, late="10 minutes").writeStream.outputMode("append").format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        states.append({k for k, _ in held()})
    seen = {r.event_id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert seen == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}
    assert states[0] == {"a", "b"} and "b" not in states[-1] and states[-1] == {"a", "c"}
    assert len(held()) == 3  # of a only the stamp of its new window


def test_usage_by_day_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "answer"), ("2024-01-01 11:00:00", "no_confident_match"), ("2024-01-01 12:00:00", "judge_error"),
            ("2024-01-02 10:00:00", "answer"), ("2024-01-09 10:00:00", "answer")]
    df = spark.createDataFrame(rows, "t string, outcome string").select(F.col("t").cast("timestamp").alias("ts"), "outcome")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, outcome string").parquet(str(tmp_path / "in"))
    query = (
        admission.usage_by_day(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r.day: (r.answered, r.refused, r.asked) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": (1, 1, 2), "2024-01-02": (1, 0, 1)}
