"""Structure repair against a plain search for the cheapest, ASCII-least edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from gleanery.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost long, seq string"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, turn, role, text, *_ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        out += [(c, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra by (cost, audit) over (row, last initial); rows are (fault, role, text)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        for x in "ua":
            if x in AFTER[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, x, (*out, f"{ROLE[x]}:")))
        if i < len(rows):
            fault, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if role[:1] in AFTER[last]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for x in "ua":
                    if x in AFTER[last]:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, x, (*out, f"{ROLE[x]}:{text}")))


def brute(rows):
    own = {c: [] for c, *_ in rows}
    for c, turn, role, text in damage(rows):
        own[c].append((turn is not None, turn or 0, role, text))
    result = []
    for c, left in own.items():
        left.sort()
        seen, faults = set(), []
        for _, _, role, text in left:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append((fault, role, text))
        turns = [t for known, t, *_ in left if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, out = cheapest(faults)
        n = [sum(f[0] == x for f in faults) for x in ("blank", "duplicate", "truncated")]
        result.append((c, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()))
    return sorted(result, key=str)


def found(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(rng):
    rows = []
    texts = ["Yes.", "No!", "So?", "well", " ", "", "One. two", "x\ny.\n", None, "é."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s"]
    for c in [*range(90), -4, None]:
        for k in range(rng.randrange(0, 9)):
            turn = None if rng.random() < 0.05 else rng.randrange(12)
            rows.append((c, turn, rng.choice(roles), rng.choice(texts), 1, "q"))
    for c in (300, 301):  # longer than a chunk in the small setting
        rows += [(c, k * 2, rng.choice(roles[:5]), f"{k // 3} said" + rng.choice(".!x"), 1, "q") for k in range(150)]
    rows += [(302, 5, "user", "again.", 1, "q")] * 40
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [4096, 7])
def test_repair_is_that_of_plain_search(spark, size):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = table(random.Random(size))
        out, turns = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), size)
        want = brute(rows)
        assert found(out) == want
        parts = sorted(turns.collect(), key=lambda r: (r["part"], r["seq"]))
        for c, *_, audit, sha in want:
            own = [r for r in parts if r["conv_id"] == c]
            assert "".join(r["audit"] for r in own) == audit
            assert hashlib.sha256("\n".join(x for r in own for x in r["lines"]).encode()).hexdigest() == sha
        assert size > 7 or max(sum(r["conv_id"] == c for r in parts) for c in (300, 301, 302)) > 5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_walks_agree_however_the_rows_are_cut():
    rng = random.Random(2)
    for _ in range(60):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(1, 60)))
        audit, state = repair.walk(codes, repair.END, repair.START)
        cut = rng.randrange(len(codes) + 1)
        between = repair.matrix(codes[cut:])
        after = [min(between[t][s] + repair.END[t] for t in range(4)) for s in range(4)]
        assert after == repair.before(codes[cut:], repair.END)
        first, middle = repair.walk(codes[:cut], after, repair.START)
        second, last = repair.walk(codes[cut:], repair.END, middle)
        assert (first + second, last) == (audit, state)


def test_no_rows_and_no_rows_left(spark):
    none = spark.createDataFrame([], SCHEMA)
    out, turns = repair.repair(none)
    assert out.collect() == [] and turns.collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out, _ = repair.repair(spark.createDataFrame([(gone, 0, "user", "hi.", 1, "")], SCHEMA))
    assert found(out) == [(gone, 0, 0, 0, 0, 0, 0, "", repair.EMPTY_SHA)]


def test_query(spark, sf_dir):
    from gleanery.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_structure_repair"](spark, sf_dir)) == brute(rows)
