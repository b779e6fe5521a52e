from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from gleanery.operators.scan import laid_out, running


def test_running_values_of_a_group_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), k, rng.randrange(1000) if k % 7 else None) for k in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, t int, v long").repartition(5)
    stored = laid_out(df, ["g"], ["t"], ranges=6)
    assert stored.select("_part").distinct().count() > 2
    v = F.col("v")
    got = running(stored, ["g"], {"n": ("sum", F.lit(1)), "s": ("sum", v), "x": ("xor", v), "hi": ("max", v), "lo": ("min", v)})
    assert got.columns == ["g", "t", "v", "_part", "_at", "n", "s", "x", "hi", "lo"]
    want = []
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1])), key=lambda r: r[0]):
        seen, x = [], None
        for n, (g, t, val) in enumerate(own, 1):
            if val is not None:
                seen.append(val)
                x = val if x is None else x ^ val
            want.append((g, t, n, sum(seen) if seen else None, x, max(seen, default=None), min(seen, default=None)))
    found = [(r["g"], r["t"], r["n"], r["s"], r["x"], r["hi"], r["lo"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    none = running(laid_out(df.limit(0), ["g"], ["t"]), ["g"], {"n": ("sum", F.lit(1))})
    assert none.collect() == []
