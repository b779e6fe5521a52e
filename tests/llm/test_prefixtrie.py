"""The prefix trie against plain Python, with small components so that every step of the roll-up acts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from gleanery.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, d long, k1 string"


def brute(rows):
    """Nodes as the contract says, by tuples of turns."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    words = {n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0 for n in nodes}
    kids = {n: 0 for n in nodes}
    leaves, saved = dict(kids), dict(kids)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n in nodes:
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(nodes[n]) - 1) * words[n]
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], sha(n)) for n, m in nodes.items()
    )


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names and {t for _, t in df.dtypes[:-1]} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def table(rng):
    rows = []
    for c in [*range(0, 130), -7, -21, -40, 400, 801]:
        kind = rng.randrange(5)
        n = rng.randrange(0, 9) if kind else 1
        turns = [(rng.choice("sua"), f"say {rng.randrange(2)} x") for _ in range(n)]
        if kind == 4:
            turns = [("u", "the same words"), ("a", "answer"), ("u", "more")]
        rows += [(c, None if k == 0 and c % 3 == 0 else k, r, t, c, "k") for k, (r, t) in enumerate(turns)]
    rows += [(500, k, "u" if k % 2 else "a", f"long {k // 9}", 0, "") for k in range(300)]
    rows += [(503, k, "u" if k % 2 else "a", f"long {k // 9}", 0, "") for k in range(290)]
    rows += [(13, 2, None, None, 0, ""), (13, 2, None, None, 0, ""), (13, None, "", " ", 0, ""), (None, 1, "u", "lost", 0, "")]
    rng.shuffle(rows)
    return rows


@pytest.fixture()
def many_ranges(spark):
    """Small tables keep their ranges, so that groups go on from one to the next."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("leaves,band", [(64, 64), (3, 4)])
def test_trie_is_that_of_plain_python(spark, many_ranges, monkeypatch, leaves, band):
    monkeypatch.setattr(prefixtrie, "LEAVES", leaves)
    monkeypatch.setattr(prefixtrie, "BAND", band)
    rows = table(random.Random(leaves))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(prefixtrie.prefix_trie(df)) == brute(rows)


def test_awkward_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.prefix_trie(none).collect() == []
    lone = [(5, 0, "u", "hi", 0, "")]  # takes its only turn from an absent conversation: no turns are left
    assert zlib.crc32(b"5") % 4 > 0
    assert found(prefixtrie.prefix_trie(spark.createDataFrame(lone, SCHEMA))) == brute(lone)
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 0, "u", "hi", 0, "")], SCHEMA)).collect() == []


def test_centroids_of_every_shape():
    rng = random.Random(9)
    for shape in range(60):
        n = rng.randrange(1, 120)
        parent = [-1 if k == 0 or rng.random() < 0.02 else {0: k - 1, 1: 0}.get(shape, rng.randrange(max(0, k - 1 - shape), k)) for k in range(n)]
        values = [(rng.randrange(5), rng.randrange(100)) for _ in range(n)]
        want = [list(v) for v in values]
        for k in reversed(range(n)):
            if parent[k] >= 0:
                want[parent[k]] = [a + b for a, b in zip(want[parent[k]], want[k])]
        assert prefixtrie.centroid_totals(parent, values) == want


def test_query(spark, sf_dir):
    from gleanery.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_prefix_trie"](spark, sf_dir)) == brute(rows)
