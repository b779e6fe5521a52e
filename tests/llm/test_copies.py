"""Operators that compare texts or vectors, against brute force."""

from __future__ import annotations

import math
import random

import pytest

from gleanery.llm import forest, jaccardjoin, linechunks, winnow
from gleanery.llm.components import components

from .conftest import sentence


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 450)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    used = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in used}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_jaccard(odd, none):
    got = jaccardjoin.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    nulls = sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None and r["n_shingles"])
    assert nulls == [(56, 1)]
    assert jaccardjoin.jaccard_components(none).collect() == []


@pytest.mark.parametrize("limit", [3, 64])
def test_large_groups_of_near_copies(spark, monkeypatch, limit):
    """With a low limit every column of the group is frequent; the links must be the same."""
    monkeypatch.setattr(jaccardjoin, "FREQUENT", limit)
    rng = random.Random(9)
    base = sentence(rng, 150).split(" ")
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, sentence(rng, 40) + " " + " ".join(base[20:60])) for k in range(12)]  # share a passage only
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccardjoin.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_contained_texts_of_other_length(spark):
    """A text cut to 80 to 90 % of its length links with the whole: every column is rare here."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        whole = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice((60, 104, 204)))]
        shorter = math.ceil((0.80, 0.82, 0.85, 0.90)[k % 4] * (len(whole) - 4)) + 4
        rows += [(2 * k, " ".join(whole)), (2 * k + 1, " ".join(whole[:shorter]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccardjoin.jaccard_components(docs).collect()}
    want = brute(rows)
    assert all(want[2 * k + 1][1] == 2 * k for k in range(60))
    assert got == want


def test_line_chunks(spark, odd, none):
    rng = random.Random(3)
    long = sentence(rng, 60)
    short = [sentence(rng, 9) for _ in range(8)]  # together a passage of over 50 words
    rows = [(k, "\n".join([sentence(rng, 40), long, sentence(rng, 8)])) for k in range(5)]
    rows += [(10 + k, "\n".join([sentence(rng, 7), *short, sentence(rng, 30), ""])) for k in range(4)]
    rows += [(20, sentence(rng, 50) + "\nlicence line"), (21, sentence(rng, 50) + "\nlicence line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linechunks.dedup_lines(docs).collect()}
    texts = dict(rows)
    assert got[0]["text"] == texts[0] and got[10]["text"] == texts[10]
    for k in range(1, 5):
        assert long not in got[k]["text"] and got[k]["n_removed"] == 1 and got[k]["n_lines"] == 3
        assert got[k]["text"] == texts[k].replace(long + "\n", "")
    for k in range(11, 14):
        left = sum(s in got[k]["text"] for s in short)
        assert left <= 1 and got[k]["text"].split("\n")[0] == texts[k].split("\n")[0]
    assert got[20]["text"] == texts[20] and got[21]["text"] == texts[21]
    out = linechunks.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    by_n = {r["n"]: r for r in out.collect()}
    assert len(by_n) == odd.count()
    src = {r["n"]: r for r in odd.collect()}
    assert {n: (r["lang"], r["ids"]) for n, r in by_n.items()} == {n: (r["lang"], r["ids"]) for n, r in src.items()}
    copy = next(r for r in by_n.values() if r["doc_id"] == 20)
    assert copy["text"] == "" and copy["n_removed"] == 1
    kept = [r["text"] for r in by_n.values() if r["doc_id"] == 5]
    assert len(kept) == 3 and len(set(kept)) == 1 and kept[0]  # rows with the same id and text are one document
    assert [r["text"] for r in by_n.values() if r["doc_id"] == 23] == [None]
    assert linechunks.dedup_lines(none).collect() == []


def repeated_lines(rows):
    """Lines left of each text: all runs of lines (12 words in several, 25 in one) but the first of each kind go."""
    split = [(i, [x for x in t.split("\n") if x]) for i, t in sorted(rows)]
    seen, left = set(), {}
    for i, lines in split:
        n, gone = [len(x.split()) for x in lines], set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(n[a:b]) < (12 if b > a + 1 else 25):
                    continue
                run = tuple(lines[a:b])
                if run in seen:
                    gone.update(range(a, b))
                seen.add(run)
        left[i] = [x for k, x in enumerate(lines) if k not in gone]
    return left


def test_repeated_passages_of_short_lines(spark):
    """Whatever the neighbours, a passage that was there before goes whole."""
    rng = random.Random(14)
    rows = []
    for k, (count, length) in enumerate([(3, 18), (4, 14), (5, 11), (6, 9), (8, 7), (11, 5), (14, 4), (2, 6)] * 4):
        passage = [sentence(rng, length) for _ in range(count)]
        near = rng.choice((3, 40))
        for copy in range(2):
            around = [[sentence(rng, near) for _ in range(rng.randrange(0, 3))] for _ in range(2)]
            rows.append((2 * k + copy, "\n".join([*around[0], *passage, *around[1]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if x] for r in linechunks.dedup_lines(docs).collect()}
    assert got == repeated_lines(rows)


@pytest.mark.parametrize("every", [1, 2, 6, 1_000_000])
def test_boundaries_do_not_change_what_goes(spark, every):
    """Passages of many lines, shared whole, in part, within one text and by a third text only."""
    rng = random.Random(21)
    passages = [[sentence(rng, rng.choice((2, 5, 9, 26))) for _ in range(25)] for _ in range(6)]
    rows = []
    for k in range(36):
        lines = []
        for p in rng.sample(passages, rng.choice((1, 2))):
            a = rng.randrange(0, 20)
            lines += [sentence(rng, rng.choice((3, 30))), *p[a : a + rng.randrange(1, 25)], sentence(rng, 4)]
        if k % 9 == 0:
            lines += lines[2:12] + ["x y"] * 9
        rows.append((k, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [x for x in r["text"].split("\n") if x] for r in linechunks.dedup_lines(docs, every=every).collect()}
    assert got == repeated_lines(rows)


def test_an_inserted_line_moves_boundaries_next_to_it_only():
    import numpy as np

    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    begins = linechunks.boundaries(h, np.zeros(400, int))
    changed = np.insert(h, 200, np.uint64(77))
    after = linechunks.boundaries(changed, np.zeros(401, int))
    assert (begins[:200] == after[:200]).all() and (begins[201:] == after[202:]).all()
    assert 30 < begins.sum() < 140


def contaminated(rows, items):
    import re

    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    wins = {}
    for item, text in items:
        w = cut(text)
        if item is None or not w:
            continue
        t = min(13, len(w))
        for k in range(len(w) - t + 1):
            wins.setdefault(tuple(w[k : k + t]), set()).add(str(item))
    out = []
    for i, text in rows:
        w = cut(text)
        hit, named = set(), set()
        for t in {len(x) for x in wins}:
            for k in range(len(w) - t + 1):
                found = wins.get(tuple(w[k : k + t]))
                if found:
                    hit.update(range(k, k + t))
                    named |= found
        out.append((i, len(w), len(hit), ",".join(sorted(named)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark, odd, none):
    rng = random.Random(8)
    items = [(k, sentence(rng, 30)) for k in range(5)] + [(5, "Kurz und gut"), (6, None), (None, sentence(rng, 20)), (7, "!"), (8, "ÉTÉ é")]
    first = items[0][1].split(" ")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    extra = [
        (60, sentence(rng, 40) + "\n" + " ".join(first[3:20]).upper() + "; " + sentence(rng, 9)),
        (61, " ".join(first[:12]) + " other " + " ".join(first[12:])),
        (62, items[1][1] + " " + items[2][1] + " kurz, und GUT."), (63, "été é"), (64, "ÉTÉ É"), (65, "ÉtÉ é"),
    ]
    docs = odd.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(i, t, 0) for i, t in extra], "doc_id long, text string, n long"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.contamination(docs, bench).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    have = [(r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in got]
    assert sorted(have, key=key) == sorted(contaminated(rows + extra, items), key=key)
    assert winnow.contamination(none, bench).collect() == []
    assert {r["n_hit"] for r in winnow.contamination(odd, bench.limit(0)).collect()} == {0}


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((12, 16)) for c in centres] + [rng.standard_normal((600, 16))])
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(2000, rows[0][1]), (2001, [2 * v for v in rows[0][1]]), (2002, None), (2003, [0.0] * 16), (2004, [float("nan")] * 16)]
    rows += [(2005, [1.0]), (2006, [None] + [1.0] * 15), (None, rows[0][1]), (2007, [float("inf")] + [0.0] * 15)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in forest.near_vectors(frame).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.95
    want = {i: int(n) - 1 for (i, _), n in zip(good, near.sum(axis=1))}
    ids = [i for i, _ in good]
    assert sum(got[i]["n_links"] for i in ids) >= 0.95 * sum(want.values())
    assert all(got[i]["n_links"] <= want[i] for i in ids)
    assert got[2000]["component_id"] == 0 and got[2001]["component_id"] == 0 and not got[2000]["kept"]
    for i in (2002, 2003, 2004, 2005, 2006, 2007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert forest.near_vectors(frame.limit(0)).collect() == []


def test_vectors_without_ids_are_compared(spark):
    """They link, count and join components, and never name one."""
    v, w, x = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0, 0.5, 0.0]
    y = [1.0, 0.3, 0.0]  # close to w and x only
    rows = [(7, v), (None, w), (None, [2 * k for k in w]), (None, y), (9, x), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0]), (None, None)]
    frame = spark.createDataFrame([(n, i, e) for n, (i, e) in enumerate(rows)], "n int, vec_id long, embedding array<double>")
    unit = [[a / sum(b * b for b in e) ** 0.5 for a in e] if e else None for _, e in rows]
    links = [
        (a, b) for a in range(8) for b in range(8)
        if a != b and unit[a] and unit[b] and sum(p * q for p, q in zip(unit[a], unit[b])) >= 0.95
    ]
    root = roots(range(8), links)
    want = []
    for k, (i, _) in enumerate(rows):
        named = [rows[m][0] for m in range(8) if root[m] == root[k] and rows[m][0] is not None]
        want.append((i, sum(a == k for a, _ in links), min(named, default=None), not named or i == min(named)))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"] or False) for r in forest.near_vectors(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] == 7 for w in want) == 5


def test_capital_sigma_counts_as_itself(spark):
    """Only A-Z are folded: the lower case of a capital sigma, which depends on what follows it, plays no part."""
    docs = spark.createDataFrame([(1, "ΟΔΟΣ.ΑΒ"), (2, "οδος.αβ"), (3, "x ΟΔΟΣ ΑΒ Y")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "ΟΔΟΣ.ΑΒ")], "item_id string, text string")
    got = {r["doc_id"]: r["n_hit"] for r in winnow.contamination(docs, items).collect()}
    assert got == {1: 2, 2: 0, 3: 2}
