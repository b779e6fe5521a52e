from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so") for b in ("ta", "vi", "zo", "pe", "gun", "del", "arn")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ",", "x", "qu")) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and columns whose names the operators use inside."""
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    near = base[0].split(" ")
    near[30] = "changed"
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [
        (20, base[0]), (21, " ".join(near)), (22, base[3].upper()),  # a copy, a near copy, other capitals
        (23, None), (24, ""), (25, " \n\t "), (26, "one two"), (27, "One  TWO"),
        (28, sentence(rng, 6000)),  # very long
        (5, base[5]), (5, base[5]),  # repeated rows
        (None, base[1]), (None, None),  # no id
    ]
    data = [(i, t, "en", f"s{k % 3}", len(t or ""), k, "x", [1]) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, ids array<int>"
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
