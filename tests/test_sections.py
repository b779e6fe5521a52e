from __future__ import annotations

from gleanery.operators.sections import passages, sections, split_counters

CASES = {
    "plain.md": "# One\ntext\n\n## Two ##\nmore\n\n\n### Three\nend\n",
    "pre.md": "before\n\n# Head\nbody",
    "fence.md": "# A\n```\n# not\n````\n~~~\n# not\n```\n# not\n~~~~ x\n# B\nb",
    "open.md": "# A\nx\n```\n# hidden\n",
    "front.md": "---\n# meta\n---\n# Real\nx",
    "nofront.md": "---\n# Real\nx",
    "skip.md": "# A\n### C\nc\n## B\nb\n#### D\nd",
    "empty.md": "# A\n\n## B\n\n\n## C\nc",
    "edge.md": "#tag\n    # code\n   # three\nx\n# #\ny\n####### seven\n#\nz",
    "blank.md": "\n\n  \n",
    "none.md": "just text\nand more\n\n",
    "closed.md": "# A # b ##  \nx\n# C#\ny\n\t# D\n",
}
# (line_start, line_end, heading trail) of each passage, worked out by hand.
EXPECTED = {
    "plain.md": [(1, 2, ["One"]), (4, 5, ["One", "Two"]), (8, 9, ["One", "Two", "Three"])],
    "pre.md": [(1, 1, []), (3, 4, ["Head"])],
    "fence.md": [(1, 9, ["A"]), (10, 11, ["B"])],
    "open.md": [(1, 4, ["A"])],
    "front.md": [(1, 3, []), (4, 5, ["Real"])],
    "nofront.md": [(1, 1, []), (2, 3, ["Real"])],
    "skip.md": [(2, 3, ["A", "C"]), (4, 5, ["A", "B"]), (6, 7, ["A", "B", "D"])],
    "empty.md": [(6, 7, ["A", "C"])],
    "edge.md": [(1, 2, []), (3, 4, ["three"]), (5, 7, [""]), (8, 9, [""])],
    "blank.md": [],
    "none.md": [(1, 2, [])],
    "closed.md": [(1, 2, ["A # b"]), (3, 5, ["C#"])],
}


def test_passages_match_hand_worked_cases(spark):
    files = spark.createDataFrame(list(CASES.items()), "path string, text string")
    got: dict[str, list] = {name: [] for name in CASES}
    for r in passages(files).orderBy("path", "line_start").collect():
        got[r.path].append((r.line_start, r.line_end, list(r.heading_path)))
        assert r.text == "\n".join(CASES[r.path].split("\n")[r.line_start - 1 : r.line_end])
        assert r.heading == (r.heading_path[-1] if r.heading_path else "")
    assert got == EXPECTED


def test_counters(spark):
    files = spark.createDataFrame(list(CASES.items()), "path string, text string")
    row = split_counters(files).first()
    assert row.files == len(CASES)
    assert row.passages == sum(len(v) for v in EXPECTED.values())
    assert row.empty_dropped == 3  # A of skip.md, A and B of empty.md


def test_sections_split_without_a_shuffle(spark):
    files = spark.createDataFrame([("a.md", "# A\nx")], "path string, text string")
    plan = sections(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
