from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gleanery.functions import words as W
from gleanery.functions.porter import porter, stem_counts, stem_words

# Stems by step of the published rules; words of our own.
PORTER = {
    # plurals
    "dresses": "dress", "parties": "parti", "moss": "moss", "dogs": "dog",
    # past and progressive
    "refereed": "refere", "planted": "plant", "shed": "shed", "jumping": "jump", "spring": "spring",
    "created": "creat", "skated": "skate", "stopping": "stop", "telling": "tell", "mixed": "mix",
    # final y
    "lucky": "lucki", "cry": "cry",
    # double suffixes
    "emotional": "emot", "national": "nation", "organizer": "organ", "navigator": "navig",
    "socialism": "social", "attentiveness": "attent", "thankfulness": "thank", "nervousness": "nervous",
    # single suffixes
    "duplicate": "duplic", "narrative": "narr", "legalize": "legal", "historical": "histor",
    "darkness": "dark", "survival": "surviv", "tolerance": "toler", "reference": "refer",
    "container": "contain", "washable": "washabl", "important": "import", "agreement": "agreement",
    "excellent": "excel", "election": "elect", "optimism": "optim", "motivate": "motiv",
    "generous": "gener", "creative": "creativ", "modernize": "modern",
    # final e and double l
    "skate": "skate", "tease": "teas", "unrolling": "unrol", "shell": "shell",
    # too short, or no word
    "at": "at", "7": "7",
}
TEXTS = [
    "The Straße's UPPER_case cafés — naïve ½ x² Ⅳ 漢字 don't",
    "ΟΔΟΣ ﬁnal İstanbul ŉ ǰ ẞ ſ µ",
    "état snake_case 3.14 a-b",
    "the and of", "", "   ",
]


def test_porter_by_step():
    assert {w: porter(w) for w in PORTER} == PORTER


def test_words_equal_python_rule(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", W.words(F.col("t")).alias("w")).collect()}
    for i, text in enumerate(TEXTS):
        want = [w for w in re.findall(r"[^\W_]+", text.casefold()) if w not in W.STOP_TERMS]
        assert got[i] == want, text


def test_casefold_on_every_folding_character(spark):
    import sys
    import unicodedata

    chars = [
        chr(p) for p in range(sys.maxunicode + 1)
        if unicodedata.category(chr(p)) not in ("Cs", "Cn") and chr(p).casefold() != chr(p)
    ]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    bad = [
        (r.c, r.f) for r in df.select("c", W.casefold(F.col("c")).alias("f")).collect()
        if r.f != r.c.casefold()
    ]
    assert not bad


def test_stem_columns(spark):
    rows = [(1, ["running", "runs", "cats", "cat"]), (2, []), (3, ["running"])]
    df = spark.createDataFrame(rows, "i int, t array<string>")
    got = df.select("i", stem_words("t").alias("s"), stem_counts("t").alias("c")).collect()
    assert {r.i: r.s for r in got} == {1: ["run", "run", "cat", "cat"], 2: [], 3: ["run"]}
    assert {r.i: sorted((x.term, x.tf) for x in r.c) for r in got} == {
        1: [("cat", 2), ("run", 2)], 2: [], 3: [("run", 1)]
    }


def test_squeeze_and_hidden(spark):
    raw = [" a  b\tc\n", "\x1c x \x85y", "a​b", "ok"]
    df = spark.createDataFrame([(t,) for t in raw], "t string")
    got = df.select(
        "t", W.squeeze_space(F.col("t")).alias("s"), W.has_hidden(F.col("t")).alias("h")
    ).collect()
    for r in got:
        assert r.s == " ".join(r.t.split())
    assert [r.h for r in got] == [True, True, True, False]


def test_path_stem(spark):
    paths = ["a/b.md", "a.b/c", "a/b.", "x.tar.gz", "a/.md", "plain"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.s for r in df.select("p", W.path_stem(F.col("p")).alias("s")).collect()}
    for p in paths:
        want = p.rsplit(".", 1)[0] if "." in p.rsplit("/", 1)[-1] else p
        assert got[p] == want


def test_s_stem(spark):
    cases = {
        "queries": "query", "aies": "aie", "movies": "movy", "uses": "use", "trees": "tree",
        "shoes": "shoe", "bus": "bus", "glass": "glass", "cats": "cat", "gas": "gas",
    }
    df = spark.createDataFrame([(w,) for w in cases], "w string")
    got = {r.w: r.s for r in df.select("w", W.s_stem(F.col("w")).alias("s")).collect()}
    assert got == cases


def test_stemming_whole_batches_equals_word_by_word(spark):
    rng = random.Random(7)
    pool = list(PORTER)
    rows = [(i, [rng.choice(pool) for _ in range(rng.randrange(0, 30))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t array<string>").repartition(3)
    for r in df.select("t", stem_words("t").alias("s")).collect():
        assert r.s == [porter(w) for w in r.t]


def test_words_without_a_suffix_skip_the_rules():
    from gleanery.functions import porter as po

    words = ["sky", "caresses", "agreed", "hopping", "relational", "controll", "rate", "qqx", "слово", "x9", "is", "ion"]
    assert [po.porter(w) for w in words] == [po._stem(w) if len(w) > 2 else w for w in words]
    before = po._stem.cache_info()
    assert po.porter("zzqx") == "zzqx"
    assert po._stem.cache_info() == before
    assert before.maxsize <= 1 << 17
