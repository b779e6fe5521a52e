"""Operators that treat each text on its own: tokens, counts, licences."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest

from gleanery.llm import bpe, licences, piececount

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_agrees_with_the_library(library):
    auto = bpe.Automaton(open(FILE, "rb").read())
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABC'.-ß é漢😀 ́ΣİK"
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", "<|x", "a\x1cb\x85c", "I'll can't ''s 123", "!" * 500]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert auto.encode(text) == want, text
        assert auto.decode(want) == library.decode(want, skip_special_tokens=False)


def test_automaton_accepts_one_path_for_each_merge():
    auto = bpe.Automaton(open(FILE, "rb").read())
    for text, token in list(auto.live.items())[600:4000:7]:
        if text.endswith(auto.end):
            assert auto.encode_word(text.removesuffix(auto.end)) == [token]


def test_encoded_table(odd, none, library):
    got = bpe.encode(odd, FILE, keep=["lang", "n"]).collect()
    assert len(got) == odd.count()
    texts = {r["n"]: r["text"] for r in odd.collect()}
    for r in got:
        ids = library.encode(texts[r["n"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["lang"]) == (ids, len(ids), "en")
    digest = {r["doc_id"]: r for r in bpe.digests(odd, FILE).collect()}
    ids = library.encode(texts[0], add_special_tokens=False).ids
    assert digest[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest[23]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    back = bpe.decode(bpe.encode(odd, FILE), FILE).filter("doc_id = 0").first()["decoded"]
    assert back == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, FILE).collect() == [] and bpe.digests(none, FILE).collect() == []


def greedy(word: str, pieces: set[str]) -> int:
    text, n, start = "▁" + word, 0, 0
    while start < len(text):
        end = len(text)
        while end > start and (text[start:end] not in pieces or (start == 0 and end == 1)):
            end -= 1
        if end <= start:
            return 1
        n, start = n + 1, end
    return n


def test_piece_counts(odd, none):
    pieces = piececount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known, match = set(pieces), piececount.LongestMatch(pieces)
    rng = random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghinorstué漢.-") for _ in range(rng.randrange(1, 20)))
        assert (match.count(word) or 1) == greedy(word, known), word
    got = piececount.token_counts(odd, pieces).collect()
    want = sorted((r["doc_id"] or -1, sum(greedy(w, known) for w in (r["text"] or "").split())) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
    assert piececount.token_counts(none, pieces).collect() == []


def greedy_whole(word: str, pieces: set[str]) -> int:
    """Longest match with the whole vocabulary, the start mark alone included; 0 if it does not cover the word."""
    text, n, start, longest = "▁" + word, 0, 0, max(map(len, pieces))
    while start < len(text):
        end = next((e for e in range(min(len(text), start + longest), start, -1) if text[start:e] in pieces), start)
        if end == start:
            return 0
        n, start = n + 1, end
    return n


def test_words_begin_with_the_mark_alone(spark):
    pieces = piececount.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known, match = set(pieces), piececount.LongestMatch(pieces, lone_start=True)
    assert "▁" in known
    rng = random.Random(6)
    for _ in range(3000):
        word = "".join(rng.choice("0123456789abehnorstñßçé漢字.-\u0378") for _ in range(rng.randrange(1, 20)))
        assert match.count(word) == greedy_whole(word, known), word
    far = next(p for p in pieces if len(p) == 1 and "\u4e00" <= p <= "\u9fff" and "▁" + p not in known)
    texts = ["2024", far * 10_000, "ñandú ßa ça 007 the 3rd", "\u0378"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_unknown"]) for r in piececount.token_counts(docs, pieces).collect()}
    counts = [[greedy_whole(w, known) for w in t.split()] for t in texts]
    assert got == {k: (sum(n or 1 for n in c), c.count(0)) for k, c in enumerate(counts)}
    assert got[0][0] > 1 and got[1][0] > 5_000 and got[3] == (1, 1)


def test_expressions():
    assert licences.postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert licences.postfix("(MIT or X) and GPL-2.0 with Classpath-exception-2.0") == [
        "MIT", "X", "or", "GPL-2.0", "Classpath-exception-2.0", "with", "and",
    ]
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT MIT"):
        assert licences.postfix(bad) is None
    assert licences.evaluate(licences.postfix("GPL-3.0-only OR MIT")) == (["gpl-3", "mit"], True, set())
    assert licences.evaluate(licences.postfix("GPL-3.0-only AND MIT")) == (["gpl-3", "mit"], False, {"gpl-3", "mit"})
    assert licences.evaluate(licences.postfix("(MIT OR ISC) AND (MIT OR GPL-2.0)"))[1:] == (True, set())
    assert licences.evaluate(licences.postfix("MIT AND (MIT OR GPL-2.0 WITH x)")) == (["mit", "mit", "gpl-2"], True, {"mit"})
    assert licences.postfix("MIT WITH (foo OR bar)") is None


def test_scan_places():
    got = licences.scan("Under the MIT  License! é under the mit license. CC BY-NC cc-by-nc-sa")
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (16, 4, 0, 12)
    assert got["base_labels"] == "cc-by-nc,mit"
    assert licences.scan("under the mit licenses")["n_base"] == 0
    tagged = licences.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) WITH foo */\ncode")
    assert tagged["labels"] == "gpl-2,mit" and 0 < tagged["score"] < 1 and tagged["n_base"] == 0


def test_scan_tells_choices_from_duties():
    tag = "SPDX-License-Identifier: "
    both, either = licences.scan(tag + "MIT AND Apache-2.0"), licences.scan(tag + "MIT OR Apache-2.0")
    assert both["labels"] == either["labels"] == "apache-2,mit"
    assert (both["required"], either["required"], both["permissive"]) == ("apache-2,mit", "", True)
    two = licences.scan(f"{tag}MIT OR GPL-3.0-only\n{tag}LGPL-2.1+\n")
    assert (two["required"], two["permissive"], two["labels"]) == ("lgpl", False, "gpl-3,lgpl,mit")
    assert licences.scan("under the mit license")["permissive"] is None


def test_base_columns_against_brute_force(spark):
    rng = random.Random(31)
    words = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "é", "x1"]
    whole = ["Under the MIT license", "apache LICENSE version 2", "CC-BY-NC"]
    rows = []
    for k in range(300):
        parts = [rng.choice(whole) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(0, 40))]
        rows.append((k, "".join(p + rng.choice((" ", "\n", ", ", "-", ".")) for p in parts)))
    rows += [(300, None), (300, "under the mit license " * 5000)]
    want = []
    for k, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        got = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [
            (i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(got))
            if got[i : i + len(phrase.split())] == phrase.split()
        ]
        starts = [i for i, _ in places]
        want.append((k, len(got), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    out = licences.license_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    have = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out.collect()]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_scan_table(odd, none):
    got = licences.license_scan(odd).collect()
    assert len(got) == odd.count()
    empty = next(r for r in got if r["doc_id"] == 23)
    assert (empty["n_words"], empty["n_base"], empty["first_word"], empty["labels"], empty["score"]) == (0, 0, None, "", 0.0)
    assert licences.license_scan(none).collect() == []
