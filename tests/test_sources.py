from __future__ import annotations

import hashlib
import hmac
import io
import ipaddress
import tarfile

import pytest

from gleanery.functions.netkey import client_address, visitor_key
from gleanery.functions.wordpiece import basic_words, piece_ids
from gleanery.sources import corpus, settings, tables

COMMIT = "a" * 40
def test_eval_questions(spark, tmp_path):
    path = tmp_path / "e.toml"
    path.write_text('pinned_commit = "x"\n[[question]]\nid = "a"\nquestion = "q"\nsources = ["f.md"]\n'
                    '[[question]]\nid = "b"\nquestion = "r"\nanswerable = false\nhard_negative = true\n')
    commit, df = settings.read_questions(spark, path, "dev")
    assert commit == "x" and [(r.qid, r.answerable, r.hard_negative) for r in df.orderBy("position").collect()] == [
        ("a", True, False), ("b", False, True)]


def test_faults_of_a_question_set_are_all_named(spark, tmp_path):
    path = tmp_path / "e.toml"
    path.write_text('[[question]]\nid = "a"\nquestion = " "\n[[question]]\nid = 3\nquestion = "r"\nanswerable = "no"\n')
    with pytest.raises(settings.ConfigError) as told:
        settings.read_questions(spark, path, "dev")
    for part in ("pinned_commit", "entry 1: question", "entry 2: id", "entry 2: answerable", "a is answerable"):
        assert part in str(told.value)


def test_verdicts_and_key(spark, tmp_path):
    path = tmp_path / "v.toml"
    path.write_text('format = "f1"\nprompt_sha256 = "p"\n[[verdict]]\nid = "a"\nverdict = "ANSWERABLE"\ninput_sha256 = "x"\n')
    assert [tuple(r) for r in settings.read_verdicts(spark, path, "f1", "p").collect()] == [("a", "ANSWERABLE", "x")]
    with pytest.raises(settings.ConfigError, match="prompt_sha256"):
        settings.read_verdicts(spark, path, "f1", "q")
    path.write_text('[r001]\nset = "dev"\nid = "a"\n[r002]\nset = "dev"\nid = "b"\n')
    assert [tuple(r) for r in settings.read_key(spark, path).orderBy("run_id").collect()] == [
        ("r001", "dev", "a"), ("r002", "dev", "b")]
    path.write_text('[r001]\nset = "dev"\n')
    with pytest.raises(settings.ConfigError, match="entry 1: id"):
        settings.read_key(spark, path)


def test_archive_and_tree(spark, tmp_path):
    files = {"README.md": b"\xef\xbb\xbf# A\r\nx", "guide/bad.md": b"\xff", "guide/a.md": b"t", "n.txt": b"no"}
    blob = tmp_path / "a.tar.gz"
    with tarfile.open(blob, "w:gz") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(f"docs-{COMMIT}/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
            (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "tree" / name).write_bytes(data)
    for raw in (corpus.read_archives(spark, str(blob), "o/docs", COMMIT), corpus.read_tree(spark, str(tmp_path / "tree"))):
        good, bad = corpus.decode(raw)
        assert {r.path: r.text for r in good.collect()} == {"README.md": "# A\nx", "guide/a.md": "t"}
        assert [r.path for r in bad.collect()] == ["guide/bad.md"]


def test_visitor_keys(spark):
    cases = {"10.0.0.1": b"4:" + bytes([10, 0, 0, 1]), "::ffff:10.0.0.1": b"4:" + bytes([10, 0, 0, 1]),
             "2001:db8::7": b"6:" + ipaddress.ip_address("2001:db8::").packed[:8], "nobody": b"x:nobody"}
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    for r in df.select("a", visitor_key(b"s")("a").alias("k")).collect():
        assert r.k == hmac.new(b"s", cases[r.a], hashlib.sha256).hexdigest()
    seen = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "p"), ("1.1.1.1, x", "p"), (None, None)], "f string, p string")
    from pyspark.sql import functions as F
    got = [r[0] for r in seen.select(client_address(F.col("f"), F.col("p"))).collect()]
    assert got == ["2.2.2.2", "p", "unknown"]


def test_wordpiece():
    assert basic_words("Héllo, 漢字x\x00 ok") == ["hello", ",", "漢", "字", "x", "ok"]
    table = {"[UNK]": 0, "he": 1, "##llo": 2, "##l": 3}
    assert piece_ids("hello", table) == [1, 2] and piece_ids("hez", table) == [0]
    assert piece_ids("h" * 101, table) == [0]


def test_transcript_records(spark, tmp_path):
    line = '{"type":"assistant","message":{"id":"m","model":"x","usage":{"input_tokens":3},"content":[{"type":"text","text":"hi"},{"type":"tool_use"}]}}'
    (tmp_path / "agent-7.jsonl").write_text('{"type":"user","message":{"content":"go"}}\n' + line + '\n{"type":"attachment"}\n')
    rows = tables.read_transcripts(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.agent, r.type, r.prompt, r.tool_uses) for r in rows] == [("7", "user", "go", 0), ("7", "assistant", None, 1)]
    assert rows[1].texts == ["hi"] and rows[1].input_tokens == 3
