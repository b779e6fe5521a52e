"""Bags counted and scored as arrays: the rows are those of the column functions, and little of them travels."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from gleanery.functions import tokens
from gleanery.functions import vectors as vec
from gleanery.functions.words import words
from gleanery.operators import dense, lexical, scoring
from gleanery.operators.topk import top_k
from gleanery.plans import bags
from gleanery.plans import retrieve as rt
from gleanery.plans.index import build_index
from gleanery.plans.ingest import run_ingest

SCHEMA = "path string, heading string, heading_path array<string>, line_start bigint, line_end bigint, text string"
ODD = [
    "Straße STRASSE ὈΔΥΣΣΕΎΣ ΣΣ Σ. ﬁne ŉx", "İstanbul İ ıi ǅ", "a­b c_d 12½ ٣٤ 中文 \U00010400x \U0001d400", "",
    "  \t\n", "the of and", "ΑΣ́Β ΑΣ", "naïve café ʼn ͅ", "running runs ponies\x00caresses",
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def passages(spark):
    made = [(f"d{k % 3}/name{k % 4}.v.md", "", [f"Head {k % 2}", "Sub running"][: k % 3], k % 5, k, f"{text}\n{ODD[k % len(ODD)]} word{k % 7} shared words")
            for k, text in enumerate(ODD * 4)]
    odd = [("d0/x.md", "", [], 1, 1, None), ("only name", "", [], 1, 1, None), (None, "", [], 1, 1, "of no file"), ("d0/y.md", "", None, 1, 1, "no trail"),
           ("d0/z.md", "", [], None, 1, "no line shared"), ("d0/h.md", "", ["Head"], 1, 1, "# Head"), made[5], made[5]]
    return spark.createDataFrame(made + odd, SCHEMA)


def test_words_are_those_of_the_column_functions(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    want = df.select(words(F.col("t")).alias("w"), vec.model_words(F.col("t")).alias("m"), tokens.lowered(F.col("t")).alias("l")).collect()
    for alphabet, texts, column in ((tokens.folding(spark), ODD, "w"), (tokens.lowering(spark), [r["l"] for r in want], "m")):
        found, counts = alphabet.words(texts)
        stop = set(lexical.words.__globals__["STOP_TERMS"]) if column == "w" else set()
        ends = counts.cumsum().tolist()
        got = [[w for w in found[a:b] if w not in stop] for a, b in zip([0, *ends], ends)]
        assert got == [list(r[column]) for r in want]
    counted = df.select(vec.word_counter(spark)(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in counted] == [len(r["m"]) for r in want]


def test_postings_have_the_rows_of_the_bags(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bags, "POSTING_BYTES", 1)
    given = passages(spark)
    path = tmp_path / "terms"
    buckets = bags.write_bags(lexical.bag_texts(given), 4000, str(path), ["passage", "file"], 1, file_rows=300)  # four slices
    assert buckets == 16 and spark.conf.get(bags.WRITERS) == "0"
    stored = spark.read.parquet(str(path))
    own = stored.filter("unit = 'passage'").select("path", "line_start", "dl", "term", "tf")
    assert rows(own) == rows(lexical.passage_bags(given))
    summed = lexical.file_bags(given)
    want = summed.join(lexical.lengths(summed, ["path"]), "path").select("path", "dl", "term", "tf")
    assert rows(stored.filter("unit = 'file'").select("path", "dl", "term", "tf")) == rows(want)
    assert len(list(path.glob("unit=passage/bucket=*/*.parquet"))) > 16


def test_sections_and_bags_are_written_once(spark, tmp_path):
    before = set(Path(spark.conf.get("spark.checkpoint.dir", "/nonexistent")).glob("*"))
    files = spark.createDataFrame([("a.md", "x\n# A\n\n## B\ntwo\n"), ("b.md", "# C\n")], "path string, text string")
    index = run_ingest(files, "r", "0" * 40, parts=("passage", "file"))
    assert (index.meta.passages, index.meta.empty_dropped) == (2, 2) and index.table("passages").count() == 2
    new = {p.name.split("-")[0] for p in set(Path(spark.conf.get("spark.checkpoint.dir")).glob("*")) - before}
    assert not new & {"sections", "passage", "file"} and "index" in new  # no copy beside the index


def test_best_bags_are_those_of_the_scores(spark, monkeypatch):
    index = build_index(passages(spark), parts=("passage", "file"))
    asked = [(1, "shared running words"), (2, "word3 word4 strasse"), (2, "word3 twice"), (3, "nothing here"), (4, "head sub name1 fine")]
    q = spark.createDataFrame(asked, "qid bigint, question string")
    chosen = spark.createDataFrame([(k, p) for k in (1, 2, 4, 9) for p in ("d0/name0.v.md", "d1/name1.v.md", "d0/z.md")], "qid bigint, path string")
    monkeypatch.setattr(scoring, "BLOCK_SCORES", 12)
    monkeypatch.setattr(scoring, "PAIRS_A_TASK", 20)
    monkeypatch.setattr(scoring, "PACK_ROWS", 50)
    for depth in (1, 3):
        file = top_k(rt.file_scores(index, q), ["qid"], [F.desc("score"), F.asc("path")], depth)
        passage = top_k(rt.passage_scores(index, q, chosen), ["qid", "path"], [F.desc("score"), F.asc("line_start")], depth)
        found = [rt.best_files(index, q, depth), rt.best_passages(index, q, chosen, depth)]
        for got, want in zip(found, (file, passage)):
            assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
            assert rows(got.select(*want.columns)) == rows(want) and not want.isEmpty()
        monkeypatch.setattr(scoring, "MOST_WEIGHTS", 0)  # a batch too large to send is joined
        assert rows(rt.best_files(index, q, depth).select(*file.columns)) == rows(file)
        monkeypatch.setattr(scoring, "MOST_WEIGHTS", 500_000)


def test_a_large_file_leaves_few_pairs_of_a_task(spark, monkeypatch):
    """Vectors of a chosen file are scored together, however few of it a chunk has."""
    vectors = spark.range(0, 4000, 1, 1).select(
        F.concat(F.lit("f"), (F.col("id") % 100).cast("string")).alias("path"), F.col("id").alias("line_start"),
        F.array(*[((F.col("id") * k) % 251 - 125).cast("tinyint") for k in (7, 11, 13)]).alias("embedding"))
    queries = spark.createDataFrame([(1, [3, 4, 5])], "qid bigint, embedding array<tinyint>")
    chosen = spark.createDataFrame([(1, "f1"), (1, "f2")], "qid bigint, path string")
    found = []
    monkeypatch.setattr(dense, "top_k", lambda df, *a, **b: found.append(df) or df)
    monkeypatch.setattr(dense, "CHUNK_ROWS", 200)
    dense.within_files(vectors, queries, chosen, 5).count()
    assert found[0].count() == 10
