"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.session import attach



def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import discriminant

    return discriminant.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import jaccardjoin

    return jaccardjoin.jaccard_components(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import neighbours

    return neighbours.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import recurrent

    return recurrent.score_documents(_table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import licences

    found = licences.license_scan(_table(spark, sf_dir, "documents"))
    return found.drop("places", "expressions")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import forest

    return forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import linechunks

    found = linechunks.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import winnow

    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import piececount

    pieces = piececount.read_pieces(_tokenizer("piece_bpe_32k.model"))
    return piececount.token_counts(_table(spark, sf_dir, "documents"), pieces)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import rules

    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import prefixtrie

    return prefixtrie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm import repair

    return repair.repair(_table(spark, sf_dir, "conversations"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_jaccard": op2_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_language_model": op5_language_model,
    "op6_licences": op6_licences,
    "op7_vectors": op7_vectors,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}

def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters, bit by bit: DuckDB has no such function."""
    step = "xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda z: unicode(z)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


def _field(state: str, name: str) -> str:
    return f"struct_extract({state}, '{name}')"


def _edit(state: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
    """The best way into a state, one edit longer: cost, audit and repaired lines; null where there is none."""
    return (
        f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {_field(state, 'c')} + {cost}, 'a': {_field(state, 'a')} || '{letter}', "
        f"'o': {_field(state, 'o')} || {line}}} END"
    )


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"


def _repair_sql() -> str:
    """The repair by a forward programme over whole audits: states are nothing yet, after system, user, assistant."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    closed = f"""SELECT *, {_least('s3', _edit('u2', '2', 'I', assistant))} AS u3 FROM (
      SELECT *, {_least('s2', *(_edit(s, '2', 'I', user) for s in ('s0', 's1', 's3')))} AS u2 FROM ("""
    keep = lambda s, initial: _edit(s, "late", "K", "own", f"initial = '{initial}' AND NOT must")
    turn = lambda s, line: _edit(s, "2 + late", "R", f"{line} || text", "NOT must")
    steps = [
        [_edit("s0", "3", "D")],
        [_edit("s1", "3", "D"), keep("s0", "s")],
        [_edit("u2", "3", "D"), *(f(s) for s in ("s0", "s1", "u3") for f in (lambda x: keep(x, "u"), lambda x: turn(x, user)))],
        [_edit("u3", "3", "D"), keep("u2", "a"), turn("u2", assistant)],
    ]
    none = "CASE WHEN false THEN {'c': 0::BIGINT, 'a': '', 'o': ''} END"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""
WITH RECURSIVE dam AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, k
  FROM (SELECT *, {_crc32(key)} % 20 AS k FROM conversations) WHERE k <> 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial
  FROM (SELECT conv_id, turn, role, text FROM dam UNION ALL SELECT conv_id, turn, role, text FROM dam WHERE k = 3)),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
    i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM r),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM ids
  UNION ALL
  SELECT conv_id, i, {', '.join(f'{_least(*ways)} AS n{k}' for k, ways in enumerate(steps))} FROM (
    {closed} SELECT w.s0, w.s1, w.s2, w.s3, f.conv_id, f.i, f.initial, f.text, f.fault IN ('blank', 'duplicate') AS must,
      CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS late, chr(10) || f.role || ':' || f.text AS own
      FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)))),
n AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
best AS (SELECT conv_id, {_least('s0', 'u3')} AS b FROM ({closed} SELECT w.* FROM walk w JOIN (
  SELECT ids.conv_id, coalesce(n.n, 0) AS n FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id) e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.n = w.i))))
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, {_field('b', 'c')}::BIGINT AS cost, {_field('b', 'a')} AS audit, sha256(substr({_field('b', 'o')}, 2)) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
"""


ORACLE_SQL: dict[str, str] = {
    "op13_structure_repair": _repair_sql(),
    "op12_prefix_trie": rf"""
WITH c AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM c)),
built AS (
  SELECT i.conv_id, 0 AS part, c.p, c.role, c.text FROM ids i JOIN c ON c.conv_id = i.base AND c.p <= i.h
  UNION ALL SELECT i.conv_id, 1, c.p, c.role, c.text FROM ids i JOIN c ON c.conv_id = i.conv_id AND c.p > i.h),
seq AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, text,
    sha256(length(role)::VARCHAR || ':' || role || text) AS h FROM built),
pre AS (
  SELECT conv_id, d, text, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM seq
  UNION ALL SELECT conv_id, 0, '', '' FROM ids),
nodes AS (SELECT k, d, min(conv_id) AS c, count(*) AS n, min(text) AS text FROM pre GROUP BY k, d),
mem AS (SELECT p.conv_id, p.d, n.c FROM pre p JOIN nodes n ON n.k = p.k AND n.d = p.d),
ups AS (SELECT n.c, n.d, m.c AS up FROM nodes n JOIN mem m ON m.conv_id = n.c AND m.d = n.d - 1),
kids AS (SELECT up AS c, d - 1 AS d, count(*) AS n FROM ups GROUP BY ALL),
own AS (
  SELECT n.c, n.d, n.n, coalesce(k.n, 0) AS kids,
    (n.n - 1) * len(regexp_extract_all(n.text, '[^ 	-
]+')) AS saved
  FROM nodes n LEFT JOIN kids k ON k.c = n.c AND k.d = n.d),
sub AS (
  SELECT m.c, m.d, count(*) FILTER (o.kids = 0) AS n_leaves, sum(o.saved)::BIGINT AS saved_tokens
  FROM own o JOIN mem m ON m.conv_id = o.c AND m.d <= o.d GROUP BY ALL),
last AS (SELECT conv_id, max(d) AS d FROM pre GROUP BY conv_id),
ends AS (SELECT m.c, m.d, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM last l JOIN mem m ON m.conv_id = l.conv_id AND m.d = l.d GROUP BY ALL)
SELECT o.c AS conv_id, o.d AS depth, u.up AS parent_conv_id, o.n AS n_convs, o.kids AS n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM own o JOIN sub s ON s.c = o.c AND s.d = o.d LEFT JOIN ups u ON u.c = o.c AND u.d = o.d LEFT JOIN ends e ON e.c = o.c AND e.d = o.d
""",
    "op9_decontaminate": r"""
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM folded),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
dn AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)),
bn AS (
  SELECT item_id, n, list(word) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l
  FROM (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM b)),
bw AS (
  SELECT DISTINCT item_id, least(13, n) AS t, array_to_string(l, ' ') AS win FROM bn WHERE len(l) = least(13, n)),
dw AS (
  SELECT doc_id, i, t, array_to_string(l[1:t], ' ') AS win
  FROM dn, (SELECT DISTINCT t FROM bw) WHERE len(l) >= t),
hit AS (SELECT doc_id, i, t, item_id FROM dw JOIN bw USING (win, t)),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + t)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cover.n_hit, 0) AS n_hit,
  coalesce(named.n_items, 0) AS n_items, sha256(coalesce(named.ids, '')) AS items_sha256,
  coalesce(cover.n_hit, 0) > 0 AND 20 * coalesce(cover.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
""",
}
