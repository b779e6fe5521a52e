"""The same results in SQL over the same tables, for comparison. Written from the rules, not the
Spark plans: plain joins, cross products and recursion, sized for the small tables."""

from __future__ import annotations

import re

from gleanery.functions import porter as pt
from gleanery.functions.words import STOP_TERMS
from gleanery.operators import service as sv
from gleanery.operators.calibration import DRAWS
from gleanery.params import CALIBRATION_LENGTHS, CALIBRATION_QUANTILE, CALIBRATION_QUERIES, CALIBRATION_SEED, DEFAULT_LIMITS, PROMPT_ID, PROMPT_SHA256
from gleanery.plans.fixtures import SPEND_CAP

STOP = ", ".join(f"'{w}'" for w in STOP_TERMS)
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = r"[\p{L}\p{N}]+"
NAME = "docs/fixture"
COMMIT = "0" * 40
DAY_US = 86_400_000_000


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def word_list(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '{WORDS}')"


def kept_words(x: str) -> str:
    return f"list_filter({word_list(x)}, lambda w: w NOT IN ({STOP}))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACES}]+', ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+\z', '', 'g')"


def blank(x: str) -> str:
    return rf"regexp_matches({x}, '^[{SPACES}]*\z')"


def usd(x: str) -> str:
    return f"printf('%d.%06d', {x} // 1000000000, ({x} % 1000000000) // 1000)"


def pct(a: str, b: str) -> str:
    return f"printf('%.1f%%', CASE WHEN {b} > 0 THEN 100.0 * {a} / {b} ELSE 0.0 END)"


# --- Porter ---------------------------------------------------------------------------------------


def shape(x: str) -> str:
    s = f"regexp_replace(regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        s = f"regexp_replace(regexp_replace({s}, 'Vy', 'VC', 'g'), 'Cy', 'CV', 'g')"
    return s


def m_at_least(x: str, n: int) -> str:
    return f"regexp_matches({shape(x)}, '{'V+C+' * (n - 1)}V+C')"


def short_tail(x: str) -> str:
    return rf"(regexp_matches({shape(x)}, 'CVC\z') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _suffixes(names) -> str:
    return "(?s)^(.*?)(" + "|".join(sorted(names, key=len, reverse=True)) + r")\z"


def _swap(src: str, table: dict[str, str]) -> str:
    pat = _suffixes(table)
    head, tail = f"regexp_extract({src}, '{pat}', 1)", f"regexp_extract({src}, '{pat}', 2)"
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE WHEN {tail} <> '' AND {m_at_least(head, 1)} THEN {head} || (CASE {tail} {arms} END) ELSE {src} END"


_H1 = "regexp_extract(a, '(?s)^(.*)(ed|ing)\\z', 1)"
_T1 = "regexp_extract(a, '(?s)^(.*)(ed|ing)\\z', 2)"
_P4 = _suffixes(pt.STEP4)
_H4, _T4 = f"regexp_extract(d, '{_P4}', 1)", f"regexp_extract(d, '{_P4}', 2)"
STEMS = f"""
s_a AS (SELECT word, CASE WHEN word LIKE '%sses' OR word LIKE '%ies' THEN {cut('word', 2)}
    WHEN word LIKE '%ss' THEN word WHEN word LIKE '%s' THEN {cut('word', 1)} ELSE word END AS a
    FROM vocab WHERE length(word) > 2),
s_b AS (SELECT word, CASE
    WHEN a LIKE '%eed' THEN CASE WHEN {m_at_least(cut('a', 3), 1)} THEN {cut('a', 1)} ELSE a END
    WHEN {_T1} <> '' AND contains({shape(_H1)}, 'V') THEN CASE
        WHEN regexp_matches({_H1}, '(at|bl|iz)\\z') THEN {_H1} || 'e'
        WHEN right({_H1}, 1) = left(right({_H1}, 2), 1) AND length({_H1}) > 1 AND regexp_matches({shape(_H1)}, 'C\\z')
            AND right({_H1}, 1) NOT IN ('l', 's', 'z') THEN {cut(_H1, 1)}
        WHEN {m_at_least(_H1, 1)} AND NOT {m_at_least(_H1, 2)} AND {short_tail(_H1)} THEN {_H1} || 'e'
        ELSE {_H1} END
    ELSE a END AS b FROM s_a),
s_c AS (SELECT word, CASE WHEN b LIKE '%y' AND contains({shape(cut('b', 1))}, 'V') THEN {cut('b', 1)} || 'i'
    ELSE b END AS c FROM s_b),
s_2 AS (SELECT word, {_swap('c', pt.STEP2)} AS c2 FROM s_c),
s_3 AS (SELECT word, {_swap('c2', pt.STEP3)} AS d FROM s_2),
s_4 AS (SELECT word, CASE WHEN {_T4} <> '' AND {m_at_least(_H4, 2)}
    AND ({_T4} <> 'ion' OR regexp_matches({_H4}, '[st]\\z')) THEN {_H4} ELSE d END AS e FROM s_3),
s_5 AS (SELECT word, CASE WHEN e LIKE '%e' AND ({m_at_least(cut('e', 1), 2)}
    OR ({m_at_least(cut('e', 1), 1)} AND NOT {short_tail(cut('e', 1))})) THEN {cut('e', 1)} ELSE e END AS f FROM s_4),
stems AS (SELECT word, CASE WHEN f LIKE '%ll' AND {m_at_least('f', 2)} THEN {cut('f', 1)} ELSE f END AS term FROM s_5
    UNION ALL SELECT word, word FROM vocab WHERE length(word) <= 2)"""

# --- shared tables --------------------------------------------------------------------------------

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


cte("qs", "SELECT item_id AS qid, text AS question FROM benchmark")
cte("raw_words", f"SELECT source AS path, doc_id AS line_start, unnest({kept_words('text')}) AS word FROM documents")
cte("paths", "SELECT DISTINCT source AS path FROM documents")
cte("path_words", f"SELECT path, unnest({kept_words("regexp_replace(path, '[.][^./]*$', '')")}) AS word FROM paths")
cte("q_words", f"SELECT qid, unnest({kept_words('question')}) AS word FROM qs")
cte("vocab", "SELECT word FROM raw_words UNION SELECT word FROM path_words UNION SELECT word FROM q_words")
CTES["stems"] = STEMS  # several tables; rendered as they are
cte("p_words", "SELECT path, line_start, word FROM raw_words UNION ALL SELECT d.source, d.doc_id, w.word FROM documents d JOIN path_words w ON w.path = d.source")
cte("p_terms", "SELECT path, line_start, term, count(*) AS tf FROM p_words JOIN stems USING (word) GROUP BY ALL")
cte("p_len", "SELECT path, line_start, sum(tf)::BIGINT AS dl FROM p_terms GROUP BY ALL")
cte("p_stat", "SELECT count(*) AS n, (SELECT sum(tf) FROM p_terms)::BIGINT AS total FROM documents")
cte("p_df", "SELECT term, count(*) AS df FROM p_terms GROUP BY ALL")
cte("f_words", "SELECT path, word FROM raw_words UNION ALL SELECT path, word FROM path_words")
cte("f_terms", "SELECT path, term, count(*) AS tf FROM f_words JOIN stems USING (word) GROUP BY ALL")
cte("f_len", "SELECT path, sum(tf)::BIGINT AS dl FROM f_terms GROUP BY ALL")
cte("f_stat", "SELECT count(*) AS n, (SELECT sum(tf) FROM f_terms)::BIGINT AS total FROM paths")
cte("f_df", "SELECT term, count(*) AS df FROM f_terms GROUP BY ALL")
cte("q_terms", "SELECT DISTINCT qid, term FROM q_words JOIN stems USING (word)")


def _bm25(u: str, keys: str, asked: str = "q_terms") -> str:
    return f"""SELECT qid, {keys}, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * dl / (s.total / s.n)))), 9) AS score
        FROM {asked} JOIN {u}_terms USING (term) JOIN {u}_df USING (term) JOIN {u}_len USING ({keys}) CROSS JOIN {u}_stat s
        GROUP BY qid, {keys}"""


cte("p_score", _bm25("p", "path, line_start"))
cte("f_score", _bm25("f", "path"))
cte("p_lex", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, line_start) AS rank FROM p_score")
cte("f_lex", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM f_score")


def _vec(src: str, keys: str, text: str, name: str) -> None:
    words = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
    cte(f"{name}_w", f"SELECT {keys}, unnest({words}) AS w FROM {src}")
    cte(f"{name}_h", f"SELECT {keys}, sha256(w) AS h FROM {name}_w")
    cte(f"{name}_s", f"""SELECT {keys}, ('0x' || left(h, 8))::UBIGINT % 384 AS slot,
        sum(CASE WHEN ('0x' || substr(h, 9, 2))::UBIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM {name}_h GROUP BY ALL""")
    cte(f"{name}_n", f"SELECT {keys}, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name}_s GROUP BY ALL")
    cte(f"{name}_q", f"""SELECT {keys}, slot::BIGINT AS slot, CASE WHEN norm > 0 THEN round_even(v::DOUBLE / norm * 127, 0)::BIGINT ELSE 0 END AS b
        FROM {name}_s JOIN {name}_n USING ({keys})""")


_vec("documents", "doc_id", "text", "dv")
_vec("qs", "qid", "question", "qv")
cte("dot_some", "SELECT qid, doc_id, sum(q.b * d.b)::BIGINT AS dot FROM qv_q q JOIN dv_q d USING (slot) GROUP BY ALL")
cte("dots", """SELECT q.qid, d.source AS path, d.doc_id AS line_start, coalesce(s.dot, 0) AS dot
    FROM qs q CROSS JOIN documents d LEFT JOIN dot_some s ON s.qid = q.qid AND s.doc_id = d.doc_id""")
cte("top", "SELECT qid, max(dot) / 16129.0 AS top_score FROM dots GROUP BY ALL")
cte("f_near", "SELECT qid, path, max(dot) AS dot, row_number() OVER (PARTITION BY qid ORDER BY max(dot) DESC, path) AS rank FROM dots GROUP BY qid, path")
cte("p_near", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dot DESC, path, line_start) AS rank FROM dots")
cte("fused", """SELECT qid, path, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
    SELECT qid, path, rank FROM f_lex WHERE rank <= 100 UNION ALL SELECT qid, path, rank FROM f_near WHERE rank <= 100) GROUP BY ALL""")
cte("f_all", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM fused")
cte("files", "SELECT * FROM f_all WHERE rank <= 5")


def _shown(files: str, name: str, lexical: str = "p_score", dense: str = "dots") -> None:
    cte(f"{name}_in", f"""SELECT s.qid, s.path, s.line_start, row_number() OVER (PARTITION BY s.qid, s.path ORDER BY s.score DESC, s.line_start) AS r
        FROM {lexical} s SEMI JOIN {files} f ON f.qid = s.qid AND f.path = s.path
        UNION ALL SELECT s.qid, s.path, s.line_start, row_number() OVER (PARTITION BY s.qid, s.path ORDER BY s.dot DESC, s.line_start)
        FROM {dense} s SEMI JOIN {files} f ON f.qid = s.qid AND f.path = s.path""")
    cte(f"{name}_w", f"SELECT qid, path, line_start, sum(1.0::DOUBLE / (60 + r)) AS within FROM {name}_in WHERE r <= 100 GROUP BY ALL")
    cte(f"{name}_r", f"SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY within DESC, line_start) AS passage_rank FROM {name}_w")
    cte(name, f"""SELECT f.qid, f.rank, f.path, f.score, s.line_start, s.within, s.passage_rank FROM {files} f
        JOIN {name}_r s ON s.qid = f.qid AND s.path = f.path WHERE s.passage_rank <= 2""")


_shown("files", "shown")
cte("cands", "SELECT * FROM f_all WHERE rank <= 20")
_shown("cands", "cshown")
ESC = "replace(replace(replace(replace({}, '%', '%25'), ' ', '%20'), '#', '%23'), '?', '%3F')"
FILE_URL = f"'https://github.com/{NAME}/blob/{COMMIT}/' || " + ESC
cte("shown_text", f"""SELECT s.*, d.text, {FILE_URL.format('s.path')} AS file_url,
    {FILE_URL.format('s.path')} || '?plain=1#L' || s.line_start || '-L' || s.line_start AS url
    FROM shown s JOIN documents d ON d.doc_id = s.line_start""")

# --- labels and verdicts ----------------------------------------------------------------------------

cte("labelled", """SELECT item_id AS qid, text AS question, item_id % 4 AS set_index, 'set-' || (item_id % 4) AS "set", item_id AS position,
    item_id % 3 <> 0 AS answerable, CASE WHEN item_id % 3 <> 0 THEN ['src' || (item_id % 20), 'src' || ((item_id * 7 + 3) % 20),
    'src' || ((item_id * 3 + 11) % 20), 'src' || ((item_id * 9 + 5) % 20)] ELSE [] END AS sources,
    item_id % 3 = 0 AND item_id % 2 = 0 AS hard_negative FROM benchmark""")
cte("got", "SELECT qid, string_agg(path, ', ' ORDER BY rank) AS got, string_agg(path, '|' ORDER BY rank) AS piped, min_by(path, rank) AS top_path FROM files GROUP BY ALL")
cte("hits", """SELECT l.qid, min(f.rank) AS rank, min_by(f.path, f.rank) AS hit_path FROM labelled l JOIN files f USING (qid)
    WHERE l.answerable AND list_contains(l.sources, f.path) GROUP BY ALL""")
cte("ranked", "SELECT l.*, h.rank, h.hit_path, g.got, g.piped, g.top_path FROM labelled l LEFT JOIN hits h USING (qid) LEFT JOIN got g USING (qid)")


def reply(number: str, text: str) -> str:
    return f"""CASE WHEN ({number}) % 9 = 8 THEN '' ELSE {text} || chr(10) || CASE ({number}) % 9
        WHEN 0 THEN 'Q1 ANSWERABLE' WHEN 1 THEN 'Q1 NOT_ANSWERABLE: not covered' WHEN 2 THEN 'Q1 ANSWERABLE: NOT_ANSWERABLE'
        WHEN 3 THEN 'Q2 ANSWERABLE' WHEN 4 THEN '  Q1 ANSWERABLE with a reason  ' WHEN 5 THEN 'Q1  ANSWERABLE'
        WHEN 6 THEN 'Q1 NOT_ANSWERABLE' || chr(13) || chr(10) || chr(13) || chr(10) WHEN 7 THEN 'Q1 ANSWERABLE' || chr(8203) END END"""


LINE = rf"^([^ ]+) (ANSWERABLE|NOT_ANSWERABLE):?(?: [^{SPACES}](?s:.*))?\z"


def parsed(src: str, keys: str, name: str) -> None:
    """Tables name: keys, token, category from (keys, reply)."""
    lines = rf"list_filter(list_transform(regexp_split_to_array(reply, '\r\n|\n|\r'), lambda x: {strip('x')}), lambda x: x <> '')"
    cte(f"{name}_l", f"SELECT {keys}, reply, {lines} AS ls FROM {src}")
    cte(f"{name}_c", rf"""SELECT {keys}, reply, ls[-1] AS l, CASE WHEN strlen(reply) > 4096 THEN 'reply too long'
        WHEN len(ls) = 0 THEN 'empty reply'
        WHEN regexp_matches(replace(replace(reply, chr(10), ''), chr(13), ''), '[\p{{Cc}}\p{{Cf}}]') THEN 'control or format character'
        WHEN NOT regexp_matches(ls[-1], '{LINE}') THEN 'malformed verdict line'
        WHEN regexp_extract(ls[-1], '{LINE}', 1) <> 'Q1' THEN 'wrong block id'
        WHEN len(regexp_extract_all(ls[-1], 'ANSWERABLE')) <> 1 THEN 'more than one verdict token' END AS category FROM {name}_l""")
    cte(name, f"SELECT {keys}, category, CASE WHEN category IS NOT NULL THEN 'JUDGE_ERROR' ELSE regexp_extract(l, '{LINE}', 2) END AS token FROM {name}_c")


cte("replies", f"SELECT qid, {reply('qid', 'question')} AS reply FROM qs")
parsed("replies", "qid", "verdicts")
cte("turn_replies", f"SELECT conv_id, turn, {reply('conv_id + turn', 'text')} AS reply FROM conversations")
parsed("turn_replies", "conv_id, turn", "turn_verdicts")
SIGNAL = f"'Deciding signal: answerability judge verdict ' || token || ' (prompt {PROMPT_ID}, sha256 {PROMPT_SHA256})' || chr(10)"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def forged(x: str) -> str:
    hits = f"list_filter(regexp_split_to_array({x}, '{BREAKS}'), lambda x: regexp_matches(x, '^(=== |--- passage |--- end passage )'))"
    return f"len({hits}) > 0"


cte("blocks", f"""SELECT qid, max({forged('text')}) AS forged, string_agg(
    CASE WHEN passage_rank = 1 THEN 'File ' || rank || ': ' || path || chr(10) ELSE '' END
    || '--- passage ' || rank || substr('abcdefghij', passage_rank, 1) || ' | heading: (top of file) | lines ' || line_start || '-' || line_start || ' ---' || chr(10)
    || text || chr(10) || '--- end passage ' || rank || substr('abcdefghij', passage_rank, 1) || ' ---' || chr(10) || chr(10), '' ORDER BY rank, passage_rank) AS blocks
    FROM shown_text GROUP BY qid""")
cte("payloads", f"""SELECT qid, forged, sha256('=== Q1 ===' || chr(10) || 'Question: ' || {squeeze('question')} || chr(10) || chr(10)
    || blocks || '=== end Q1 ===' || chr(10)) AS input_sha256 FROM qs JOIN blocks USING (qid)""")
cte("judged", """SELECT r.qid, r.answerable, r.hard_negative, r.rank, v.token AS verdict,
    CASE WHEN NOT answerable THEN 'abstain' WHEN rank IS NOT NULL THEN 'show (right file rank ' || rank || ')' ELSE 'show (right file not in top 5)' END AS expected,
    CASE WHEN answerable AND rank IS NULL THEN 'n/a' WHEN token = (CASE WHEN answerable THEN 'ANSWERABLE' ELSE 'NOT_ANSWERABLE' END) THEN 'AGREE' ELSE 'DIFF' END AS agreement
    FROM ranked r JOIN verdicts v USING (qid)""")
cte("bars", """SELECT count(*) FILTER (NOT answerable AND verdict = 'NOT_ANSWERABLE') AS abstained, count(*) FILTER (NOT answerable) AS unanswerable_total,
    count(*) FILTER (answerable AND rank IS NOT NULL AND verdict = 'ANSWERABLE') AS shown, count(*) FILTER (answerable AND rank IS NOT NULL) AS hit_total,
    count(*) FILTER (answerable) AS answerable_total, count(*) FILTER (verdict = 'JUDGE_ERROR') AS judge_errors,
    count(*) FILTER (NOT answerable AND hard_negative AND verdict = 'NOT_ANSWERABLE') AS hard_abstained,
    count(*) FILTER (NOT answerable AND hard_negative) AS hard_total FROM judged""")
cte("bars_met", "SELECT *, unanswerable_total > 0 AND abstained * 5 >= unanswerable_total * 4 AS bar1_met, hit_total > 0 AND shown * 5 >= hit_total * 4 AS bar2_met FROM bars")

# --- signals and sweep --------------------------------------------------------------------------------

cte("in_files", "SELECT d.qid, d.path, d.line_start, d.dot / 16129.0::DOUBLE AS sim FROM dots d SEMI JOIN files f ON f.qid = d.qid AND f.path = d.path")
cte("best_file", "SELECT qid, path, max(sim) AS sim FROM in_files GROUP BY ALL")
cte("file_two", "SELECT qid, list(sim ORDER BY sim DESC)[1] AS top1, list(sim ORDER BY sim DESC)[2] AS top2 FROM best_file GROUP BY ALL")
cte("pass_two", "SELECT qid, list(sim ORDER BY sim DESC)[1] - list(sim ORDER BY sim DESC)[2] AS pmargin FROM in_files GROUP BY ALL")
cte("best_shown", "SELECT i.qid, max(sim) AS top1_shown FROM in_files i JOIN shown s ON s.qid = i.qid AND s.line_start = i.line_start GROUP BY ALL")
cte("sig", """SELECT r."set", r.qid, CASE WHEN answerable THEN 'answerable' ELSE 'unanswerable' END AS label, hard_negative::BIGINT AS hard_negative,
    CASE WHEN answerable THEN (rank IS NOT NULL)::BIGINT END AS in_top5, rank, top1, top2, top1 - top2 AS margin, pmargin,
    top_score AS top1_printed_global, top1_shown, piped AS files
    FROM ranked r JOIN file_two USING (qid) JOIN pass_two USING (qid) JOIN best_shown USING (qid) JOIN top USING (qid)""")
cte("ts", "SELECT i, round(0.40::DOUBLE + 0.01::DOUBLE * i, 2) AS t FROM range(51) r(i)")
cte("ms", "SELECT i, round(0.005::DOUBLE * i, 3) AS m FROM range(21) r(i)")


def _counts(name: str, cells: str, rule: str) -> None:
    keys = ", ".join(k for k in ("t", "m") if re.search(rf"\b{k}s\b", cells))
    cte(name, f"""SELECT "set", {keys}, count(*) FILTER (label = 'unanswerable' AND ({rule})) AS b1_num, count(*) FILTER (label = 'unanswerable') AS b1_den,
        count(*) FILTER (in_top5 = 1 AND NOT ({rule})) AS b2_num, count(*) FILTER (in_top5 = 1) AS b2_den FROM sig CROSS JOIN {cells} GROUP BY ALL""")
    cte(f"{name}_all", f"""SELECT {keys}, sum(b1_num)::BIGINT AS b1_num, sum(b1_den)::BIGINT AS b1_den, sum(b2_num)::BIGINT AS b2_num, sum(b2_den)::BIGINT AS b2_den
        FROM {name} GROUP BY ALL""")


_counts("sw_t", "ts", "top1 < t")
_counts("sw_m", "ms", "margin < m")
_counts("sw_pm", "ms", "pmargin < m")
_counts("sw_g", "ts", "top1_printed_global < t")
_counts("sw_tm", "ts CROSS JOIN ms", "top1 < t OR margin < m")
MINFRAC = """least(CASE WHEN {0}b1_den > 0 THEN {0}b1_num / {0}b1_den::DOUBLE ELSE 1.0 END, CASE WHEN {0}b2_den > 0 THEN {0}b2_num / {0}b2_den::DOUBLE ELSE 1.0 END)"""
cte("folds", """SELECT h."set" AS held, c.t, c.m, sum(c.b1_num)::BIGINT AS b1_num, sum(c.b1_den)::BIGINT AS b1_den, sum(c.b2_num)::BIGINT AS b2_num, sum(c.b2_den)::BIGINT AS b2_den
    FROM (SELECT DISTINCT "set" FROM sw_tm) h JOIN sw_tm c ON c."set" <> h."set" GROUP BY ALL""")
cte("chosen", f"SELECT *, row_number() OVER (PARTITION BY held ORDER BY {MINFRAC.format('')} DESC, t, m) AS k FROM folds")
cte("loso", """SELECT f.held AS held_out, f.t, f.m, f.b1_num AS train_b1_num, f.b1_den AS train_b1_den, f.b2_num AS train_b2_num, f.b2_den AS train_b2_den,
    c.b1_num AS test_b1_num, c.b1_den AS test_b1_den, c.b2_num AS test_b2_num, c.b2_den AS test_b2_den,
    c.b1_den > 0 AND c.b1_num * 100 >= c.b1_den * 80 AND c.b2_den > 0 AND c.b2_num * 100 >= c.b2_den * 80 AS both_80
    FROM chosen f JOIN sw_tm c ON c."set" = f.held AND c.t = f.t AND c.m = f.m WHERE k = 1""")
cte("sampled_hits", "SELECT *, row_number() OVER (ORDER BY set_index, position) AS turn FROM ranked WHERE answerable AND rank IS NOT NULL")
cte("sample", """SELECT printf('r%03d', row_number() OVER (ORDER BY set_index, position)) AS run_id, set_index, position, qid, 'sample' AS role
    FROM (SELECT set_index, position, qid FROM ranked WHERE NOT answerable UNION ALL SELECT set_index, position, qid FROM sampled_hits WHERE turn % 2 = 1)
    UNION ALL SELECT printf('r%03d', 1 + (SELECT count(*) FILTER (NOT answerable) FROM ranked) + (SELECT count(*) FILTER (turn % 2 = 1) FROM sampled_hits)), set_index, position, qid, 'smoke' FROM sampled_hits WHERE turn = 2""")
cte("responses", """SELECT v.qid, CASE token WHEN 'ANSWERABLE' THEN 'answer' WHEN 'NOT_ANSWERABLE' THEN 'no_confident_match' ELSE 'judge_error' END AS outcome,
    token = 'ANSWERABLE' AS has_files, (v.qid * 37 % 101) / 10.0::DOUBLE AS seconds FROM verdicts v WHERE qid % 10 <> 9""")
cte("gate", """SELECT r.qid, CASE WHEN answerable THEN 'answerable' WHEN hard_negative THEN 'hostile' ELSE 'unanswerable' END AS kind, seconds,
    CASE WHEN outcome IS NULL THEN 'NOT RUN' WHEN (CASE WHEN answerable THEN outcome = 'answer' AND rank IS NOT NULL
    ELSE outcome = 'no_confident_match' AND NOT has_files END) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ranked r LEFT JOIN responses USING (qid)""")

# --- Markdown -----------------------------------------------------------------------------------------

N = "(doc_id + i - 1)"
LEVEL = f"repeat('#', ({N} % 6 + 1)::INT)"
NL = "chr(10)"
TURN = f"""CASE WHEN {N} % 11 = 0 THEN {LEVEL} || ' ' || x || ' ##'
    WHEN {N} % 11 = 2 THEN '```' || {NL} || '# ' || x || {NL} || '````'
    WHEN {N} % 11 = 3 THEN '  ' || {LEVEL} || chr(9) || x
    WHEN {N} % 11 = 5 THEN '~~~~' || {NL} || x || {NL} || '~~~' || {NL} || '# in' || {NL} || '~~~~ end'
    WHEN {N} % 11 = 7 THEN '#' || x || {NL} || '    # code' || {NL} || '####### x'
    WHEN {N} % 11 = 8 THEN x || {NL} || '# #' || {NL} || {NL}
    WHEN {N} % 11 = 9 AND {N} % 5 = 0 THEN '```` open' || {NL} || x ELSE x END"""
cte("md", f"""SELECT source || '/' || doc_id || '.md' AS path,
    CASE doc_id % 4 WHEN 0 THEN '---' || {NL} || '# meta' || {NL} || '---' || {NL} WHEN 1 THEN '---' || {NL} || 'no end' || {NL} ELSE '' END
    || array_to_string(list_transform(string_split(text, {NL}), lambda x, i: {TURN}), {NL})
    || CASE WHEN doc_id % 3 = 0 THEN {NL} || ' ' || {NL} || {NL} ELSE '' END AS text FROM documents""")
cte("md_lines", f"""SELECT path, unnest(string_split(text, {NL})) AS line, generate_subscripts(string_split(text, {NL}), 1) AS n,
    len(string_split(text, {NL})) AS total FROM md""")
cte("md_front", "SELECT path, min(n) FILTER (n > 1 AND line = '---') AS closing, max(CASE WHEN n = 1 THEN line END) AS first FROM md_lines GROUP BY ALL")
FENCE = r"^ {0,3}(`{3,}|~{3,})"
HEAD = r"^ {0,3}(#{1,6})(?:[ \t]+([^\n]*?))?[ \t]*\z"
RAWH = f"{strip(f'regexp_extract(line, {chr(39)}{HEAD}{chr(39)}, 2)')}"
cte("md_marks", rf"""SELECT path, n, regexp_extract(line, '{FENCE}', 1) AS fence, length(regexp_extract(line, '{HEAD}', 1)) AS level,
    CASE WHEN regexp_matches({RAWH}, '^#+\z') THEN '' ELSE {strip(rf"regexp_replace({RAWH}, '[ \t]+#+[ \t]*\z', '')")} END AS heading,
    row_number() OVER (PARTITION BY path ORDER BY n) AS k
    FROM md_lines JOIN md_front USING (path) WHERE n > (CASE WHEN first = '---' AND closing IS NOT NULL THEN closing ELSE 0 END)
    AND (regexp_matches(line, '{FENCE}') OR regexp_matches(line, '{HEAD}'))""")
CTES["md_walk"] = """md_walk AS (SELECT path, k, n, CASE WHEN fence <> '' THEN fence ELSE '' END AS open, fence = '' AS is_head,
        CASE WHEN fence = '' THEN [{'level': level, 'heading': heading}] ELSE [] END AS trail, heading FROM md_marks WHERE k = 1
    UNION ALL SELECT m.path, m.k, m.n, CASE WHEN w.open <> '' AND starts_with(m.fence, w.open) THEN '' WHEN w.open = '' AND m.fence <> '' THEN m.fence ELSE w.open END,
        w.open = '' AND m.fence = '', CASE WHEN w.open = '' AND m.fence = '' THEN list_append(list_filter(w.trail, lambda t: t.level < m.level), {'level': m.level, 'heading': m.heading}) ELSE w.trail END,
        m.heading FROM md_walk w JOIN md_marks m ON m.path = w.path AND m.k = w.k + 1)"""
cte("md_heads", "SELECT path, n, heading, list_transform(trail, lambda t: t.heading) AS trail FROM md_walk WHERE is_head")
cte("md_starts", """SELECT path, n, heading, trail FROM md_heads UNION ALL SELECT l.path, 1, '', []::VARCHAR[] FROM md_lines l
    WHERE l.n = 1 AND NOT EXISTS (SELECT 1 FROM md_heads h WHERE h.path = l.path AND h.n = 1)""")
cte("md_spans", "SELECT *, lead(n) OVER (PARTITION BY path ORDER BY n) AS nxt FROM md_starts")
cte("md_ends", f"""SELECT s.path, s.n, s.heading, s.trail, max(l.n) FILTER (NOT {blank('l.line')}) AS last_text FROM md_spans s
    JOIN md_lines l ON l.path = s.path AND l.n >= s.n AND l.n < coalesce(s.nxt, l.total + 1) GROUP BY ALL""")
cte("md_sections", f"""SELECT e.path, e.n AS line_start, e.heading, e.trail, coalesce(e.last_text, e.n) AS line_end,
    CASE WHEN len(e.trail) > 0 THEN e.last_text > e.n ELSE e.last_text IS NOT NULL END AS kept,
    string_agg(l.line, {NL} ORDER BY l.n) AS text FROM md_ends e JOIN md_lines l ON l.path = e.path AND l.n BETWEEN e.n AND coalesce(e.last_text, e.n) GROUP BY ALL""")
cte("md_body", f"""SELECT *, CASE WHEN len(trail) > 0 THEN regexp_extract(text, '(?s)^[^\\n]*\\n(.*)$', 1) ELSE text END AS body FROM md_sections WHERE kept""")
S_STEM = """CASE WHEN length(w) <= 3 THEN w WHEN regexp_matches(w, 'ies$') AND NOT regexp_matches(w, '[ea]ies$') THEN regexp_replace(w, 'ies$', 'y')
    WHEN regexp_matches(w, 'es$') AND NOT regexp_matches(w, '[aeo]es$') THEN regexp_replace(w, 'es$', 'e')
    WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '[us]s$') THEN regexp_replace(w, 's$', '') ELSE w END"""
cte("md_words", f"""SELECT path, line_start, unnest({kept_words('body')}) AS w, 1 AS weight FROM md_body
    UNION ALL SELECT path, line_start, unnest({kept_words("array_to_string(trail, ' ')")}), 2 FROM md_body
    UNION ALL SELECT path, line_start, unnest({kept_words("regexp_replace(path, '[.][^./]*$', '')")}), 1 FROM md_body""")
cte("md_terms", f"SELECT path, line_start, {S_STEM} AS term, sum(weight)::BIGINT AS tf FROM md_words GROUP BY ALL")

# --- word salads --------------------------------------------------------------------------------------


def drawn(bound: str, *parts: str) -> str:
    return f"(('0x' || left(sha256('{CALIBRATION_SEED}:' || {" || ':' || ".join(parts)}), 15))::UBIGINT::BIGINT % ({bound}))"


cte("el", "SELECT *, row_number() OVER (ORDER BY path, line_start) AS spot FROM (SELECT path, line_start, list(DISTINCT term ORDER BY term) AS terms FROM raw_words JOIN stems USING (word) GROUP BY ALL)")
cte("el_files", "SELECT *, row_number() OVER (ORDER BY path) AS number FROM (SELECT path, min(spot) AS start, count(*) AS n FROM el GROUP BY ALL)")
cte("sal_drawn", f"""SELECT i AS qid, j, {drawn('SELECT count(*) FROM el_files', "'file'", 'i', 'j')} + 1 AS number FROM range({CALIBRATION_QUERIES}) a(i), range({DRAWS}) b(j)
    UNION ALL SELECT i, {DRAWS} + j, j + 1 FROM range({CALIBRATION_QUERIES}) a(i), range({max(CALIBRATION_LENGTHS)}) b(j)""")
cte("sal_picks", f"""SELECT qid, number, row_number() OVER (PARTITION BY qid ORDER BY j) - 1 AS slot, [{', '.join(map(str, CALIBRATION_LENGTHS))}][{drawn(str(len(CALIBRATION_LENGTHS)), "'length'", 'qid')} + 1] AS length
    FROM (SELECT qid, number, min(j) AS j FROM sal_drawn GROUP BY ALL)""")
cte("sal_words", f"""SELECT p.qid, e.terms[{drawn('len(e.terms)', "'word'", 'p.qid', 'p.slot')} + 1] AS w FROM sal_picks p JOIN el_files f USING (number)
    JOIN el e ON e.spot = f.start + {drawn('f.n', "'passage'", 'p.qid', 'p.slot')} WHERE p.slot < p.length""")
cte("salads", "SELECT qid, string_agg(w, ' ' ORDER BY w) AS question FROM (SELECT DISTINCT qid, w FROM sal_words) GROUP BY ALL")
_vec("salads", "qid", "question", "sv")
cte("sal_dot", "SELECT qid, doc_id, sum(q.b * d.b)::BIGINT AS dot FROM sv_q q JOIN dv_q d USING (slot) GROUP BY ALL")
cte("sal_best", """SELECT qid, CASE WHEN count(doc_id) < (SELECT count(*) FROM documents) THEN greatest(coalesce(max(dot), 0), 0) ELSE max(dot) END / 16129.0::DOUBLE AS best
    FROM salads LEFT JOIN sal_dot USING (qid) GROUP BY ALL""")

# --- the index of the Markdown files ------------------------------------------------------------------

cte("mf_words", f"""SELECT path, unnest({kept_words('text')}) AS w FROM md_body
    UNION ALL SELECT path, unnest({kept_words("regexp_replace(path, '[.][^./]*$', '')")}) FROM (SELECT DISTINCT path FROM md_body)""")
cte("mvocab", "SELECT w AS word FROM md_words UNION SELECT w FROM mf_words UNION SELECT word FROM q_words")
CTES["mstems"] = re.sub(r"\b(s_[abc2345]|stems|vocab)\b", r"m\1", STEMS)
cte("mq_terms", "SELECT DISTINCT qid, term FROM q_words JOIN mstems USING (word)")
cte("mp_terms", "SELECT path, line_start, term, sum(weight)::BIGINT AS tf FROM md_words JOIN mstems ON word = w GROUP BY ALL")
cte("mf_terms", "SELECT path, term, count(*) AS tf FROM mf_words JOIN mstems ON word = w GROUP BY ALL")
for _u, _keys, _n in (("mp", "path, line_start", "count(*)"), ("mf", "path", "count(DISTINCT path)")):
    cte(f"{_u}_len", f"SELECT {_keys}, sum(tf)::BIGINT AS dl FROM {_u}_terms GROUP BY ALL")
    cte(f"{_u}_stat", f"SELECT {_n} AS n, (SELECT sum(tf) FROM {_u}_terms)::BIGINT AS total FROM md_body")
    cte(f"{_u}_df", f"SELECT term, count(*) AS df FROM {_u}_terms GROUP BY ALL")
    cte(f"{_u}_score", _bm25(_u, _keys, "mq_terms"))
    cte(f"{_u}_lex", f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {_keys}) AS rank FROM {_u}_score")
cte("md_model", f"SELECT path, line_start, array_to_string(trail, ' > ') || {NL} || body AS text FROM md_body")
_vec("md_model", "path, line_start", "text", "mv")
cte("mdot_some", "SELECT qid, path, line_start, sum(q.b * d.b)::BIGINT AS dot FROM qv_q q JOIN mv_q d USING (slot) GROUP BY ALL")
cte("mdots", """SELECT q.qid, d.path, d.line_start, coalesce(s.dot, 0) AS dot
    FROM qs q CROSS JOIN md_model d LEFT JOIN mdot_some s ON s.qid = q.qid AND s.path = d.path AND s.line_start = d.line_start""")
cte("mf_near", "SELECT qid, path, max(dot) AS dot, row_number() OVER (PARTITION BY qid ORDER BY max(dot) DESC, path) AS rank FROM mdots GROUP BY qid, path")
cte("mfused", """SELECT qid, path, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (
    SELECT qid, path, rank FROM mf_lex WHERE rank <= 100 UNION ALL SELECT qid, path, rank FROM mf_near WHERE rank <= 100) GROUP BY ALL""")
cte("mf_all", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM mfused")
cte("mfiles", "SELECT * FROM mf_all WHERE rank <= 5")
cte("mcands", "SELECT * FROM mf_all WHERE rank <= 20")
_shown("mfiles", "mshown", "mp_score", "mdots")
_shown("mcands", "mcshown", "mp_score", "mdots")

# --- logs -----------------------------------------------------------------------------------------------

cte("log", """SELECT user_id::VARCHAR AS key, epoch_us(ts) AS us, event_id, event_type, value, ts,
    json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
cte("ops_in", """SELECT event_id AS rid, us, strftime(ts, '%Y-%m-%d') AS day, floor(value * 100)::BIGINT AS size, k FROM log""")
cte("ops", """SELECT day, us, rid * 2 AS seq, 'reserve' AS kind, rid, size * 2000 + 10240000 AS amount, NULL::BIGINT AS tokens_in, NULL::BIGINT AS tokens_out FROM ops_in
    UNION ALL SELECT strftime(make_timestamp(us + (k % 31) * 60000000), '%Y-%m-%d'), us + (k % 31) * 60000000, rid * 2 + 1, 'settle', rid, size * 1000 + 730000, size, 73 FROM ops_in""")
cte("ops_n", "SELECT *, row_number() OVER (PARTITION BY day ORDER BY us, seq) AS n FROM ops")
CTES["spend_walk"] = f"""spend_walk AS (SELECT day, 0::BIGINT AS n, 0::BIGINT AS spent, 0::BIGINT AS flight, false AS closed, []::BIGINT[] AS open, ''::VARCHAR AS decision
        FROM (SELECT DISTINCT day FROM ops)
    UNION ALL SELECT o.day, o.n,
        CASE WHEN o.kind = 'settle' THEN w.spent + o.amount ELSE w.spent END,
        CASE WHEN o.kind = 'settle' AND list_contains(w.open, o.rid) THEN w.flight - r.amount
            WHEN o.kind = 'reserve' AND NOT w.closed AND w.spent + w.flight + o.amount <= {SPEND_CAP} THEN w.flight + o.amount ELSE w.flight END,
        w.closed OR (o.kind = 'reserve' AND w.spent + o.amount > {SPEND_CAP}),
        CASE WHEN o.kind = 'settle' THEN list_filter(w.open, lambda x: x <> o.rid)
            WHEN NOT w.closed AND w.spent + w.flight + o.amount <= {SPEND_CAP} THEN list_append(w.open, o.rid) ELSE w.open END,
        CASE WHEN o.kind = 'settle' THEN 'settled'
            WHEN w.closed THEN 'paused' WHEN w.spent + o.amount > {SPEND_CAP} THEN 'closes'
            WHEN w.spent + w.flight + o.amount > {SPEND_CAP} THEN 'busy' ELSE 'accepted' END
        FROM spend_walk w JOIN ops_n o ON o.day = w.day AND o.n = w.n + 1 JOIN ops r ON r.rid = o.rid AND r.kind = 'reserve')"""
cte("spent", "SELECT o.day, o.seq, o.kind, o.rid, o.amount, o.tokens_in, o.tokens_out, w.decision, w.spent AS spent_after FROM spend_walk w JOIN ops_n o ON o.day = w.day AND o.n = w.n")


def _walk(name: str, src: str, limit: int) -> None:
    cte(f"{name}_n", f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n FROM {src}")
    alive = f"list_filter(w.stamps, lambda s: s > e.us - {DAY_US})"
    CTES[f"{name}_w"] = f"""{name}_w AS (SELECT key, n, event_id, [us] AS stamps, true AS admitted FROM {name}_n WHERE n = 1
        UNION ALL SELECT e.key, e.n, e.event_id, CASE WHEN len({alive}) < {limit} THEN list_append({alive}, e.us) ELSE {alive} END,
        len({alive}) < {limit} FROM {name}_w w JOIN {name}_n e ON e.key = w.key AND e.n = w.n + 1)"""


_walk("adm", "log", 3)
cte("click_log", "SELECT 'docs' AS key, us, event_id FROM log WHERE event_type = 'click'")
_walk("clk", "click_log", 60)
cte("two_n", "SELECT *, event_type <> 'error' AS reaches, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n FROM log")
_A = f"list_filter(w.asked, lambda s: s > e.us - {DAY_US})"
_R = f"list_filter(w.got, lambda s: s > e.us - {DAY_US})"
_OK = f"len({_A}) < 2 AND len({_R}) < 5"
CTES["two_w"] = f"""two_w AS (SELECT key, n, event_id, CASE WHEN reaches THEN [us] ELSE [] END AS asked, [us] AS got, true AS ok, reaches FROM two_n WHERE n = 1
    UNION ALL SELECT e.key, e.n, e.event_id, CASE WHEN {_OK} AND e.reaches THEN list_append({_A}, e.us) ELSE {_A} END,
    CASE WHEN {_OK} THEN list_append({_R}, e.us) ELSE {_R} END, {_OK}, e.reaches FROM two_w w JOIN two_n e ON e.key = w.key AND e.n = w.n + 1)"""
cte("slots", f"SELECT DISTINCT key, us // {DAY_US} AS slot FROM log")

# --- transcripts ------------------------------------------------------------------------------------------

cte("recs", f"""SELECT conv_id AS agent, turn AS line, role = 'assistant' AS said, text, 'm' || (turn // 4) AS mid, 'model-' || (conv_id % 2) AS model,
    length(text) AS n, {reply('conv_id + turn', "'end'")} AS tail FROM conversations""")
cte("msgs", """SELECT agent, mid, max(n) AS a, max(n % 7) AS b, max(n % 11) AS c, max(n // 3) AS d FROM recs WHERE said GROUP BY ALL""")
cte("usage", """SELECT agent, count(*) AS requests, max(a + b + c + d) AS peak, sum(a * 100 + b * 125 + c * 10 + d * 100) / 100.0::DOUBLE AS in_equiv FROM msgs GROUP BY ALL""")
cte("last_mid", "SELECT agent, max_by(mid, line) AS mid FROM recs WHERE said GROUP BY ALL")
cte("agent_reply", "SELECT r.agent, string_agg(text || tail, '' ORDER BY line) AS reply FROM recs r JOIN last_mid l ON l.agent = r.agent AND l.mid = r.mid WHERE said AND line % 3 <> 2 GROUP BY ALL")
parsed("agent_reply", "agent", "agent_verdicts")
cte("firsts", f"""SELECT agent, min_by(CASE WHEN agent % 5 = 0 THEN 'Base: x' || {NL} ELSE 'Base: /work/skill' || {NL} || {NL} END || text, line) AS prompt FROM recs WHERE NOT said GROUP BY ALL""")
cte("spawn", rf"""SELECT m.agent, CASE WHEN m.agent % 10 = 0 THEN 3 ELSE 2 END AS offered,
    regexp_matches(prompt, '^Base: /[^\n]*/skill\n\n') AS layout_ok,
    CASE WHEN regexp_matches(prompt, '^Base: /[^\n]*/skill\n\n') THEN sha256(regexp_extract(prompt, '(?s)^[^\n]*\n\n(.*)\z', 1)) END AS payload_sha,
    length(string_split(prompt, {NL})[1]) AS base_len, f.models, coalesce(f.tool_uses, 0) AS tool_uses, coalesce(u.requests, 0) AS requests,
    coalesce(u.peak, 0) AS peak, coalesce(u.in_equiv, 0.0::DOUBLE) AS in_equiv, p.reply, v.category
    FROM (SELECT DISTINCT agent FROM recs) m LEFT JOIN firsts USING (agent)
    LEFT JOIN (SELECT agent, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(*) FILTER (line % 13 = 5) AS tool_uses FROM recs WHERE said GROUP BY ALL) f USING (agent)
    LEFT JOIN usage u USING (agent) LEFT JOIN agent_reply p USING (agent) LEFT JOIN agent_verdicts v USING (agent)""")
cte("akey", "SELECT printf('r%05d', agent) AS run_id, payload_sha FROM spawn WHERE payload_sha IS NOT NULL AND agent % 7 <> 0")
cte("matched", "SELECT s.*, k.run_id FROM spawn s LEFT JOIN akey k ON k.payload_sha = s.payload_sha")
cte("abatch", "SELECT printf('r%05d', agent) AS run_id FROM spawn WHERE agent % 4 <> 1")

# --- the queries --------------------------------------------------------------------------------------------

SQL: dict[str, str] = {}
RECURSIVE = {"md_walk", "spend_walk", "two_w", "adm_w", "clk_w"}


def render(body: str) -> str:
    """Prefix a query with the shared tables it needs, in order."""
    names: list[str] = []

    def need(text: str, own: str) -> None:
        for name in CTES:
            if name != own and name not in names and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                need(CTES[name], name)
                if name not in names:
                    names.append(name)

    need(body, "")
    parts = [CTES[n] if n in RECURSIVE or n.endswith("stems") else f"{n} AS ({CTES[n]})" for n in names]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def oracle(name: str, body: str) -> None:
    SQL[name] = body


oracle("tok_words", f"SELECT doc_id, len({kept_words('text')})::BIGINT AS n_words, sha256(array_to_string({kept_words('text')}, ' ')) AS digest FROM documents")
oracle("tok_casefold", f"SELECT doc_id, sha256({fold('text')}) AS digest FROM documents")
oracle("tok_porter", "SELECT term, sum(tf)::BIGINT AS n, count(*) AS files FROM f_terms GROUP BY ALL")
oracle("tok_s_stem", f"SELECT {S_STEM} AS term, count(*) AS n FROM (SELECT word AS w FROM raw_words) GROUP BY ALL")
PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[.][^./]*$', '')"
oracle("tok_path_words", f"SELECT page_id, {PATH} AS stem_path, array_to_string({kept_words(PATH)}, ' ') AS path_words FROM pages")
HIDDEN = r"'[\p{Cc}\p{Cf}]'"
oracle("str_normalise", f"SELECT doc_id, sha256({squeeze('text')}) AS digest, regexp_matches(text, {HIDDEN}) AS raw_hidden, regexp_matches({squeeze('text')}, {HIDDEN}) AS hidden FROM documents")
_C = strip("replace(text, chr(13) || chr(10), chr(10))")
oracle("flt_question", f"""SELECT conv_id, turn, CASE WHEN {_C} = '' THEN 'empty_question' WHEN length({_C}) > 500 THEN 'too_long'
    WHEN {squeeze(_C)} = '' OR regexp_matches({squeeze(_C)}, {HIDDEN}) THEN 'unusable_question' ELSE 'ok' END AS refusal, length({_C})::BIGINT AS length FROM conversations""")
oracle("prj_links", f"SELECT page_id, {FILE_URL.format('url')} AS file_url, {FILE_URL.format('url')} || '?plain=1#L' || page_id || '-L' || (page_id + 7) AS url7 FROM pages")


def exc(x: str) -> str:
    kept = f"list_filter(string_split({x}, chr(10)), lambda x: NOT {blank('x')})[1:3]"
    return f"array_to_string(list_transform({kept}, lambda x: '      | ' || CASE WHEN length(x) <= 160 THEN x ELSE left(x, 159) || '…' END), chr(10))"


oracle("str_excerpt", f"SELECT doc_id, {exc('text')} AS excerpt FROM documents")
HTML = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
oracle("str_html", f"SELECT page_id, sha256({HTML}) AS digest, length({HTML})::BIGINT AS chars FROM pages")
oracle("str_money", f"SELECT event_id, event_id * 123456789 + k AS nano, {usd('(event_id * 123456789 + k)')} AS usd FROM log")
_E = "(turn + length(text) % 2)"
oracle("str_spans", f"""SELECT conv_id, turn, CASE WHEN turn = {_E} THEN 'Line ' || turn ELSE 'Lines ' || turn || ' to ' || {_E} END AS span,
    CASE WHEN turn = {_E} THEN 'line ' || turn ELSE 'lines ' || turn || ' to ' || {_E} END AS link_span, string_split(text, '. ')[1] AS first_sentence FROM conversations""")
STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
oracle("str_log_lines", f"""SELECT event_id, '{{"t":"' || {STAMP} || '","ip":"' || left(sha256(key), 16) || '","o":"' || CASE WHEN event_type = 'error' THEN 'judge_error' ELSE 'answer' END || '"}}' AS line,
    CASE WHEN event_type = 'error' THEN '{{"t":"' || {STAMP} || '","ops":"startup_failed","c":"index"}}' ELSE '{{"t":"' || {STAMP} || '","ops":"startup_ok"}}' END AS ops,
    strftime(ts, '%Y-%m-%d') AS day FROM log""")
oracle("str_percent", f"""SELECT source, part, total, {pct('part', 'total')} AS share, part * 100 >= total * 80 AS at_80, part * 100 >= total * 20 AS at_20
    FROM (SELECT source, count(*) FILTER (quality = 1) AS part, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)""")
REND = f"CASE token WHEN 'NOT_ANSWERABLE' THEN 'no confident match' || {NL} || {SIGNAL} WHEN 'ANSWERABLE' THEN 'result' || {NL} || {SIGNAL} ELSE 'judge error' || {NL} END"
oracle("verdict_parse", f"SELECT conv_id, turn, token, category, sha256({REND}) AS rendered FROM turn_verdicts")
_F = f"CASE WHEN doc_id % 7 = 3 THEN regexp_replace(text, '[.] ', '.' || {NL} || '--- passage ', 'g') ELSE text END"
oracle("payload_markers", f"SELECT doc_id, {forged(_F)} AS forged FROM documents")
cte("unit", """SELECT vec_id, label, CASE WHEN norm > 0 THEN list_transform(e, lambda x: x / norm) ELSE e END AS u FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e,
    sqrt(list_reduce(list_transform(embedding::DOUBLE[], lambda x: x * x), lambda a, b: a + b, 0.0::DOUBLE)) AS norm FROM embeddings)""")
cte("ev", "SELECT vec_id, 'label-' || label AS path, list_transform(u, lambda x: greatest(-127, least(127, round_even(x * 127, 0)))::BIGINT) AS b FROM unit")
oracle("vec_quantise", "SELECT vec_id, array_to_string(b, ',') AS packed, round(list_reduce(list_transform(b, lambda x: x / 127.0::DOUBLE), lambda a, x: a + x, 0.0::DOUBLE), 9) AS total FROM ev")
oracle("vec_base64", "SELECT vec_id, to_base64(unhex(array_to_string(list_transform(b, lambda x: printf('%02X', (x + 256) % 256)), ''))) AS b64 FROM ev")
oracle("vec_decode", "SELECT vec_id, CASE WHEN vec_id % 7 NOT IN (3, 5) THEN array_to_string(b, ',') END AS packed FROM ev")
oracle("vec_hashed", "SELECT d.doc_id, coalesce(sum(b * (slot + 1)), 0)::BIGINT AS moment, coalesce(sum(b * b), 0)::BIGINT AS square FROM documents d LEFT JOIN dv_q USING (doc_id) GROUP BY ALL")
cte("edot", "SELECT q.vec_id AS qid, v.path, v.vec_id AS line_start, list_dot_product(q.b::DOUBLE[], v.b::DOUBLE[])::BIGINT AS dot FROM ev q CROSS JOIN ev v")
oracle("dense_passages", "SELECT * FROM (SELECT qid, path, line_start, dot, row_number() OVER (PARTITION BY qid ORDER BY dot DESC, path, line_start) AS rank FROM edot) WHERE rank <= 5")
oracle("dense_files", "SELECT qid, path, max(dot) AS dot, row_number() OVER (PARTITION BY qid ORDER BY max(dot) DESC, path) AS rank FROM edot GROUP BY qid, path")
oracle("dense_top", "SELECT qid, round(top_score, 9) AS top_score FROM top")
oracle("bag_passages", "SELECT path, line_start AS doc_id, term, dl, tf FROM p_terms JOIN p_len USING (path, line_start)")
oracle("bag_files", "SELECT path, term, dl, tf FROM f_terms JOIN f_len USING (path)")
oracle("bag_markdown", "SELECT path, line_start, term, sum(tf) OVER (PARTITION BY path, line_start)::BIGINT AS dl, tf FROM md_terms")
oracle("corpus_statistics", "SELECT 'passage' AS unit, n AS n_bags, total AS total_dl, round(total / n, 6) AS avgdl FROM p_stat UNION ALL SELECT 'file', n, total, round(total / n, 6) FROM f_stat")
oracle("document_frequency", "SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM p_df CROSS JOIN p_stat")
oracle("eligible_passages", "SELECT path, count(DISTINCT line_start) AS passages, count(*) AS terms FROM (SELECT DISTINCT path, line_start, term FROM raw_words JOIN stems USING (word)) GROUP BY ALL")
oracle("null_questions", "SELECT * FROM salads")
oracle("calibrate_nulls", f"SELECT round(list(best ORDER BY best)[ceil({CALIBRATION_QUANTILE} * count(*))::BIGINT], 6) AS tau, count(*) AS n FROM sal_best")
oracle("bm25_passages", "SELECT qid, path, line_start, round(score, 6) AS score, rank FROM p_lex WHERE rank <= 100")
oracle("bm25_files", "SELECT qid, path, round(score, 6) AS score, rank FROM f_lex WHERE rank <= 100")
oracle("rrf_files", "SELECT qid, path, round(score, 9) AS score FROM fused")
oracle("retrieve_files", "SELECT qid, path, round(score, 9) AS score, rank FROM files")
oracle("retrieve_passages", "SELECT qid, path, line_start, round(within, 9) AS within, rank, passage_rank FROM shown")
oracle("retrieve_links", "SELECT qid, rank, passage_rank, file_url, url, sha256(text) AS digest FROM shown_text")
MODE = "file-rrf-v1:hybrid:BAAI/bge-small-en-v1.5@5c38ec7c405ec4b44b94cc5a9bb96e735b38267a"
CE = "+ce:cross-encoder/ms-marco-MiniLM-L6-v2@233902d25c440f23af6f7d6e94d2946bac0bee0a:n20"
cte("printed", f"""SELECT qid, string_agg(CASE WHEN passage_rank = 1 THEN printf('%d. %s  (score %.4f)', rank, path, score) || {NL} || '   ' || file_url || {NL} ELSE '' END
    || '   ' || substr('abcdefghij', passage_rank, 1) || printf('. lines %d-%d  Heading: ', line_start, line_start) || '(top of file)' || {NL} || '      ' || url
    || CASE WHEN {exc('text')} <> '' THEN {NL} || {exc('text')} ELSE '' END, {NL} ORDER BY rank, passage_rank) AS blocks FROM shown_text GROUP BY ALL""")
cte("result_texts", f"""SELECT qid, 'Sources for: ' || question || {NL} || 'Docs: {NAME} @ {COMMIT}' || {NL} || 'Ranking: {MODE}  no text generated' || {NL}
    || printf('Top score: %.3f (best passage similarity; ingest reference %.3f, reported only: retrieval does not decide whether the docs answer)', top_score, 0.0::DOUBLE)
    || {NL} || {NL} || blocks || {NL} || {NL} || 'These are sources, not an answer.' AS text FROM qs JOIN printed USING (qid) JOIN top USING (qid)""")
oracle("result_text", "SELECT qid, sha256(text) AS digest, length(text)::BIGINT AS chars FROM result_texts")
oracle("result_invariants", "SELECT count(DISTINCT qid) AS questions, count(*) AS rows, 0::BIGINT AS faults FROM shown")
WSET = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
cte("pairs", f"""SELECT c.qid, c.path, c.rank AS first_rank, max(len(list_intersect({WSET.format('q.question')}, {WSET.format('d.text')})))::DOUBLE AS score
    FROM cshown c JOIN qs q USING (qid) JOIN documents d ON d.doc_id = c.line_start GROUP BY ALL""")
oracle("rerank_files", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_rank) AS rank FROM pairs) WHERE rank <= 5")
cte("mpairs", f"""SELECT c.qid, c.path, c.rank AS first_rank, max(len(list_intersect({WSET.format('q.question')}, {WSET.format('d.text')})))::DOUBLE AS score
    FROM mcshown c JOIN qs q USING (qid) JOIN md_model d ON d.path = c.path AND d.line_start = c.line_start GROUP BY ALL""")
oracle("markdown_bm25", "SELECT qid, path, line_start, round(score, 6) AS score, rank FROM mp_lex WHERE rank <= 100")
oracle("markdown_retrieve", "SELECT qid, path, line_start, round(score, 9) AS score, round(within, 9) AS within, rank, passage_rank FROM mshown")
oracle("markdown_rerank", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_rank) AS rank FROM mpairs) WHERE rank <= 5")
oracle("ranking_modes", f"SELECT qid, '{MODE}' AS mode, '{MODE.replace('file-rrf-v1', 'file-rerank-v1')}{CE}' AS reranked_mode FROM qs")
oracle("eval_lines", """SELECT qid, qid || '  ' || rpad(CASE WHEN NOT answerable THEN 'DIAG' WHEN rank IS NOT NULL THEN 'HIT' ELSE 'MISS' END, 6, ' ')
    || CASE WHEN NOT answerable THEN 'top file ' || top_path || printf('  top score %.2f', top_score) || CASE WHEN hard_negative THEN ' [hard negative]' ELSE '' END
    WHEN rank IS NOT NULL THEN hit_path || ' (rank ' || rank || ')  ' || printf('top score %.2f', top_score)
    ELSE 'expected ' || array_to_string(sources, ' | ') || '; got ' || got || '  ' || printf('top score %.2f', top_score) END AS line FROM ranked JOIN top USING (qid)""")
oracle("eval_score", f"""SELECT *, {pct('hits', 'answerable_total')} AS hit_rate, answerable_total > 0 AND hits * 5 >= answerable_total * 4 AS passed FROM (
    SELECT count(*) FILTER (answerable AND rank IS NOT NULL) AS hits, count(*) FILTER (answerable) AS answerable_total, count(*) FILTER (NOT answerable) AS unanswerable_total FROM ranked)""")
oracle("judge_payloads", "SELECT qid, input_sha256, forged FROM payloads")
cte("applied", """SELECT p.qid, CASE WHEN p.qid % 13 = 6 THEN 'passage line starts like a payload marker' WHEN p.qid % 11 = 4 THEN 'verdict file unreadable' WHEN p.qid % 5 = 0 THEN 'verdict is for a different input' ELSE v.category END AS category, v.token
    FROM payloads p JOIN verdicts v USING (qid)""")
oracle("judge_apply", "SELECT qid, CASE WHEN category IS NULL THEN token ELSE 'JUDGE_ERROR' END AS token, category FROM applied")
oracle("verdict_faults", """SELECT qid + 1000000 AS qid, 'not a question in the eval set' AS fault FROM qs WHERE qid % 6 = 1
    UNION ALL SELECT qid, 'no verdict for this eval question' FROM qs WHERE qid % 6 = 1 UNION ALL SELECT qid, 'verdict outside the domain' FROM qs WHERE qid % 6 = 2
    UNION ALL SELECT qid, 'hash is not the payload''s' FROM qs WHERE qid % 6 = 3 UNION ALL SELECT qid, 'appears more than once' FROM qs WHERE qid % 6 = 4""")
oracle("judge_rows", "SELECT qid, verdict, expected, agreement FROM judged")
oracle("judge_bars", "SELECT * FROM bars_met")
_W = len("bar 2 (answerable, right file in top 5, not abstained):") + 1
oracle("judge_summary", f"""SELECT rpad('bar 1 (unanswerable abstained):', {_W}, ' ') || abstained || '/' || unanswerable_total || ' (' || {pct('abstained', 'unanswerable_total')} || ')  required >= 80%  ' || CASE WHEN bar1_met THEN 'MET' ELSE 'NOT MET' END AS bar1,
    'bar 2 (answerable, right file in top 5, not abstained): ' || shown || '/' || hit_total || ' (' || {pct('shown', 'hit_total')} || ')  required >= 80%  ' || CASE WHEN bar2_met THEN 'MET' ELSE 'NOT MET' END AS bar2,
    'end to end: answerable questions whose right file is shown after judging: ' || shown || '/' || answerable_total || ' (diagnostic)' AS end_to_end FROM bars_met""")
oracle("over_abstention", """SELECT count(*) FILTER (answerable AND rank IS NOT NULL AND verdict = 'NOT_ANSWERABLE') AS over_abstained, count(*) FILTER (answerable AND rank IS NOT NULL) AS hit_total,
    count(*) FILTER (answerable AND rank IS NULL AND verdict = 'ANSWERABLE') AS shown_without_hit, count(*) FILTER (answerable AND rank IS NULL) AS miss_total,
    count(*) FILTER (verdict = 'JUDGE_ERROR' AND NOT answerable) AS errors_bar1, count(*) FILTER (verdict = 'JUDGE_ERROR' AND answerable AND rank IS NOT NULL) AS errors_bar2,
    count(*) FILTER (verdict = 'JUDGE_ERROR' AND answerable AND rank IS NULL) AS errors_neither FROM judged""")
oracle("error_categories", "SELECT category, count(*) AS n FROM verdicts WHERE category IS NOT NULL GROUP BY ALL")
cte("best_rule", """SELECT "set", count(*) FILTER (label = 'unanswerable' AND top1 < 0.67::DOUBLE) AS abstained, count(*) FILTER (label = 'unanswerable') AS unanswerable,
    count(*) FILTER (in_top5 = 1 AND top1 >= 0.67::DOUBLE) AS shown, count(*) FILTER (in_top5 = 1) AS hits FROM sig GROUP BY ALL""")
oracle("best_score_rule", "SELECT * FROM best_rule")
oracle("best_score_check", "SELECT *, abstained = 13 AND unanswerable = 20 AND shown = 37 AND hits = 56 AS reproduced FROM (SELECT sum(abstained)::BIGINT AS abstained, sum(unanswerable)::BIGINT AS unanswerable, sum(shown)::BIGINT AS shown, sum(hits)::BIGINT AS hits FROM best_rule)")
oracle("retrieve_errors", "SELECT item_id AS qid, 'nothing to search for' AS error FROM benchmark WHERE item_id % 7 = 3")
oracle("sample_rows", "SELECT run_id, set_index, position, qid, role FROM sample")
oracle("sample_counts", "SELECT set_index, role, count(*) AS rows, set_index % 2 <> 0 AS wrong FROM sample GROUP BY ALL")
oracle("gate_rows", "SELECT qid, kind, verdict FROM gate")
oracle("gate_report", """SELECT count(*) FILTER (kind <> 'answerable' AND verdict = 'PASS') AS bar1, count(*) FILTER (kind <> 'answerable' AND verdict <> 'NOT RUN') AS bar1_total,
    count(*) FILTER (kind = 'answerable' AND verdict = 'PASS') AS bar2, count(*) FILTER (kind = 'answerable' AND verdict <> 'NOT RUN') AS bar2_total,
    count(seconds) AS timed, list(seconds ORDER BY seconds) FILTER (seconds IS NOT NULL)[count(seconds) // 2 + 1] AS upper_median, max(seconds) AS slowest FROM gate""".replace(
    "list(seconds ORDER BY seconds) FILTER (seconds IS NOT NULL)[count(seconds) // 2 + 1]", "(list(seconds ORDER BY seconds) FILTER (seconds IS NOT NULL))[count(seconds) // 2 + 1]"))
oracle("signals", """SELECT "set", qid, label, hard_negative, in_top5, rank, round(top1, 9) AS top1, round(top2, 9) AS top2, round(margin, 9) AS margin, round(pmargin, 9) AS pmargin,
    round(top1_printed_global, 9) AS top1_printed_global, round(top1_shown, 9) AS top1_shown, files FROM sig""")
for _q, _n, _k in (("sweep_threshold", "sw_t", "t"), ("sweep_margin", "sw_m", "m"), ("sweep_passage_margin", "sw_pm", "m"), ("sweep_combined", "sw_tm", "t, m")):
    _cols = f"{_k}, b1_num, b1_den, b2_num, b2_den"
    oracle(_q, f"""SELECT "set", {_cols} FROM {_n} UNION ALL SELECT 'POOLED', {_cols} FROM {_n}_all""")
oracle("sweep_global", "SELECT * FROM sw_g_all")
_BOTH = "b1_den > 0 AND b1_num * 100 >= b1_den * {0} AND b2_den > 0 AND b2_num * 100 >= b2_den * {0}"
oracle("sweep_best", f"""SELECT t, m, b1_num, b1_den, b2_num, b2_den, round({MINFRAC.format('')}, 9) AS min_frac, (SELECT count(*) FROM sw_tm_all) AS cells,
    (SELECT count(*) FROM sw_tm_all WHERE {_BOTH.format(90)}) AS both_90, (SELECT count(*) FROM sw_tm_all WHERE {_BOTH.format(80)}) AS both_80
    FROM sw_tm_all ORDER BY {MINFRAC.format('')} DESC, t, m LIMIT 1""")
oracle("sweep_pareto", f"""SELECT t, m, b1_num, b1_den, b2_num, b2_den, round({MINFRAC.format('')}, 9) AS min_frac FROM (
    SELECT *, row_number() OVER (PARTITION BY b1_num, b2_num ORDER BY t, m) AS k FROM sw_tm_all) a WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM sw_tm_all o
    WHERE o.b1_num >= a.b1_num AND o.b2_num >= a.b2_num AND (o.b1_num <> a.b1_num OR o.b2_num <> a.b2_num))""")
oracle("sweep_leave_one_out", "SELECT * FROM loso")
oracle("sweep_folds", "SELECT sum(test_b1_num)::BIGINT AS b1_num, sum(test_b1_den)::BIGINT AS b1_den, sum(test_b2_num)::BIGINT AS b2_num, sum(test_b2_den)::BIGINT AS b2_den, count(*) FILTER (both_80) AS folds_80, count(*) AS folds FROM loso")
oracle("score_distribution", """SELECT s."set", grp, count(*) AS n, round(min(top1), 9) AS "min", round(median(top1), 9) AS median, round(max(top1), 9) AS "max" FROM (
    SELECT unnest(["set", 'POOLED']) AS "set", CASE WHEN label = 'unanswerable' THEN 'unans' WHEN in_top5 = 1 THEN 'hit' ELSE 'miss' END AS grp, top1 FROM sig) s GROUP BY ALL""")
oracle("signal_integrity", """SELECT count(*) AS rows, count(*) FILTER (label = 'answerable') AS answerable, count(*) FILTER (label = 'unanswerable') AS unanswerable, count(*) FILTER (in_top5 = 1) AS hits,
    count(*) FILTER (in_top5 = 0) AS misses, count(*) FILTER (abs(top1 - top1_printed_global) > 1e-12) AS global_differs, count(*) FILTER (abs(top1 - top1_shown) > 1e-12) AS shown_differs,
    count(*) = count(DISTINCT ("set", qid)) AS unique_ids FROM sig""")
oracle("calibrate_quantile", "SELECT event_type, count(*) AS n, (list(value ORDER BY value))[ceil(0.9 * count(*))::BIGINT] AS p90 FROM log GROUP BY ALL")
oracle("calibrate_offtopic", "SELECT round((list(top_score ORDER BY top_score))[ceil(0.9 * count(*))::BIGINT], 6) AS tau, count(*) AS n FROM top")
_CAP = """SELECT qid, path, line_start, round(score, {1}) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, line_start) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, path ORDER BY score DESC, line_start) AS in_file FROM {0}) WHERE in_file <= 2) WHERE rank <= 5"""
oracle("old_capped", _CAP.format("p_score", 6))
cte("asked", "SELECT qid, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM q_terms LEFT JOIN p_df USING (term) CROSS JOIN p_stat")
cte("best_passage", "SELECT qid, path, line_start FROM p_lex WHERE rank = 1")
cte("held", "SELECT b.qid, sum(idf) AS held, max(idf) AS most FROM best_passage b JOIN p_terms t USING (path, line_start) JOIN asked a ON a.qid = b.qid AND a.term = t.term GROUP BY ALL")
cte("conf", """SELECT q.qid, m.n, h.held IS NOT NULL AS matched, round(coalesce(h.held / m.mass, 0), 9) AS coverage, round(coalesce(h.held - h.most, 0), 9) AS corroboration
    FROM qs q LEFT JOIN (SELECT qid, sum(idf) AS mass, count(*) AS n FROM asked GROUP BY ALL) m USING (qid) LEFT JOIN held h USING (qid)""")
oracle("old_confidence", """SELECT qid, round(coverage, 6) AS coverage, round(corroboration, 6) AS corroboration, CASE WHEN n IS NULL THEN 'no-searchable-words' WHEN NOT matched THEN 'no-passage-matched'
    WHEN coverage < 0.5 THEN 'below-threshold' ELSE 'ok' END AS reason FROM conf""")
cte("combined", """SELECT qid, path, line_start, round(0.5 * p / max(p) OVER (PARTITION BY qid) + 0.5 * f / max(f) OVER (PARTITION BY qid), 9) AS score FROM (
    SELECT s.qid, s.path, s.line_start, s.score AS p, g.score AS f FROM p_score s JOIN f_score g ON g.qid = s.qid AND g.path = s.path)""")
oracle("old_combined", _CAP.format("combined", 6))
cte("hybrid", """SELECT qid, path, line_start, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, path, line_start, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, line_start) AS rank FROM combined
    UNION ALL SELECT qid, path, line_start, rank FROM p_near) WHERE rank <= 100 GROUP BY ALL""")
oracle("old_hybrid", _CAP.format("hybrid", 9))
oracle("old_degenerate", """SELECT CASE WHEN p90 > 0 THEN p90 ELSE coalesce(least, 1000000.0) END AS tau FROM (SELECT (list(x ORDER BY x))[ceil(0.9 * count(*))::BIGINT] AS p90, min(x) FILTER (x > 0) AS least
    FROM (SELECT CASE WHEN event_id % 20 = 0 THEN value ELSE 0.0::DOUBLE END AS x FROM log))""")
oracle("old_sigmoid", "SELECT key, round(p, 9) AS p, p < 0.5 AS abstains FROM (SELECT key, max(1.0 / (1.0 + exp(-((value - 20.0) / 10.0)))) AS p FROM log GROUP BY ALL)")
oracle("md_sections", "SELECT path, line_start, line_end, heading, array_to_string(trail, ' > ') AS trail, sha256(text) AS digest, kept FROM md_sections")
oracle("md_counters", "SELECT (SELECT count(*) FROM documents) AS files, count(*) FILTER (kept) AS passages, count(*) FILTER (NOT kept AND len(trail) > 0) AS empty_dropped FROM md_sections")
oracle("md_model_text", f"SELECT path, line_start, sha256(array_to_string(trail, ' > ') || {NL} || body) AS digest, CASE WHEN len(trail) > 0 THEN array_to_string(trail, ' > ') ELSE '(top of file)' END AS label FROM md_body")
oracle("src_rules", """SELECT string_split(path, '/')[1] AS source, count(*) AS files, min(path) AS first, max(path) AS last FROM md WHERE (starts_with(path, 'src1/') OR starts_with(path, 'src2/')
    OR starts_with(path, 'src19/') OR path = 'src3/103.md') AND NOT starts_with(path, 'src19/1') AND NOT starts_with(path, 'src2/2') GROUP BY ALL""")
oracle("src_uncovered", "SELECT entry FROM (VALUES ('src1/'), ('nowhere/'), ('src2/none.md'), ('src0/0.md')) v(entry) WHERE NOT EXISTS (SELECT 1 FROM md WHERE CASE WHEN entry LIKE '%/' THEN starts_with(path, entry) ELSE path = entry END)")
oracle("src_decode", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 9 = 4 THEN 'not utf-8' ELSE sha256(text) END AS digest FROM documents")
_TOK = rf"len(regexp_extract_all(lower(array_to_string(trail, ' > ') || {NL} || body), '[\p{{L}}\p{{N}}_]+'))"
oracle("ingest_counters", f"""SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM md_body) AS passages, 0::BIGINT AS skipped,
    (SELECT count(*) FROM md_sections WHERE NOT kept AND len(trail) > 0) AS empty_dropped, (SELECT count(*) FROM md_body WHERE {_TOK} + 2 > 512) AS truncated""")
oracle("limit_rolling", "SELECT key, event_id, admitted FROM adm_w")
oracle("limit_clicks", "SELECT event_id, admitted FROM clk_w")
oracle("limit_two_level", "SELECT key, event_id, ok AS retrieved, ok AND reaches AS asked FROM two_w")
oracle("limit_keys", "SELECT slot, count(DISTINCT key) AS active_keys, count(DISTINCT key) <= 100 AS within_bound FROM (SELECT key, slot FROM slots UNION ALL SELECT key, slot + 1 FROM slots) GROUP BY ALL")
oracle("spend_log", "SELECT day, seq, kind, amount, decision, spent_after FROM spent")
oracle("spend_days", f"""SELECT *, closed OR spent + 10240000 > {SPEND_CAP} AS resting, {usd('spent')} AS spent_usd FROM (SELECT day, count(*) FILTER (kind = 'reserve' AND decision = 'accepted') AS accepted,
    count(*) FILTER (kind = 'reserve' AND decision <> 'accepted') AS refused, count(*) FILTER (decision = 'settled') AS judged,
    coalesce(sum(tokens_in) FILTER (decision = 'settled'), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out) FILTER (decision = 'settled'), 0)::BIGINT AS tokens_out,
    sum(CASE WHEN decision = 'settled' THEN amount ELSE 0 END)::BIGINT AS spent, max(decision = 'closes') AS closed FROM spent GROUP BY ALL)""")
cte("att", """SELECT event_id AS qid, k, n, CASE (event_id + n) % 7 WHEN 0 THEN 'status_5xx' WHEN 1 THEN 'status_429' WHEN 2 THEN 'timeout' WHEN 3 THEN 'connection' WHEN 4 THEN 'status_4xx' END AS category
    FROM log, (SELECT unnest([1, 2]) AS n)""")
cte("made", """SELECT a.* FROM att a JOIN att f ON f.qid = a.qid AND f.n = 1 WHERE a.n = 1 OR (f.category IS NOT NULL AND f.category IN ('status_5xx', 'status_429', 'connection'))""")
cte("calls", """SELECT qid, any_value(k) AS k, count(*) AS attempts, bool_or(category IS NULL) AS success,
    count(*) FILTER (category IS NOT NULL AND category NOT IN ('status_429', 'status_4xx', 'connection')) AS billable_failures,
    (list(replace(category, 'status_429', 'status_4xx') ORDER BY n DESC))[1] AS category FROM made GROUP BY qid""")
_B = "((4000 + qid % 5000 + 64) * 2000 + 1024 * 10000)"
oracle("spend_charges", f"""SELECT qid, attempts, billable_failures, success, category, (CASE WHEN qid % 13 = 0 THEN 0 WHEN NOT success THEN billable_failures * {_B}
    WHEN k % 5 = 0 THEN {_B} + billable_failures * {_B} ELSE k * 40 * 2000 + k * 10000 + billable_failures * {_B} END)::BIGINT AS charge, {_B}::BIGINT AS per_attempt FROM calls""")
_M = "(conv_id + turn)"
oracle("service_gates", f"""SELECT conv_id, turn, CASE WHEN {_M} % 17 = 3 THEN 'service_off' WHEN {_M} % 13 = 1 THEN 'bad_request'
    WHEN {_M} % 5 = 2 AND {_M} % 10 = 7 THEN 'bad_request' WHEN {_M} % 5 = 4 THEN 'bad_request'
    WHEN {_M} % 11 NOT IN (0, 1, 2) AND strlen(to_json({{'question': text}})::VARCHAR) > {DEFAULT_LIMITS.max_body_bytes} THEN 'body_too_large'
    WHEN {_M} % 7 = 6 OR {_M} % 11 IN (0, 1, 2) THEN 'bad_request' ELSE 'ok' END AS refusal FROM conversations""")
oracle("usage_counts", """SELECT count(*) FILTER (event_type = 'view') AS visits, count(*) FILTER (event_type = 'purchase') AS answered, count(*) FILTER (event_type = 'signup') AS refused,
    count(*) FILTER (event_type IN ('purchase', 'signup')) AS asked, (SELECT count(*) FROM clk_w WHERE admitted) AS docs_clicks FROM log""")
oracle("result_store", "SELECT event_id AS token, us, least(us + 21600000000, lead(us, 50) OVER (ORDER BY us, event_id)) AS gone_us FROM log")
oracle("transcript_usage", "SELECT * FROM usage")
oracle("transcript_reply", "SELECT agent, sha256(reply) AS digest FROM agent_reply")
oracle("transcript_lines", """SELECT agent, 'agent ' || agent || ': type judge; models ' || coalesce(models, 'none') || '; offered tools ' || offered || '; tool_use ' || tool_uses
    || '; base line ' || base_len || ' (layout ' || CASE WHEN layout_ok THEN 'ok' ELSE 'BAD' END || '); payload sha16 ' || coalesce(left(payload_sha, 16), 'none')
    || '; reply ' || CASE WHEN reply IS NULL THEN 'absent' ELSE 'present, ' || length(reply) || ' chars' END
    || '; parse ' || CASE WHEN reply IS NULL THEN 'no reply' WHEN category IS NULL THEN 'parses' ELSE 'does not parse (' || category || ')' END
    || '; requests ' || requests || '; peak ' || peak || '; in-equivalent ' || format('{:,}', round_even(in_equiv, 0)::BIGINT) AS line FROM spawn""")
oracle("transcript_void", """SELECT agent::VARCHAR AS subject, tool_uses || ' tool_use block(s)' AS reason FROM matched WHERE tool_uses > 0
    UNION ALL SELECT agent::VARCHAR, 'model ' || coalesce(models, 'none') FROM matched WHERE models IS DISTINCT FROM 'model-0'
    UNION ALL SELECT agent::VARCHAR, offered || ' offered tools' FROM matched WHERE offered <> 2
    UNION ALL SELECT agent::VARCHAR, 'layout' FROM matched WHERE NOT coalesce(layout_ok, false) OR base_len <> 17
    UNION ALL SELECT agent::VARCHAR, 'the payload matches no key question' FROM matched WHERE run_id IS NULL
    UNION ALL SELECT run_id, 'two transcripts' FROM matched WHERE run_id IS NOT NULL GROUP BY run_id HAVING count(*) > 1
    UNION ALL SELECT min(run_id), 'key rows share a payload' FROM akey GROUP BY payload_sha HAVING count(*) > 1
    UNION ALL SELECT run_id, 'no transcript' FROM abatch b WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.run_id = b.run_id)""")
oracle("transcript_totals", """SELECT count(*) AS spawns, coalesce(sum(peak), 0)::BIGINT AS peak_sum, coalesce(sum(round(in_equiv * 100)), 0) / 100.0::DOUBLE AS in_equiv_sum
    FROM matched WHERE run_id IN (SELECT run_id FROM abatch)""")
oracle("sink_verdicts", f"SELECT qid, '[[verdict]]' || {NL} || 'id = \"' || qid || '\"' || {NL} || 'verdict = \"' || token || '\"' || {NL} || 'input_sha256 = \"' || input_sha256 || '\"' || {NL} AS text FROM payloads JOIN verdicts USING (qid)")
oracle("sink_toml", "SELECT doc_id, sha256(replace(to_json(text || '\"\\' || chr(127) || chr(9))::VARCHAR, chr(127), '\\u007f')) AS digest FROM documents")
cte("key_q", """SELECT run_id, 'set-' || set_index AS "set", CASE WHEN right(run_id, 1) = '3' THEN qid + 1000000 ELSE qid END AS qid FROM sample""")
oracle("key_entries", """SELECT k.run_id, k."set", k.qid, l.qid IS NOT NULL AS found, l.answerable, l.hard_negative FROM key_q k LEFT JOIN labelled l ON l."set" = k."set" AND l.qid = k.qid""")
oracle("commit_faults", f"""SELECT "set", repeat('1', 40) AS pinned, '{COMMIT}' AS indexed, count(*) AS questions FROM labelled WHERE set_index = 2 GROUP BY ALL""")
cte("gated", f"""SELECT c.conv_id, c.turn, c.conv_id + c.turn AS n, f.refusal, v.token FROM conversations c
    JOIN ({SQL['flt_question']}) f ON f.conv_id = c.conv_id AND f.turn = c.turn JOIN ({SQL['verdict_parse']}) v ON v.conv_id = c.conv_id AND v.turn = c.turn""")
cte("ended", """SELECT conv_id, turn, CASE WHEN refusal <> 'ok' THEN refusal WHEN n % 7 = 1 THEN 'rate_limited' WHEN n % 11 = 2 THEN 'paused'
    WHEN n % 13 = 3 THEN 'unusable_question' WHEN n % 5 = 4 THEN 'paused' WHEN token = 'ANSWERABLE' THEN 'answer' WHEN token = 'NOT_ANSWERABLE' THEN 'no_confident_match' ELSE 'judge_error' END AS outcome FROM gated""")
oracle("service_outcomes", """SELECT conv_id, turn, outcome, CASE WHEN outcome IN ('answer', 'no_confident_match') THEN 200 WHEN outcome = 'judge_error' THEN 502 WHEN outcome = 'rate_limited' THEN 429
    WHEN outcome IN ('paused', 'service_off') THEN 503 WHEN outcome = 'body_too_large' THEN 413 ELSE 400 END::BIGINT AS status, outcome IN ('answer', 'no_confident_match', 'judge_error') AS admitted FROM ended""")
oracle("sink_key", f"SELECT run_id, '[' || run_id || ']' || {NL} || 'set = \"set-' || set_index || '\"' || {NL} || 'id = \"' || qid || '\"' || {NL} AS text FROM sample")
_RES = "(((3500 + strlen(text) + 64) * 2000 + 1024 * 10000) * 2)"
oracle("limit_reservation", f"SELECT doc_id, {_RES}::BIGINT AS reserved, {usd(_RES)} AS usd FROM documents")


def all_sql() -> dict[str, str]:
    return {name: render(body) for name, body in SQL.items()}
