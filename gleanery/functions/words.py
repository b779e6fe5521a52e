"""Tokens of a text as JVM-side column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The NLTK English stopword list (179 words).
STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both
    each few more most other some such no nor not only own same so than too very s t can will just
    don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't
    needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)
# An apostrophe never survives tokenising, so only the alphanumeric entries can match.
STOP_TERMS = tuple(w for w in STOPWORDS if w.isalnum())

WORD_PATTERN = r"[\p{L}\p{N}]+"
# What Python counts as white space.
SPACE_CLASS = (
    "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
)
HIDDEN_PATTERN = r"[\p{Cc}\p{Cf}]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Where case folding differs from lower-casing: one-to-one pairs, then expansions."""
    single_from, single_to, expand = [], [], []
    for point in range(sys.maxunicode + 1):
        ch = chr(point)
        if unicodedata.category(ch) == "Cs" or ch.lower() != ch:
            continue
        folded = ch.casefold()
        if folded == ch:
            continue
        if len(folded) == 1:
            single_from.append(ch)
            single_to.append(folded)
        else:
            expand.append((ch, folded))
    return "".join(single_from), "".join(single_to), tuple(expand)


@lru_cache(maxsize=1)
def _rough_ranges(gap: int = 64) -> str:
    """A few character ranges that cover every rare folding: a cheap test, never a false no."""
    single_from, _, expand = _fold_tables()
    points = sorted(ord(ch) for ch in single_from + "".join(ch for ch, _ in expand) if ch != "ß")
    ranges = [[points[0], points[0]]]
    for point in points[1:]:
        if point - ranges[-1][1] <= gap:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)


def casefold(text: Column) -> Column:
    """Full Unicode case folding on top of `lower`. The rare foldings run only where one occurs."""
    single_from, single_to, expand = _fold_tables()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in expand])
    rare = F.aggregate(
        pairs, F.translate(low, single_from, single_to), lambda t, p: F.replace(t, p["a"], p["b"])
    )
    return F.when(low.rlike(f"[{_rough_ranges()}]"), rare).otherwise(low)


def words(text: Column) -> Column:
    """Folded runs of letters and digits, stopwords dropped, not stemmed."""
    runs = F.regexp_extract_all(casefold(text), F.lit(WORD_PATTERN), F.lit(0))
    return F.filter(runs, lambda w: ~w.isin(*STOP_TERMS))


def path_stem(path: Column) -> Column:
    """The path without its last extension, if the base name has a dot at all."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def body_text(text: Column, heading_path: Column) -> Column:
    """The passage without its heading line; a preamble has none to drop."""
    below = F.locate("\n", text)
    rest = F.when(below > 0, F.substr(text, below + 1)).when(below == 0, "")
    return F.when(F.size(heading_path) > 0, rest).otherwise(text)


def model_text(text: Column, heading_path: Column) -> Column:
    """What the embedder and the reranker read: heading trail, newline, body."""
    return F.concat(F.array_join(heading_path, " > "), F.lit("\n"), body_text(text, heading_path))


def heading_label(heading_path: Column, top: str) -> Column:
    return F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > ")).otherwise(top)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\\z", "")


def squeeze_space(text: Column) -> Column:
    """Every run of white space becomes one blank; none at either end."""
    return F.trim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def has_hidden(text: Column) -> Column:
    return text.rlike(HIDDEN_PATTERN)


def s_stem(word: Column) -> Column:
    """The S-stemmer: three ordered plural rules, first match wins, words over three letters."""
    return (
        F.when(F.length(word) <= 3, word)
        .when(word.rlike("ies$") & ~word.rlike("[ea]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("es$") & ~word.rlike("[aeo]es$"), F.regexp_replace(word, "es$", "e"))
        .when(word.rlike("s$") & ~word.rlike("[us]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
