"""The judge's reply as column expressions: parsing, categories, the deciding line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.words import SPACE_CLASS, has_hidden, strip_space
from gleanery.params import (
    ANSWERABLE,
    BLOCK_ID,
    DEFAULT_LIMITS,
    JUDGE_ERROR,
    NOT_ANSWERABLE,
    PROMPT_ID,
    PROMPT_SHA256,
)

# The error categories, the verdict line and the payload boundaries.
UNREADABLE = "verdict file unreadable"
TOO_LONG = "reply too long"
EMPTY = "empty reply"
CONTROL = "control or format character"
MALFORMED = "malformed verdict line"
WRONG_ID = "wrong block id"
MULTI_TOKEN = "more than one verdict token"
DIFFERENT_INPUT = "verdict is for a different input"
FORGED_MARKER = "passage line starts like a payload marker"
VERDICT_LINE = (
    rf"(?s)^([^ ]+) (ANSWERABLE|NOT_ANSWERABLE):?(?: [^{SPACE_CLASS}].*)?\z"
)
BOUNDARY = "^(=== |--- passage |--- end passage )"
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def last_line(reply: Column) -> Column:
    """The last non-empty line, trimmed; null if there is none."""
    lines = F.transform(F.split(reply, "\r\n|\n|\r"), strip_space)
    return F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(-1))


def verdict_category(reply: Column, block_id: str = BLOCK_ID) -> Column:
    """The error category of a reply, first rule wins; null if the reply is a verdict."""
    line = last_line(reply)
    body = F.translate(reply, "\n\r", "")
    return (
        F.when(F.octet_length(reply) > DEFAULT_LIMITS.max_reply_bytes, TOO_LONG)
        .when(line.isNull(), EMPTY)
        .when(has_hidden(body), CONTROL)
        .when(~line.rlike(VERDICT_LINE), MALFORMED)
        .when(F.regexp_extract(line, VERDICT_LINE, 1) != block_id, WRONG_ID)
        .when(F.regexp_count(line, F.lit("ANSWERABLE")) != 1, MULTI_TOKEN)
    )


def verdict_token(reply: Column, block_id: str = BLOCK_ID) -> Column:
    """ANSWERABLE, NOT_ANSWERABLE or JUDGE_ERROR."""
    return F.when(verdict_category(reply, block_id).isNotNull(), JUDGE_ERROR).otherwise(
        F.regexp_extract(last_line(reply), VERDICT_LINE, 2)
    )


def signal_line(token: Column) -> Column:
    return F.concat(
        F.lit("Deciding signal: answerability judge verdict "), token,
        F.lit(f" (prompt {PROMPT_ID}, sha256 {PROMPT_SHA256})"),
    )


def rendered(token: Column, result_text: Column) -> Column:
    """What is printed once a verdict is applied; an error prints no passage."""
    line = F.concat(signal_line(token), F.lit("\n"))
    return (
        F.when(token == NOT_ANSWERABLE, F.concat(F.lit("no confident match\n"), line))
        .when(token == ANSWERABLE, F.concat(result_text, F.lit("\n"), line))
        .otherwise("judge error\n")
    )


def forges_boundary(text: Column) -> Column:
    """True if a line of the text would read as a payload boundary."""
    return F.exists(F.split(text, LINE_BREAKS), lambda x: x.rlike(BOUNDARY))
