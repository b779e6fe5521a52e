"""Text forms of results: links, money, percentages, spans, log lines, escaped HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.words import SPACE_CLASS

EXCERPT_LINES = 3
EXCERPT_CHARS = 160


def escape_path(path: Column) -> Column:
    for raw, code in (("%", "%25"), (" ", "%20"), ("#", "%23"), ("?", "%3F")):
        path = F.replace(path, F.lit(raw), F.lit(code))
    return path


def file_link(repo: str, commit: str, path: Column) -> Column:
    return F.concat(F.lit(f"https://github.com/{repo}/blob/{commit}/"), escape_path(path))


def passage_link(repo: str, commit: str, path: Column, start: Column, end: Column) -> Column:
    return F.concat(file_link(repo, commit, path), F.format_string("?plain=1#L%d-L%d", start, end))


def usd(nano: Column) -> Column:
    """Nano-dollars with six decimals, truncated."""
    whole = F.floor(nano / F.lit(1_000_000_000)).cast("bigint")
    rest = F.floor((nano - whole * 1_000_000_000) / F.lit(1000)).cast("bigint")
    return F.format_string("%d.%06d", whole, rest)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals of the exact value, ties to even, as C and Python print them."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def percent(part: Column, total: Column) -> Column:
    ratio = F.when(total > 0, F.lit(100.0) * part / total).otherwise(F.lit(0.0))
    return F.concat(fixed(ratio, 1), F.lit("%"))


def reaches(part: Column, total: Column, percent_needed: int) -> Column:
    """part/total >= percent/100 in integers; an empty total never reaches."""
    return (total > 0) & (part * 100 >= total * percent_needed)


def line_span(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("Line %d", start)).otherwise(
        F.format_string("Lines %d to %d", start, end)
    )


def link_span(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("line %d", start)).otherwise(
        F.format_string("lines %d to %d", start, end)
    )


def first_sentence(text: Column) -> Column:
    return F.concat(F.split_part(text, F.lit(". "), F.lit(1)), F.lit(""))


def excerpt(body: Column) -> Column:
    """The first three non-blank lines, each cut to 160 characters with an ellipsis."""
    kept = F.slice(
        F.filter(F.split(body, "\n"), lambda x: ~x.rlike(f"^[{SPACE_CLASS}]*\\z")), 1, EXCERPT_LINES
    )
    cut = F.transform(
        kept,
        lambda x: F.concat(
            F.lit("      | "),
            F.when(F.length(x) <= EXCERPT_CHARS, x).otherwise(
                F.concat(F.substring(x, 1, EXCERPT_CHARS - 1), F.lit("…"))
            ),
        ),
    )
    return F.array_join(cut, "\n")


def escape_html(text: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def abuse_line(key16: Column, outcome: Column, ts: Column) -> Column:
    """The one request log line: time, hashed key, outcome. A bad key is an error."""
    checked = F.when(key16.rlike("^[0-9a-f]{16}$"), key16).otherwise(
        F.raise_error(F.lit("the key must be 16 lowercase hex characters")).cast("string")
    )
    return F.format_string('{"t":"%s","ip":"%s","o":"%s"}', utc_stamp(ts), checked, outcome)


def ops_line(code: Column, ts: Column, category: Column) -> Column:
    """An operations line; only a failed start carries a category."""
    return F.when(
        (code == "startup_failed") & category.isin("prompt_hash", "index", "model"),
        F.format_string('{"t":"%s","ops":"startup_failed","c":"%s"}', utc_stamp(ts), category),
    ).when(
        code.isin("startup_ok", "unhandled") & category.isNull(),
        F.format_string('{"t":"%s","ops":"%s"}', utc_stamp(ts), code),
    )
