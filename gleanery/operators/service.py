"""The question service as a batch: gates in order, outcomes, usage counts, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.words import has_hidden, squeeze_space, strip_space
from gleanery.params import DEFAULT_LIMITS, LimitParams

# The outcomes, their status, and which count as admitted.
STATUS = {
    "answer": 200, "no_confident_match": 200, "judge_error": 502, "empty_question": 400,
    "unusable_question": 400, "too_long": 400, "bad_request": 400, "body_too_large": 413,
    "rate_limited": 429, "paused": 503, "service_off": 503,
}
ADMITTED = ("answer", "no_confident_match", "judge_error")


def status_of(outcome: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.try_element_at(table, outcome)


def clean_question(raw: Column) -> Column:
    return strip_space(F.replace(raw, F.lit("\r\n"), F.lit("\n")))


def question_refusal(raw: Column, p: LimitParams = DEFAULT_LIMITS) -> Column:
    """Why a question is refused, first rule wins; null if it may go on."""
    text = clean_question(raw)
    return (
        F.when(text == "", "empty_question")
        .when(F.char_length(text) > p.max_question_chars, "too_long")
        .when((squeeze_space(text) == "") | has_hidden(squeeze_space(text)), "unusable_question")
    )


def cross_site(site: Column, origin: Column, host: Column) -> Column:
    """True for a request from another site: declared so, or an origin that is not the host."""
    declared = F.lower(F.trim(F.coalesce(site, F.lit("")))) == "cross-site"
    own = F.lower(F.trim(F.coalesce(host, F.lit(""))))
    netloc = F.lower(F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return declared | (origin.isNotNull() & ((netloc != own) | (own == "")))


def content_kind(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))


def json_question(body: Column) -> Column:
    """The question of a body that is exactly one string field of that name, else null."""
    keys = F.json_object_keys(body)
    single = (F.size(keys) == 1) & (F.element_at(keys, 1) == "question")
    parsed = F.from_json(body, "struct<question:string>")["question"]
    is_string = body.rlike(r'(?s)^\s*\{\s*"question"\s*:\s*"')
    return F.when(single & is_string, parsed)


def request_refusal(p: LimitParams = DEFAULT_LIMITS) -> Column:
    """The gates before the question is read, over columns kill_switch, site, origin, host,
    content_type and body."""
    kind = content_kind(F.col("content_type"))
    usable = (kind == "application/json") & json_question(F.col("body")).isNotNull()
    return (
        F.when(F.col("kill_switch") != "off", "service_off")
        .when(cross_site(F.col("site"), F.col("origin"), F.col("host")), "bad_request")
        .when(F.octet_length("body") > p.max_body_bytes, "body_too_large")
        .when(~usable, "bad_request")
    )


def final_outcome() -> Column:
    """The outcome of a request from the state of each gate, first failure wins: columns refusal,
    allowed, open, found, reserved and token."""
    return (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(~F.col("allowed"), "rate_limited")
        .when(~F.col("open"), "paused")
        .when(~F.col("found"), "unusable_question")
        .when(~F.col("reserved"), "paused")
        .when(F.col("token") == "ANSWERABLE", "answer")
        .when(F.col("token") == "NOT_ANSWERABLE", "no_confident_match")
        .otherwise("judge_error")
    )


def usage_counts(log: DataFrame) -> DataFrame:
    """One row over (kind, outcome, admitted): visits, answered, refused, asked, clicks counted."""
    ask = F.col("kind") == "ask"
    answered = F.count_if(ask & (F.col("outcome") == "answer"))
    refused = F.count_if(ask & (F.col("outcome") == "no_confident_match"))
    return log.agg(
        F.count_if(F.col("kind") == "visit").alias("visits"),
        answered.alias("answered"),
        refused.alias("refused"),
        (answered + refused).alias("asked"),
        F.count_if((F.col("kind") == "click") & F.col("admitted")).alias("docs_clicks"),
    )
