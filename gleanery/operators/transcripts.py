"""Agent transcripts: usage, replies, audit lines, and the rules that void a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.verdicts import verdict_category

USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")


def message_usage(records: DataFrame) -> DataFrame:
    """Per agent and message id the column-wise maximum: a message is recorded many times."""
    return records.filter(F.col("type") == "assistant").groupBy("agent", "mid").agg(
        *[F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in USAGE]
    )


def agent_usage(records: DataFrame) -> DataFrame:
    """(agent, requests, peak, in_equiv). The equivalent is summed in hundredths, so it is exact."""
    whole = sum((F.col(c) for c in USAGE[1:]), F.col(USAGE[0]))
    hundredths = (
        F.col("input_tokens") * 100 + F.col("cache_creation_input_tokens") * 125
        + F.col("cache_read_input_tokens") * 10 + F.col("output_tokens") * 100
    )
    return message_usage(records).groupBy("agent").agg(
        F.count(F.lit(1)).alias("requests"),
        F.max(whole).alias("peak"),
        (F.sum(hundredths) / 100.0).alias("in_equiv"),
    )


def last_reply(records: DataFrame) -> DataFrame:
    """(agent, reply): the text blocks of the last message, joined in order.

    The last message is found by an aggregate; only its own blocks are then gathered.
    """
    said = records.filter(F.col("type") == "assistant")
    last = said.groupBy("agent").agg(F.max_by("mid", "line").alias("mid"))
    blocks = said.join(last, ["agent", "mid"]).filter(F.size("texts") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("line", "texts")))
    return blocks.groupBy("agent").agg(
        F.array_join(F.flatten(F.transform(ordered, lambda x: x["texts"])), "").alias("reply")
    )


def agent_facts(records: DataFrame) -> DataFrame:
    """(agent, models, tool_uses): what each transcript used."""
    said = records.filter(F.col("type") == "assistant")
    return said.groupBy("agent").agg(
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.sum("tool_uses").alias("tool_uses"),
    )


def prompts(records: DataFrame) -> DataFrame:
    """(agent, prompt): the first user record."""
    users = records.filter(F.col("type") == "user")
    return users.groupBy("agent").agg(F.min_by("prompt", "line").alias("prompt"))


def split_prompt(prompt: Column, first_line: str) -> tuple[Column, Column]:
    """Whether the prompt has the expected first line and a blank one after it, and the payload."""
    ok = prompt.rlike(rf"(?s)^{first_line}\n\n")
    return ok, F.when(ok, F.regexp_extract(prompt, r"(?s)^[^\n]*\n\n(.*)\z", 1))


def spawns(records: DataFrame, meta: DataFrame, first_line: str) -> DataFrame:
    """One row per transcript: everything the audit reads."""
    asked = prompts(records)
    ok, payload = split_prompt(F.col("prompt"), first_line)
    base = asked.select(
        "agent", ok.alias("layout_ok"), F.sha2(payload, 256).alias("payload_sha"),
        F.length(F.split_part("prompt", F.lit("\n"), F.lit(1))).alias("base_len"),
    )
    out = meta.join(base, "agent", "left")
    for side in (agent_facts(records), agent_usage(records), last_reply(records)):
        out = out.join(side, "agent", "left")
    return out.fillna(0, ["tool_uses", "requests", "peak"]).fillna(0.0, ["in_equiv"])


def check_lines(audited: DataFrame) -> DataFrame:
    """(agent, line): the audited fields as text; neither reply nor verdict is shown."""
    category = verdict_category(F.col("reply"))
    parse = (
        F.when(F.col("reply").isNull(), "no reply").when(category.isNull(), "parses")
        .otherwise(F.format_string("does not parse (%s)", category))
    )
    return audited.select(
        "agent",
        F.format_string(
            "agent %s: type %s; models %s; offered tools %d; tool_use %d; base line %d (layout %s); "
            "payload sha16 %s; reply %s; parse %s; requests %d; peak %d; in-equivalent %s",
            F.col("agent").cast("string"), "agent_type", F.coalesce("models", F.lit("none")), "offered", "tool_uses", "base_len",
            F.when(F.col("layout_ok"), "ok").otherwise("BAD"),
            F.coalesce(F.substring("payload_sha", 1, 16), F.lit("none")),
            F.when(F.col("reply").isNull(), "absent").otherwise(
                F.format_string("present, %d chars", F.length("reply"))),
            parse, "requests", "peak", F.format_number("in_equiv", 0),
        ).alias("line"),
    )


def match_payloads(audited: DataFrame, key: DataFrame) -> DataFrame:
    """Transcripts with the run id whose payload they answered, if any."""
    return audited.join(
        key.select("run_id", F.col("payload_sha").alias("payload_sha")), "payload_sha", "left"
    )


def void_reasons(
    matched: DataFrame, key: DataFrame, batch: DataFrame, model: str, offered: int, base_len: int
) -> DataFrame:
    """(subject, reason): any row voids the whole batch."""
    per_spawn = F.array_compact(F.array(
        F.when(F.col("tool_uses") > 0, F.format_string("%d tool_use block(s)", "tool_uses")),
        F.when(~F.col("models").eqNullSafe(F.lit(model)), F.format_string("model %s", F.coalesce("models", F.lit("none")))),
        F.when(F.col("offered") != offered, F.format_string("%d offered tools", "offered")),
        F.when(~F.coalesce("layout_ok", F.lit(False)) | (F.col("base_len") != base_len), "layout"),
        F.when(F.col("run_id").isNull(), "the payload matches no key question"),
    ))
    subject = F.col("agent").cast("string").alias("subject")
    reasons = matched.select(subject, F.explode(per_spawn).alias("reason"))
    twice = matched.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select(F.col("run_id").alias("subject"), F.lit("two transcripts").alias("reason"))
    same = key.groupBy("payload_sha").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("r"))
    same = same.filter("n > 1").select(F.col("r").alias("subject"), F.lit("key rows share a payload").alias("reason"))
    missing = batch.join(matched.select("run_id"), "run_id", "left_anti").select(
        F.col("run_id").alias("subject"), F.lit("no transcript").alias("reason"))
    return reasons.unionByName(twice).unionByName(same).unionByName(missing)


def batch_totals(audited: DataFrame) -> DataFrame:
    """One row over the rows of the batch: spawns, peak and equivalent sums."""
    inside = F.col("in_batch")
    return audited.agg(
        F.count_if(inside).alias("spawns"),
        F.coalesce(F.sum(F.when(inside, F.col("peak"))), F.lit(0)).alias("peak_sum"),
        F.coalesce(F.sum(F.when(inside, F.round(F.col("in_equiv") * 100).cast("bigint"))), F.lit(0))
        .alias("hundredths"),
    ).select("spawns", "peak_sum", (F.col("hundredths") / 100.0).alias("in_equiv_sum"))

