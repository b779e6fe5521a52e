"""Daily spend in integer nano-dollars: charges per call, reservations, day totals."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.formats import usd
from gleanery.operators.scan import laid_out, running
from gleanery.params import DEFAULT_LIMITS, LimitParams
from gleanery.session import materialise, small_side

NEVER_BILLED = ("status_4xx", "connection")
RETRIED = ("status_429", "status_5xx", "connection")
DAYS_IN_LONGEST_MONTH = 31


def daily_cap(monthly_usd: str) -> int:
    """The day's share of a monthly cap over the longest month, floored."""
    return int(Decimal(monthly_usd) * 10**9) // DAYS_IN_LONGEST_MONTH


def reservation(system_bytes: Column, payload_bytes: Column, p: LimitParams = DEFAULT_LIMITS) -> Column:
    """The most one call can cost: no more input tokens than bytes and framing, and the longest output."""
    tokens_in = system_bytes + payload_bytes + p.framing_tokens
    return (tokens_in * p.price_in_nano + p.max_output_tokens * p.price_out_nano).cast("bigint")


def cost(tokens_in: Column, tokens_out: Column, p: LimitParams = DEFAULT_LIMITS) -> Column:
    return tokens_in * p.price_in_nano + tokens_out * p.price_out_nano


def charge(per_attempt: Column, p: LimitParams = DEFAULT_LIMITS) -> Column:
    """What a call costs, from columns configured, success, input_tokens, output_tokens and
    billable_failures: usage if it is known, a full bound for each possibly billed failure."""
    failed = F.col("billable_failures") * per_attempt
    unknown = F.col("input_tokens").isNull() | F.col("output_tokens").isNull()
    return (
        F.when(~F.col("configured"), F.lit(0))
        .when(~F.col("success"), failed)
        .when(unknown, per_attempt + failed)
        .otherwise(cost(F.col("input_tokens"), F.col("output_tokens"), p) + failed)
        .cast("bigint")
    )


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """(qid, attempts, success, billable_failures, category, input_tokens, output_tokens).

    `attempts` (qid, n, category, ...) has category null for a success; `status_429` counts as a
    4xx. Only attempts the loop would really make are read: it stops at the first success, at the
    second attempt, and after a failure that is not retried.
    """
    first_final = F.min(
        F.when(F.col("category").isNull() | ~F.col("category").isin(*RETRIED), F.col("n"))
    )
    stop = attempts.groupBy("qid").agg(F.least(F.coalesce(first_final, F.lit(2)), F.lit(2)).alias("stop"))
    made = attempts.join(stop, "qid").filter(F.col("n") <= F.col("stop"))
    named = F.when(F.col("category") == "status_429", "status_4xx").otherwise(F.col("category"))
    billed = F.col("category").isNotNull() & ~named.isin(*NEVER_BILLED)
    return made.groupBy("qid").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max(F.col("category").isNull()).alias("success"),
        F.count_if(billed).alias("billable_failures"),
        F.max_by(named, "n").alias("category"),
        F.max(F.when(F.col("category").isNull(), F.col("input_tokens"))).alias("input_tokens"),
        F.max(F.when(F.col("category").isNull(), F.col("output_tokens"))).alias("output_tokens"),
    )


def spend_log(ops: DataFrame, cap: int, ranges: int | None = None) -> DataFrame:
    """`ops` plus `decision` and `spent`, the settled spend of the day after each operation.

    `ops` (day, us, seq, kind, rid, amount, ...): a reserve asks for `amount`; a settle adds `amount` to the day's
    spend, whatever became of its reservation `rid`, and ends that reservation if it is open that day. The first
    reserve that the settled spend leaves no room for closes the day. Before, a reserve is busy if spend and open
    reservations leave no room. A `rid` is reserved once a day.

    Settled spend doesn't hang on decisions: it is a running sum over ranges of the day's operations, and where it
    closes the day another. So does what was asked for at most: reserves that fit even so are accepted. Only what
    is left of a day, if anything, is replayed for its open reservations, range by range (`_replayed`).
    """
    reserve = F.col("kind") == "reserve"
    stored = laid_out(ops, ["day"], ["us", "seq"], ranges=ranges)
    zero = F.lit(0).cast("long")
    sums = running(stored, ["day"], {
        "spent": ("sum", F.when(~reserve, F.col("amount")).otherwise(zero)),
        "_asked": ("sum", F.when(reserve, F.greatest("amount", zero)).otherwise(zero)),
    })
    over = reserve & (F.col("spent") + F.col("amount") > cap)
    known = running(sums, ["day"], {"_over": ("sum", over.cast("long"))})
    sure = F.col("spent") + F.col("_asked") <= cap
    known = known.withColumn(
        "decision",
        F.when(~reserve, "settled").when(over & (F.col("_over") == 1), "closes").when(F.col("_over") > 0, "paused").when(sure, "accepted"),
    )
    known = materialise(known.drop("_asked"), "spend")
    tight = known.filter("decision is null").select("day").distinct()
    live = known.filter("_over = 0").join(tight, "day", "left_semi")
    decided = _replayed(live.select("day", "_part", "_at", "kind", "rid", "amount", "spent"), cap)
    decided = decided.select(F.col("_at").alias("_place"), F.col("decision").alias("_found"))
    out = known.join(decided, F.col("_at") == F.col("_place"), "left")
    return out.select(*ops.columns, F.coalesce("decision", "_found").alias("decision"), "spent")


def _replayed(live: DataFrame, cap: int) -> DataFrame:
    """(day, _part, _at, rid, amount, decision) of the reserves of `live`, all ranges at once.

    A range is replayed from the reservations open at its start, which first are guessed to be none. From the
    decisions follows what really was open at the start of each range; ranges that began otherwise are replayed
    again, until none did. The first range of a day is right from the start and each round makes at least the next
    one right, but as later ones hardly hang on the start, a few rounds do. The result is that of one replay in order.
    """
    live = materialise(live, "live")
    numbered = Window.partitionBy("day").orderBy("_part")
    chain = live.groupBy("day", "_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row for each range of a day
    chain = materialise(chain.select("day", "_part", F.row_number().over(numbered).alias("_i")), "chain")
    if chain.filter("_i > 1").isEmpty():  # every day lies in one range, which begins with nothing open
        return _from_open(live, None, cap)
    begins = live.filter("kind = 'reserve'").join(chain, ["day", "_part"]).select("day", "rid", "_at", F.col("_i").alias("_from"))
    ends = live.filter("kind = 'settle'").join(chain, ["day", "_part"]).select("day", "rid", F.col("_at").alias("_end"), F.col("_i").alias("_to"))
    last = chain.groupBy("day").agg(F.max("_i").alias("_last"))
    lives = begins.join(ends, ["day", "rid"], "left").groupBy("day", "_at", "_from").agg(F.min(F.when(F.col("_end") > F.col("_at"), F.col("_to"))).alias("_to"))
    lives = lives.join(last, "day").withColumn("_to", F.coalesce("_to", "_last")).filter("_to > _from").select("_at", "_from", "_to")
    lives = materialise(lives, "lives")  # reservations that are open where a range ends, if accepted
    done = _from_open(live, None, cap)
    began = live.limit(0).select("day", "_part", *[F.lit(0).cast("long").alias(c) for c in ("mark", "n")])
    while True:
        held = done.filter("decision = 'accepted'").join(lives, "_at").withColumn("_i", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))))
        carry = materialise(held.select("day", "_i", "rid", "amount").join(chain, ["day", "_i"]).select("day", "_part", "rid", "amount"), "carry")
        starts = carry.groupBy("day", "_part").agg(F.bit_xor(F.xxhash64("rid", "amount")).alias("mark"), F.count(F.lit(1)).alias("n"))
        starts = materialise(starts, "starts")
        same = ["day", "_part", "mark", "n"]
        changed = starts.join(began, same, "left_anti").unionByName(began.join(starts, same, "left_anti")).select("day", "_part").distinct()
        changed = materialise(changed, "changed")
        if changed.isEmpty():
            return done
        few = small_side(changed)
        again = _from_open(live.join(few, ["day", "_part"], "left_semi"), carry.join(few, ["day", "_part"], "left_semi"), cap)
        done = materialise(done.join(few, ["day", "_part"], "left_anti").unionByName(again), "replayed")
        began = starts


REPLAYED = "day {}, _part int, _at long, rid {}, amount long, decision string"


def _from_open(live: DataFrame, carry: DataFrame | None, cap: int) -> DataFrame:
    """Decisions of each range, from the reservations open at its start that `carry` says."""
    rows = live.select("day", "_part", "_at", "kind", "rid", "amount", "spent")
    if carry is not None:
        rows = rows.unionByName(carry.select(
            "day", "_part", F.lit(-1).cast("long").alias("_at"), F.lit("open").alias("kind"), "rid", "amount", F.lit(0).cast("long").alias("spent")
        ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, flight = None, {}, 0  # open reservations; the cap bounds them
        for batch in batches:
            out = []
            for day, part, place, kind, rid, amount, spent in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (day, part):
                    at, held, flight = (day, part), {}, 0
                if kind == "settle":
                    flight -= held.pop(rid, 0)
                elif kind == "reserve" and spent + flight + amount > cap:
                    out.append((day, part, place, rid, amount, "busy"))
                else:
                    flight += amount - held.get(rid, 0)
                    held[rid] = amount
                    if kind == "reserve":
                        out.append((day, part, place, rid, amount, "accepted"))
            if out:
                yield _rows(out, batch.schema)

    kinds = [rows.schema[c].dataType.simpleString() for c in ("day", "rid")]
    ordered = rows.repartition("day", "_part").sortWithinPartitions("day", "_part", "_at")
    return materialise(ordered.mapInArrow(run, REPLAYED.format(*kinds)), "replay")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    names = ["day", "_part", "_at", "rid", "amount", "decision"]
    kinds = [schema.field(n).type if n in schema.names else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def day_totals(log: DataFrame, cap: int, floor: int) -> DataFrame:
    """(day, accepted, refused, judged, tokens_in, tokens_out, spent, closed, resting): one row per UTC day. Tokens are
    those of settled calls, as far as they are known."""
    is_reserve = F.col("kind") == "reserve"
    totals = log.groupBy("day").agg(
        F.count_if(is_reserve & (F.col("decision") == "accepted")).alias("accepted"),
        F.count_if(is_reserve & (F.col("decision") != "accepted")).alias("refused"),
        F.count_if(F.col("decision") == "settled").alias("judged"),
        *[
            F.coalesce(F.sum(F.when(F.col("decision") == "settled", F.col(c))), F.lit(0)).alias(c)
            for c in ("tokens_in", "tokens_out") if c in log.columns
        ],
        F.sum(F.when(F.col("decision") == "settled", F.col("amount")).otherwise(0)).alias("spent"),
        F.max(F.col("decision") == "closes").alias("closed"),
    )
    return totals.select(
        "*",
        (F.col("closed") | (F.col("spent") + floor > cap)).alias("resting"),
        usd(F.col("spent")).alias("spent_usd"),
    )
