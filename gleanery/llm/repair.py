"""Conversation structure repair: cheapest edits by a checkpointed dynamic programme over the turns.

A repaired conversation has roles `(s?(ua)+)?` by their initials. Four states follow that pattern. The cost of the
cheapest way to the end is computed backwards as a vector over the states; it is kept only at checkpoints a square
root of the rows apart, and computed again block by block on the way forward, which always takes the least letter
among the edits that are tight.

Rows are sorted in ranges all over the cluster and packed into chunks of bounded size. A conversation that lies
within one chunk is repaired there. Of a longer one each chunk gives its costs between states (a matrix in min and
plus); a backward pass over these gives the cost vectors between chunks, the outer checkpoints. Each chunk then
walks from each state it may be entered in, a forward pass over chunks picks the state, and the chunk's walk from
it is taken. So no task holds the rows of a whole conversation, and the edits are those of one walk over all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.session import attach, tidy
from gleanery.session import materialise, small_side

#: Rows, and characters of text, of a chunk.
CHUNK_ROWS, CHUNK_CHARS = 4_096, 1 << 20
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. Initials likewise.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The state after a user or assistant turn is put in, which the pattern allows one of only.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: What an edit costs; a truncated turn that stays costs one more.
DELETE, INSERT, REROLE = 3, 2, 2
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _kept(state: int, initial: int) -> int:
    """The state after a turn with this initial stays, or -1."""
    allowed = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}[state]
    return initial if initial in allowed else -1


#: By code (fault and four times the initial): whether the row must go, what it costs if it stays, the state after it.
STEPS = [(c % 4 in (BLANK, DUPLICATE), int(c % 4 == TRUNCATED), [_kept(s, c // 4) for s in range(4)]) for c in range(16)]


def _inserts(r: list[int]) -> list[int]:
    """The costs when turns may be put in first."""
    user, assistant = min(r[USER], r[ASSISTANT] + INSERT), min(r[ASSISTANT], r[USER] + INSERT)
    return [min(r[START], user + INSERT), min(r[SYSTEM], user + INSERT), user, assistant]


END = _inserts([0, FAR, FAR, 0])


def _back(code: int, after: list[int]) -> list[int]:
    """The costs before a row from those behind it."""
    must, late, kept = STEPS[code]
    r = [v + DELETE for v in after]
    if not must:
        for s in range(4):
            r[s] = min(r[s], after[NEXT[s]] + REROLE + late)
            if kept[s] >= 0:
                r[s] = min(r[s], after[kept[s]] + late)
    return _inserts(r)


def before(codes: bytes, after: list[int]) -> list[int]:
    for code in reversed(codes):
        after = _back(code, after)
    return after


def matrix(codes: bytes) -> list[list[int]]:
    """Row by state at the end: the cost from each state to it."""
    return [before(codes, [0 if s == t else FAR for s in range(4)]) for t in range(4)]


def walk(codes: bytes, after: list[int], state: int) -> tuple[str, int]:
    """(the ASCII-least tight edits from a state, the state behind them); vectors are kept a square root apart."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    marks, v = {n: after}, after
    for i in range(n - 1, -1, -1):
        v = _back(codes[i], v)
        if i % step == 0:
            marks[i] = v
    out = []
    for first in range(0, n, step):
        last = min(first + step, n)
        block = [marks[last]]
        for i in range(last - 1, first - 1, -1):
            block.append(_back(codes[i], block[-1]))
        for i in range(first, last):
            now, then = block[last - i], block[last - i - 1]
            must, late, kept = STEPS[codes[i]]
            while True:
                best = now[state]
                if best == then[state] + DELETE:
                    out.append("D")
                    break
                if best == now[NEXT[state]] + INSERT:
                    out.append("I")
                    state = NEXT[state]
                elif not must and kept[state] >= 0 and best == then[kept[state]] + late:
                    out.append("K")
                    state = kept[state]
                    break
                else:
                    out.append("R")
                    state = NEXT[state]
                    break
    return "".join(out), state


def close(state: int) -> str:
    """The inserts behind the last row."""
    return "I" * (END[state] // INSERT)


def lines(audit: str, codes: bytes, roles: list[str], texts: list[str], state: int) -> list[str]:
    """The repaired `role:text` turns; roles and texts are those of the rows that may stay."""
    out, row, item = [], 0, 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append(NAMES[state] + ":")
            continue
        must, _, kept = STEPS[codes[row]]
        if letter == "K":
            state = kept[state]
            out.append(f"{roles[item]}:{texts[item]}")
        elif letter == "R":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{texts[item]}")
        row += 1
        item += not must
    return out


class Chunk:
    """Consecutive rows of a conversation."""

    FIELDS = "n long, lo long, hi long, turns long, first long, last long, i_first int, i_last int, illegal long, blank long, duplicate long, truncated long"

    def __init__(self, conv, seq: int):
        self.conv, self.seq, self.codes, self.roles, self.texts, self.chars = conv, seq, bytearray(), [], [], 0
        self.turns, self.first, self.last, self.lo, self.hi = 0, None, None, None, None

    def add(self, turn, code: int, n: int, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.lo, self.hi = (turn if self.lo is None else self.lo), turn
        if not self.codes:
            self.first = turn
        self.last = turn
        self.codes += bytes([code]) * n
        if not STEPS[code][0]:
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(role) + len(text)

    def full(self, limit: int) -> bool:
        return len(self.codes) >= limit or self.chars >= CHUNK_CHARS

    def facts(self) -> list:
        c = bytes(self.codes)
        pairs = sum((a // 4, b // 4) not in LEGAL for a, b in zip(c, c[1:]))
        faults = [sum(c.count(x) for x in range(f, 16, 4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
        return [len(c), self.lo, self.hi, self.turns, self.first, self.last, c[0] // 4, c[-1] // 4, pairs, *faults]


FACTS = [f.split(" ")[0] for f in Chunk.FIELDS.split(", ")]
PACKED = (
    f"part int, seq int, whole boolean, {Chunk.FIELDS}, cost long, audit string, lines array<string>, "
    "codes binary, roles array<string>, texts array<string>, between array<long>"
)


EDITS = "part int, seq int, cost long, enter int, leave int, audit string"
EMITTED = f"part int, seq int, {Chunk.FIELDS}, cost long, audit string, lines array<string>"
COUNTED = ("blank", "duplicate", "truncated", "illegal")
SUMMED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*rows))], schema=schema)


TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
         "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _schema(kind: pa.DataType, fields: str) -> pa.Schema:
    return pa.schema([("conv_id", kind), *((f.split(" ")[0], TYPES[f.split(" ")[1]]) for f in fields.split(", "))])


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range to chunks; conversations surely whole are repaired."""
    part, chunk, runs, out, schema, kind = TaskContext.get().partitionId(), None, 0, [], None, None
    out_chars = 0

    def put(done: Chunk, whole: bool) -> None:
        nonlocal out_chars
        codes = bytes(done.codes)
        out_chars += done.chars
        if whole:
            audit, state = walk(codes, END, START)
            audit += close(state)
            cost = before(codes, END)[START]
            rest = [cost, audit, lines(audit, codes, done.roles, done.texts, START), None, None, None, None]
        else:
            rest = [None, None, None, codes, done.roles, done.texts, [c for row in matrix(codes) for c in row]]
        out.append((done.conv, part, done.seq, whole, *done.facts(), *rest))

    for batch in batches:
        if schema is None:
            kind = batch.schema.field("conv_id").type
            schema = _schema(kind, PACKED)
        for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk is None or conv != chunk.conv:
                if chunk is not None:
                    put(chunk, runs > 1 and chunk.seq == 0)  # the first of a range may have begun in the one before
                chunk, runs = Chunk(conv, 0), runs + 1
            initial = INITIALS.get(role[:1], START)
            rest = (copies - 1, BLANK if fault == BLANK else DUPLICATE)
            for n, f in ((1, fault), rest):
                while n > 0:
                    if chunk.full(limit):
                        put(chunk, False)
                        chunk = Chunk(conv, chunk.seq + 1)
                    take = min(n, limit - len(chunk.codes))
                    chunk.add(turn, 4 * initial + f, take, role, text)
                    n -= take
            if out_chars >= CHUNK_CHARS or len(out) > 1000:
                yield _table(out, schema)
                out.clear()
                out_chars = 0
    if chunk is not None:
        put(chunk, False)  # may go on in the next range
    if out:
        yield _table(out, schema)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from last to first, by conversation, with the costs behind each."""
    conv, after = (), END
    for batch in batches:
        got, costs = [], []
        for c, between in zip(batch.column("conv_id").to_pylist(), batch.column("between").to_pylist()):
            if conv != (c,):
                conv, after = (c,), END
            got.append(after)
            after = [min(between[4 * t + s] + after[t] for t in range(4)) for s in range(4)]
            costs.append(after[START])
        kept = [k for k, n in enumerate(batch.schema.names) if n != "between"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in kept), pa.array(costs, pa.int64()), pa.array(got, pa.list_(pa.int64()))],
            names=[*(batch.schema.names[k] for k in kept), "cost", "after"],
        )


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk of each chunk from each state."""
    for batch in batches:
        found = [[walk(c, v, s) for s in range(4)] for c, v in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist())]
        kept = [k for k, n in enumerate(batch.schema.names) if n != "codes"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in kept), pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string())),
             pa.array([[s for _, s in f] for f in found], pa.list_(pa.int64()))],
            names=[*(batch.schema.names[k] for k in kept), "walks", "exits"],
        )


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order, by conversation, with the state each is entered in, the one it is left in and its edits."""
    conv, state = (), START
    names = ("conv_id", "part", "seq", "cost", "walks", "exits")
    for batch in batches:
        rows = []
        for c, part, seq, cost, walks, exits in zip(*(batch.column(n).to_pylist() for n in names)):
            if conv != (c,):
                conv, state = (c,), START
            rows.append((c, part, seq, cost, state, exits[state], walks[state]))
            state = exits[state]
        if rows:
            yield _table(rows, _schema(batch.schema.field("conv_id").type, EDITS))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of chunks whose edits are known; the last chunk of a conversation is closed."""
    names = ("conv_id", "part", "seq", *FACTS, "cost", "last_chunk", "enter", "leave", "audit", "codes", "roles", "texts")
    for batch in batches:
        rows = []
        for *own, last, enter, leave, audit, codes, roles, texts in zip(*(batch.column(n).to_pylist() for n in names)):
            audit += close(leave) if last else ""
            rows.append((*own, audit, lines(audit, codes, roles, texts, enter)))
        if rows:
            yield _table(rows, _schema(batch.schema.field("conv_id").type, EMITTED))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order to a row for each conversation; turns pass one chunk at a time, only their hash is kept."""
    names = ["conv_id", *FACTS, "cost", "audit", "lines"]
    now, kind = None, None

    def row():
        gaps = now["hi"] - now["lo"] + 1 - now["turns"] if now["hi"] is not None else 0
        return (now["conv"], gaps, *(now[f] for f in COUNTED), now["cost"], "".join(now["audit"]), now["sha"].hexdigest())

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        out = []
        for values in zip(*(batch.column(n).to_pylist() for n in names)):
            r = dict(zip(names, values))
            if now is None or now["conv"] != r["conv_id"]:
                if now:
                    out.append(row())
                now = {"conv": r["conv_id"], "cost": r["cost"], "lo": None, "hi": None, "turns": 0, "audit": [], "sha": hashlib.sha256(), "any": False}
                now |= {f: 0 for f in COUNTED}
            else:
                now["illegal"] += (now["i_last"], r["i_first"]) not in LEGAL
                now["turns"] -= r["first"] is not None and r["first"] == now["last"]
            for f in (*COUNTED, "turns"):
                now[f] += r[f]
            now["lo"] = r["lo"] if now["lo"] is None else now["lo"]
            now["hi"] = now["hi"] if r["hi"] is None else r["hi"]
            now["last"], now["i_last"] = r["last"], r["i_last"]
            now["audit"].append(r["audit"])
            for line in r["lines"]:
                now["sha"].update((b"\n" if now["any"] else b"") + line.encode())
                now["any"] = True
        if out:
            yield _table(out, _schema(kind, SUMMED))
    if now:
        yield _table([row()], _schema(kind, SUMMED))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of `conv_id:turn`; nulls are one space: (conv_id, turn, role, text, copies)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    filled = [F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")]
    k = F.col("_k")
    return conversations.select("conv_id", "turn", *filled, (F.crc32(key) % 20).alias("_k")).filter(k != 0).select(
        "conv_id", "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(k == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def packed(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) to chunks, repaired where a conversation lies within one."""
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*order).agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("_same", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    seen = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_same").alias("_again")).agg(
        F.min(F.struct("turn")).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    seen = small_side(materialise(seen.filter("_n > 1").drop("_n"), "repeats"))
    rows = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_same") == F.col("_again")), "left")
    later = F.coalesce(F.struct("turn") > F.col("_first"), F.lit(False))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(later, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(FINE)
    )
    rows = rows.select(*order, "copies", fault.alias("fault"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.mapInArrow(tidy(partial(_pack, limit=chunk_rows)), f"conv_id {kind}, {PACKED}"), "packed")


def _edited(open_: DataFrame) -> DataFrame:
    """Chunks of conversations that lie in several, with edits and repaired turns."""
    kind = open_.schema["conv_id"].dataType.simpleString()
    place = ["conv_id", "part", "seq"]
    back = open_.select(*place, "codes", "between").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    base = f"conv_id {kind}, part int, seq int"
    back = back.mapInArrow(tidy(_backward), f"{base}, codes binary, cost long, after array<long>")
    walks = back.repartition(*place).mapInArrow(tidy(_walks), f"{base}, cost long, after array<long>, walks array<string>, exits array<long>")
    ahead = walks.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(tidy(_forward), f"conv_id {kind}, {EDITS}")
    last = open_.groupBy(F.col("conv_id").alias("_last")).agg(F.max(F.struct("part", "seq")).alias("_end"))
    ahead = materialise(ahead, "edits").withColumnsRenamed({c: f"_{c}" for c in place})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    found = open_.select(*place, *FACTS, "codes", "roles", "texts").join(ahead, same[0] & same[1] & same[2])
    found = found.join(last, F.col("conv_id").eqNullSafe(F.col("_last"))).select(
        *place, *FACTS, "cost", (F.struct("part", "seq") == F.col("_end")).alias("last_chunk"), "enter", "leave", "audit", "codes", "roles", "texts"
    )
    return materialise(found.mapInArrow(tidy(_emit), f"conv_id {kind}, {EMITTED}"), "edited")


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation, the repaired turns chunk by chunk) of conversations after `damaged`.

    The first has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for every
    conv_id of the table, a null one included, with zeros and empty texts if no row is left. The second has conv_id,
    part, seq, audit and lines: the edits and the repaired turns as `role:text`, in the order of (part, seq).
    Rows are ordered by turn (null first), then role and text; equal rows of a turn are duplicates but for the
    first. An empty role, or one that starts otherwise than s, u or a, fits nowhere: such a turn is reroled or
    deleted. A text of white space alone is blank. Further columns are not looked at; no rows give no rows.
    """
    attach(conversations.sparkSession)
    conversations = conversations.select("conv_id", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    chunks = packed(damaged(conversations), chunk_rows)
    edited = _edited(chunks.filter("not whole"))
    place = ["conv_id", "part", "seq"]
    whole = chunks.filter("whole")
    names = [x.split(" ")[0] for x in SUMMED.split(", ")]
    summed = whole.select(
        "conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *COUNTED, "cost", "audit", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"),
    )
    gathered = edited.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(tidy(_gather), f"conv_id {kind}, {SUMMED}")
    summed = summed.unionByName(gathered).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(summed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names[:-2]],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
    turns = whole.select(*place, "audit", "lines").unionByName(edited.select(*place, "audit", "lines"))
    return out, turns
