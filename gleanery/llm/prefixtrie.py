"""Conversation prefix trie: conversations as paths of a tree, totals rolled up by centroid decomposition.

Turns are numbered by running counts over ranges (`operators.scan`), so a conversation of any length is spread
over tasks. A prefix is named by its depth and 128 bits, the exclusive or of a hash of each of its turns with
its place; rows with the same name are one node, known outwards by its smallest member and its depth.

The parent edges form a tree that may be as deep as the longest conversation and as wide as the table. It is cut
into components of bounded size: nodes of a component are connected, have member counts in one class (a power of
`LEAVES`) and lie in one band of depths. Within a class a component has at most LEAVES ends and BAND levels. The
components, each taken as one node, are cut the same way by wider bands, until a component spans its whole class.
Component totals are added up from light classes to heavy ones. Then, from the widest bands down, the totals of
what hangs from a component are put on the nodes it hangs from, and within each component a centroid splits it
again and again: the total at and below the centroid goes to every node on the path from the centroid to the
component's top. Each step halves the component, whatever its shape.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.session import attach, tidy
from gleanery.operators.scan import laid_out, running
from gleanery.session import materialise

#: Ends and levels of a component, at most.
LEAVES, BAND = 64, 64
#: Classes of member counts: LEAVES to this power is beyond any count.
CLASSES = 10
#: Characters of joined ids that are handed on at once.
CHUNK = 1 << 16
#: Every conversation takes its head from the one whose id is the next multiple of GROUP towards zero; of turns
#: it takes what crc32 of its id leaves when divided by HEADS.
GROUP, HEADS = 20, 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, h1, h2, words): the turns of each conversation numbered from 1.

    Order: turn (null first), then role and text. Null roles and texts are empty; rows with a null id, or one
    that is no whole number, are passed over.
    """
    turns = conversations.select(
        F.col("conv_id").try_cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    turns = turns.withColumns({
        "h1": F.xxhash64(F.lit("a"), "role", "text"),
        "h2": F.xxhash64(F.lit("b"), "text", "role"),
        "words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    })
    stored = laid_out(turns, ["conv_id"], ["turn", "role", "text"], ["conv_id", "h1", "h2", "words"])
    return running(stored, ["conv_id"], {"p": ("sum", F.lit(1).cast("long"))}).select("conv_id", "p", "h1", "h2", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations with borrowed heads: (members: conv_id, d turns), (rows: conv_id, d, h1, h2, words)."""
    turns = materialise(turns, "turns")
    head = turns.filter((F.col("conv_id") % group == 0) & (F.col("p") < heads)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("p", "h1", "h2", "words"))).alias("head")  # fewer than `heads` rows
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    members = sizes.withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % group,
        "h": F.crc32(F.col("conv_id").cast("string")) % heads,
    }).join(head, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(head.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    members = members.select("conv_id", "n", "h", taken.alias("head")).withColumn("b", F.size("head").cast("long"))
    members = materialise(members.withColumn("d", F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "members")
    borrowed = members.select("conv_id", F.inline("head")).select("conv_id", F.col("p").alias("d"), "h1", "h2", "words")
    own = turns.join(members.select("conv_id", "h", "b"), "conv_id").filter("p > h").select(
        "conv_id", (F.col("b") + F.col("p") - F.col("h")).alias("d"), "h1", "h2", "words"
    )
    return members.select("conv_id", "d"), borrowed.unionByName(own)


def _paths(rows: DataFrame) -> DataFrame:
    """(conv_id, d, k1, k2, u1, u2, words): the name of each prefix and of the one before it."""
    rows = rows.withColumns({"t1": F.xxhash64(F.lit("c"), "d", "h1", "h2"), "t2": F.xxhash64(F.lit("d"), "h2", "d", "h1")})
    stored = laid_out(rows, ["conv_id"], ["d"], ["conv_id", "d", "t1", "t2", "words"])
    named = running(stored, ["conv_id"], {"k1": ("xor", F.col("t1")), "k2": ("xor", F.col("t2"))})
    return materialise(named.select(
        "conv_id", "d", "k1", "k2", F.col("k1").bitwiseXOR(F.col("t1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("t2")).alias("u2"), "words",
    ), "paths")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, k1, k2, conv_id) to runs of one node: its first id and its ids joined by commas."""
    key, first, ids, size = None, None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("d", "k1", "k2", "conv_id"))):
            if row[:3] != key or size > CHUNK:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, size = row[:3], row[3], [], 0
            ids.append(str(row[3]))
            size += len(ids[-1]) + 1
        if out:
            yield _batch(out, ["d", "k1", "k2", "first", "ids"])
            out = []
    if ids:
        yield _batch([(*key, first, ",".join(ids))], ["d", "k1", "k2", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids from its runs in order."""
    key, state = None, None
    for batch in batches:
        out = []
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "k1", "k2", "ids"))):
            if own != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield _batch(out, ["d", "k1", "k2", "ends"])
    if key:
        yield _batch([(*key, state.hexdigest())], ["d", "k1", "k2", "ends"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def _ends(members: DataFrame, paths: DataFrame) -> DataFrame:
    """(d, k1, k2, ends): the hash of the ids of conversations that end in a node.

    Ids are sorted and joined in ranges all over the cluster; only the hash, whose steps follow each other by its
    definition, reads a node's joined ids in one place, run by run.
    """
    last = paths.groupBy("conv_id").agg(F.max(F.struct("d", "k1", "k2")).alias("e"))
    last = members.select("conv_id").join(last, "conv_id", "left").select(
        *[F.coalesce(f"e.{c}", F.lit(0).cast("long")).alias(c) for c in ("d", "k1", "k2")], "conv_id"
    )
    key = ["d", "k1", "k2"]
    runs = last.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(
        tidy(_join_ids), "d long, k1 long, k2 long, first long, ids string"
    )
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(tidy(_digest), "d long, k1 long, k2 long, ends string")


def centroid_totals(parent: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """The sum of `values` at and below each node of a forest whose parents (-1: none) come before their children.

    Each component is split at the node deepest among those with half of it at or below them.
    """
    acc = [[0] * len(v) for v in values]
    first: dict[int, list[int]] = {}
    top = list(range(len(parent)))
    for i, p in enumerate(parent):
        if p >= 0:
            top[i] = top[p]
        first.setdefault(top[i], []).append(i)
    stack = list(first.values())
    size = [1] * len(parent)
    part = [0] * len(parent)  # of a node below the centroid: the child of the centroid that it is under
    while stack:
        comp = stack.pop()
        if len(comp) == 1:
            for k, v in enumerate(values[comp[0]]):
                acc[comp[0]][k] += v
            continue
        for i in comp:
            size[i] = 1
        for i in reversed(comp[1:]):
            size[parent[i]] += size[i]
        half = (len(comp) + 1) // 2
        x = max(i for i in comp if size[i] >= half)
        rest, below = [], {}
        total = list(values[x])
        for i in comp:
            if i == x:
                part[i] = i
                continue
            up = part[parent[i]] if i != comp[0] else -1
            part[i] = -1 if up < 0 else (i if up == x else up)
            if part[i] < 0:
                rest.append(i)
            else:
                below.setdefault(part[i], []).append(i)
                for k, v in enumerate(values[i]):
                    total[k] += v
        at = x
        while True:  # from the centroid to the top
            for k, v in enumerate(total):
                acc[at][k] += v
            if at == comp[0]:
                break
            at = parent[at]
        stack += [c for c in (rest, *below.values()) if c]
    return acc


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components, sorted and parents first, to the totals of their nodes."""
    names = ["pc", "pt", "uc", "ud", "vc", "vd", "leaves", "saved"]
    held: list[tuple] = []

    def solved(rows):
        at = {(r[2], r[3]): k for k, r in enumerate(rows)}
        parent = [-1 if (r[2], r[3]) == (r[0], r[1]) else at[r[4], r[5]] for r in rows]
        totals = centroid_totals(parent, [(r[6], r[7]) for r in rows])
        return _batch([(r[2], r[3], *t) for r, t in zip(rows, totals)], ["c", "t", "leaves", "saved"])

    for batch in batches:
        held += zip(*(batch.column(n).to_pylist() for n in names))
        cut = len(held)
        while cut and held[cut - 1][:2] == held[-1][:2]:  # the last component may go on in the next batch
            cut -= 1
        if cut:
            yield solved(held[:cut])
            held = held[cut:]
    if held:
        yield solved(held)


def _class(n: Column) -> Column:
    """0 for up to LEAVES members, then one more for each power."""
    level = F.lit(0)
    for k in range(1, CLASSES):
        level += F.when(n > LEAVES**k, 1).otherwise(0)
    return level


def _both(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str]) -> DataFrame:
    """Left join on an id and a depth; the columns of `right` that it is joined on go."""
    renamed = right.withColumnsRenamed({right_on[0]: "_rc", right_on[1]: "_rd"})
    return left.join(renamed, (F.col(left_on[0]) == F.col("_rc")) & (F.col(left_on[1]) == F.col("_rd")), "left").drop("_rc", "_rd")


def _tree(nodes: DataFrame, paths: DataFrame, root: int, level: int) -> tuple[DataFrame, int]:
    """(nodes with their parents (vc, vd) and the tops (c1, t1), (c2, t2) ... of their components, number of bands)."""
    depth = nodes.agg(F.max("d")).first()[0]
    tiers = 1
    while BAND**tiers <= depth:
        tiers += 1
    # all ancestors of a node are on the path of its smallest member
    owners = nodes.groupBy(F.col("c").alias("conv_id")).agg(F.count(F.lit(1)).alias("_n")).select("conv_id")
    own = paths.join(owners, "conv_id").select("conv_id", "d", "k1", "k2")
    own = materialise(own.join(nodes.select("d", "k1", "k2", "c", "level"), ["d", "k1", "k2"]).select("conv_id", "d", "c", "level"), "own")
    start = own.groupBy(F.col("conv_id").alias("c"), "level").agg(F.min("d").alias("start"))
    tree = nodes.join(start, ["c", "level"], "left").withColumn("start", F.when(F.col("level") == level, 0).otherwise(F.col("start")))
    at = own.select("conv_id", F.col("d").alias("at"), F.col("c").alias("_c"))

    def placed(df: DataFrame, name: str, depth: Column, depth_name: str) -> DataFrame:
        df = _both(df.withColumn(depth_name, depth.cast("long")), at, ("c", depth_name), ("conv_id", "at"))
        return df.withColumn(name, F.when(F.col(depth_name) == 0, root).otherwise(F.col("_c"))).drop("_c")

    tree = placed(tree, "vc", F.col("d") - 1, "vd")
    for r in range(1, tiers + 1):
        band = BAND**r
        tree = placed(tree, f"c{r}", F.greatest("start", F.col("d") - F.col("d") % band), f"t{r}")
    kids = tree.filter("d > 0").groupBy(F.col("vc").alias("_kc"), F.col("vd").alias("_kd")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = _both(tree, kids, ("c", "d"), ("_kc", "_kd")).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return materialise(tree.withColumns({
        "leaves": (F.col("n_children") == 0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("words"),
    }).drop("start", "words"), "tree"), tiers


def _sums(df: DataFrame, c: str, t: str) -> DataFrame:
    return df.groupBy(F.col(c).alias("_sc"), F.col(t).alias("_st")).agg(F.sum("leaves").alias("add_leaves"), F.sum("saved").alias("add_saved"))


def _added(df: DataFrame, sums: DataFrame) -> DataFrame:
    """`df` by (c, d) with the sums of that node added to its leaves and saved, which start from 0 if missing."""
    out = _both(df, sums, ("c", "d"), ("_sc", "_st"))
    for name in ("leaves", "saved"):
        own = F.col(name) if name in df.columns else F.lit(0).cast("long")
        out = out.withColumn(name, own + F.coalesce(f"add_{name}", F.lit(0)))
    return out.drop("add_leaves", "add_saved")


def _rolled(tree: DataFrame, tiers: int, level: int) -> DataFrame:
    """(c, d, leaves, saved) of each node with all below it."""
    up = tree.select(
        F.col("c").alias("_pc"), F.col("d").alias("_pd"),
        *[F.col(x).alias(f"p{x}") for r in range(1, tiers + 1) for x in (f"c{r}", f"t{r}")],
    )
    heads = _both(tree.filter("c = c1 and d = t1").drop("leaves", "saved"), up, ("vc", "vd"), ("_pc", "_pd"))
    heads = materialise(heads, "tops")  # tops of wider bands are among them
    comps = heads.filter(f"c = c{tiers} and d = t{tiers}").select(
        "c", "d", "level", F.col(f"pc{tiers}").alias("pc"), F.col(f"pt{tiers}").alias("pt")
    )
    comps = _added(comps, _sums(tree, f"c{tiers}", f"t{tiers}"))
    full = None
    for k in range(level + 1):  # a component hangs from one of a higher class
        now = comps.filter(F.col("level") == k)
        if full is not None:
            now = _added(now, _sums(full, "pc", "pt"))
        now = materialise(now, f"class-{k}")
        full = now if full is None else full.unionByName(now)
    full = full.select("c", "d", "leaves", "saved")
    for r in range(tiers, 0, -1):
        over = ("vc", "vd") if r == 1 else (f"pc{r - 1}", f"pt{r - 1}")
        hang = _both(full, heads.select(F.col("c").alias("_hc"), F.col("d").alias("_hd"), *{*over}), ("c", "d"), ("_hc", "_hd"))
        hang = _sums(hang.filter(F.col(over[0]).isNotNull()), *over)
        if r == 1:
            units = tree
        else:
            units = _added(heads.filter(f"c = c{r - 1} and d = t{r - 1}"), _sums(tree, f"c{r - 1}", f"t{r - 1}"))
        units = _added(units, hang).select(
            F.col(f"c{r}").alias("pc"), F.col(f"t{r}").alias("pt"), F.col("c").alias("uc"), F.col("d").alias("ud"),
            F.col(over[0]).alias("vc"), F.col(over[1]).alias("vd"), "leaves", "saved",
        )
        # a component has LEAVES * BAND nodes at most
        solved = units.repartition("pc", "pt").sortWithinPartitions("pc", "pt", "ud").mapInArrow(
            tidy(_roll), "c long, d long, leaves long, saved long"
        )
        full = materialise(solved, f"rolled-{r}")
    return full


def trie(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trie of `members` (conv_id, one row each) with turns `rows` (conv_id, d from 1, h1, h2, words).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node; see
    `prefix_trie`. Without members there are no nodes.
    """
    spark = members.sparkSession
    paths = _paths(rows)
    all_ = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("c")).first()
    n, root = all_["n"], all_["c"] if all_["n"] else 0
    level = sum(n > LEAVES**k for k in range(1, CLASSES))
    names = "d long, k1 long, k2 long, n_convs long, c long, words long"
    nodes = paths.groupBy("d", "k1", "k2").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("c"), F.max("words").alias("words")
    ).unionByName(spark.createDataFrame([(0, 0, 0, n, root, 0)][: min(n, 1)], names))
    nodes = materialise(nodes.withColumn("level", _class(F.col("n_convs"))), "nodes")
    if n == 0:
        return nodes.select(
            F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), "n_convs",
            *[F.lit(0).cast("long").alias(x) for x in ("n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256"),
        )
    tree, tiers = _tree(nodes, paths, root, level)
    full = _rolled(tree, tiers, level).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    out = _both(tree, full, ("c", "d"), ("c", "d")).join(_ends(members, paths), ["d", "k1", "k2"], "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > 0, F.col("vc")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row for each different prefix of the rebuilt conversations, the empty one included.

    `conversations` has conv_id, turn, role, text; further columns are not looked at. Turns are ordered as
    `ordered_turns` says and conversations rebuilt as `rebuilt` says: the first h turns come from conversation
    conv_id - conv_id % group (the remainder has the sign of the id), h being crc32 of the id modulo `heads`.
    conv_id is the smallest member, parent_conv_id that of the prefix one turn shorter, n_convs the members,
    n_leaves the prefixes at or below it that no member continues, saved_tokens the words of the last turn of each
    prefix at or below it times the members but one, ends_sha256 the hash of the ids of members that end there. An
    empty table gives no rows; rows with null ids are passed over.
    """
    attach(conversations.sparkSession)
    return trie(*rebuilt(ordered_turns(conversations), group, heads))
