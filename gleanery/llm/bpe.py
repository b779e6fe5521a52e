"""BPE encoding and decoding by a deterministic tokenization automaton.

The merges are compiled one after the other. Merge (u, v) adds a gadget: the state that arcs labelled u
lead to is copied without its arc v, the arcs u are led to the copy, and wherever a path u v was
possible an arc labelled uv leads to the state behind v. Every arc with the same label leads to the same
state, so the automaton is one state for each token (the last redirection of its arcs) and a transition
rule that is read off the chain of copies; answers are kept in a table. It accepts exactly one token
sequence for each string: the one that the merges give in order.

`encode_words` follows it over the symbols of a pre-split word. Decoding emits the labels of the arcs,
joined as the tokenizer file (which names no decoder) says: by one space.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.session import attach, tidy


#: Bytes of each of the two tables of encoded chunks in one Python worker: when the newer one is full it becomes
#: the older one, so that chunks in use stay. An entry is the chunk, its packed ids and about ENTRY bytes besides.
TABLE_BYTES, ENTRY = 48 << 20, 200
#: Entries of the table of known arcs (about 130 bytes each).
ARCS_KEPT = 200_000
#: Entries of either table that stay from one task to the next: the worker lives on, and others need memory.
KEPT_BETWEEN_TASKS = 120_000
#: Tokens of an output batch, about.
MOST_TOKENS = 250_000
NO_STATE = 0

# White space by which the normaliser's pattern splits: Unicode's property, without the separators
# U+001C to U+001F that str.split() also takes.
ODD_SPACES = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Automaton:
    """The compiled merges of one tokenizer file."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.special_at = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._compile(model["merges"])
        self.longest = max((len(t.removesuffix(self.end)) for t in self.live), default=1)
        self.trie: dict = {}
        for text, token in self.live.items():
            if not self.end or not text.endswith(self.end):
                node = self.trie
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = token
        self.table: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.numbers = [str(i) for i in range(max(self.labels) + 1)]
        self.marks = [self.labels.get(i, "") for i in range(len(self.numbers))]

    def _compile(self, merges: list) -> None:
        merged = set()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        merged = {u + v for u, v in pairs}
        size = max(self.ids.values()) + 1
        self.born = [0] * size
        self.left = [-1] * size
        self.state = [NO_STATE] * size
        self.parent, self.without, self.since = [-1], [-1], [0]
        self.live = {t: i for t, i in self.ids.items() if t not in merged}
        for now, (a, b) in enumerate(pairs, start=1):
            u, v, new = self.ids[a], self.ids[b], self.ids[a + b]
            self.born[new], self.left[new] = now, u
            if a not in self.live or b not in self.live or not self.follows(self.state[u], v):
                continue  # u is never followed by v: no arc
            self.live[a + b] = new
            self.state[new] = self.state[v]
            self.parent.append(self.state[u])
            self.without.append(v)
            self.since.append(now)
            self.state[u] = len(self.parent) - 1

    def follows(self, state: int, token: int) -> bool:
        """Whether `state` has an arc for `token`.

        An arc made by a merge after the state exists where the arc of its left part did; an older
        one was copied from the parent unless it is the one left out.
        """
        while state != NO_STATE:
            if self.born[token] >= self.since[state]:
                token = self.left[token]
            elif self.without[state] == token:
                return False
            else:
                state = self.parent[state]
        return True

    def encode_word(self, word: str) -> list[int]:
        """The tokens of a word given in byte letters; the last symbol carries the end mark.

        The start state has an arc for every token, so a word that is a token is its own path. Else
        each prefix has one path: `last` holds its last token, and the arcs that leave it are tried.
        """
        n, live = len(word), self.live
        whole = live.get(word + self.end)
        if whole is not None:
            return [whole]
        last: list[int] = [-1] * (n + 1)
        back = [0] * (n + 1)
        for j in range(n):
            before = last[j]
            if j and before < 0:
                continue
            node, i = self.trie, j
            for c in word[j : n - 1]:
                node = node.get(c)
                if node is None:
                    break
                i += 1
                token = node.get("")
                if token is None or last[i] >= 0:
                    continue
                if not j or self.joins(before, token):
                    last[i], back[i] = token, j
            if last[n] < 0 and n - j <= self.longest:
                token = live.get(word[j:] + self.end)
                if token is not None and (not j or self.joins(before, token)):
                    last[n], back[n] = token, j
        if n and last[n] < 0:
            raise ValueError("a word has a symbol that the vocabulary lacks")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def joins(self, before: int, token: int) -> bool:
        """Whether the state behind `before` has an arc for `token`, from the table where known."""
        arc = before << 20 | token
        ok = self.table.get(arc)
        if ok is None:
            if len(self.table) > ARCS_KEPT:
                self.table.clear()
            ok = self.table[arc] = self.follows(self.state[before], token)
        return ok

    def encode_chunk(self, chunk: str) -> list[int]:
        """Tokens of a normalised text without white space."""
        ids: list[int] = []
        for word in self.words.findall(chunk):
            ids += self.encode_word(word.encode().decode("latin-1").translate(self.letters))
        return ids

    def chunk(self, chunk: str) -> bytes:
        """The packed ids of a normalised text without white space."""
        got = self.chunks.get(chunk)
        if got is None:
            got = self.older.get(chunk)
            if got is None:
                got = array("i", self.encode_chunk(chunk)).tobytes()
            if len(chunk) <= 64:
                if self.held >= TABLE_BYTES:
                    self.older, self.chunks, self.held = self.chunks, {}, 0
                self.chunks[chunk] = got
                self.held += len(chunk) + len(got) + ENTRY
        return got

    def rest(self) -> None:
        """Between tasks: keep the chunks met first, mostly frequent ones, and give up the others."""
        self.older = {}
        self.chunks = dict(itertools.islice(self.chunks.items(), KEPT_BETWEEN_TASKS))
        self.table = dict(itertools.islice(self.table.items(), KEPT_BETWEEN_TASKS))
        self.held = sum(len(k) + len(v) + ENTRY for k, v in self.chunks.items())

    def normal(self, text: str) -> list[str]:
        """The normalised text, cut at white space."""
        text = unicodedata.normalize("NFC", text)
        if ODD_SPACES.search(text):
            parts = [p for p in SPACES.split(text) if p]
            return [p.replace("Σ", "σ").lower() for p in parts]
        return text.replace("Σ", "σ").lower().split()

    def parts(self, text: str | None) -> Iterator[bytes]:
        """The packed ids of consecutive parts of a text."""
        at = 0
        if self.special_at is not None and "<|" in (text or ""):
            for m in self.special_at.finditer(text):
                yield from map(self.chunk, self.normal(text[at : m.start()]))
                yield array("i", [self.special[m[0]]]).tobytes()
                at = m.end()
        yield from map(self.chunk, self.normal((text or "")[at:]))

    def packed(self, text: str | None) -> array:
        ids = array("i")
        ids.frombytes(b"".join(self.parts(text)))
        return ids

    def encode(self, text: str | None) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join([self.labels[i] for i in ids])


_built: dict[str, Automaton] = {}


def automaton(raw: bytes) -> Automaton:
    """The automaton of a tokenizer file, compiled once in each Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _built:
        _built[key] = Automaton(raw)
    return _built[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(id, n_tokens, ids: array of int, decoded: string, and the columns in `keep`) for each row of `docs`.

    One output row for each input row, repeated rows and null ids included; a null text is empty
    and has no tokens. Other columns are ignored. The tokenizer file is read on the driver (a
    published vocabulary of a few MB) and sent to the executors.
    """
    return _applied(docs, tokenizer, id_col, text_col, ("n_tokens", "ids", "decoded"), keep)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def digests(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, as `encode` but without the lists; with `ids` the
    token ids too, and the columns in `keep`."""
    return _applied(docs, tokenizer, id_col, text_col, (*DIGESTS, *["ids"] * ids), keep)


KINDS = {
    "n_tokens": ("long", lambda auto, ids: len(ids)),
    "decoded": ("string", lambda auto, ids: " ".join([auto.marks[i] for i in ids])),
    "ids_sha256": ("string", lambda auto, ids: _sha(" ".join([auto.numbers[i] for i in ids]))),
    "decoded_sha256": ("string", lambda auto, ids: _sha(" ".join([auto.marks[i] for i in ids]))),
}


def _applied(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, wanted: Sequence[str], keep: Sequence[str]) -> DataFrame:
    spark = attach(docs.sparkSession)
    raw = spark.sparkContext.broadcast(_read(tokenizer))
    docs = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), *(F.struct(F.col(f"`{c}`").alias("x")).alias(f"k{i}") for i, c in enumerate(keep))).alias("row"),
        F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(raw.value)
        for batch in batches:
            first, size = 0, 0
            out: dict[str, list] = {name: [] for name in wanted}
            lists, ends = array("i"), [0]
            for k, text in enumerate(batch.column("text")):
                ids = auto.packed(text.as_py())
                for name in wanted:
                    if name != "ids":
                        out[name].append(KINDS[name][1](auto, ids))
                size += len(ids)
                if "ids" in out:
                    lists += ids
                    ends.append(size)
                if size >= MOST_TOKENS or k == len(batch) - 1:
                    if "ids" in out:
                        values = pa.Array.from_buffers(pa.int32(), size, [None, pa.py_buffer(lists)])
                        out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").slice(first, k + 1 - first), *map(pa.array, out.values())], names=["row", *wanted]
                    )
                    first, size = k + 1, 0
                    out = {name: [] for name in wanted}
                    lists, ends = array("i"), [0]
        auto.rest()

    row = docs.schema["row"].dataType.simpleString()
    kinds = {name: kind for name, (kind, _) in KINDS.items()} | {"ids": "array<int>"}
    out = docs.mapInArrow(tidy(run), f"row {row}, " + ", ".join(f"{name} {kinds[name]}" for name in wanted))
    kept = [F.col(f"row.k{i}.x").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("row.doc_id").alias(id_col), *kept, *wanted)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) from lists of token ids: the labels of the arcs, joined by one space.

    A null or empty list gives an empty text; an id outside the vocabulary is an error.
    """
    spark = attach(tokens.sparkSession)
    raw = spark.sparkContext.broadcast(_read(tokenizer))
    tokens = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = automaton(raw.value).labels
        for batch in batches:
            texts = [" ".join([labels[i] for i in x.as_py() or []]) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(tidy(run), f"doc_id {kind}, decoded string").withColumnRenamed("doc_id", id_col)
