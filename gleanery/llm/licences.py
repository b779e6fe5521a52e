"""Licence scan: notice phrases and identifier tags found by Aho-Corasick, expressions by shunting-yard.

A text is lower-cased (A-Z) and cut into words of ASCII letters, digits and other scripts. One automaton
finds every phrase as consecutive whole words. Tags ("SPDX-License-Identifier:" and its kin) are found by
a second one in the unchanged text; the expression behind a tag is parsed into postfix order and
evaluated: `and` needs every part, `or` offers a choice, `with` attaches an exception to a licence. What the
expressions of a text leave open is part of the result: the licences that no choice avoids, and whether some
choice is permissive throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.session import attach, tidy
from gleanery.llm.textnum import ALNUM, LOWER

# Phrases that must be found, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notice phrases and the labels that this scan adds.
MORE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "isc license": "isc",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
# Identifier tags.
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")
# Identifiers that have a label of their own above; others keep their lower-case form.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3",
    "agpl-3.0": "agpl-3", "mpl-2.0": "mpl-2", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3",
    "lgpl-2.0": "lgpl", "lgpl-2.0-only": "lgpl", "lgpl-2.0-or-later": "lgpl", "lgpl-2.1": "lgpl", "lgpl-2.1+": "lgpl",
    "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl", "lgpl-3.0-only": "lgpl",
    "lgpl-3.0-or-later": "lgpl", "gpl-2.0+": "gpl-2", "gpl-3.0+": "gpl-3", "agpl-3.0-only": "agpl-3",
    "agpl-3.0-or-later": "agpl-3", "epl-1.0": "epl", "epl-2.0": "epl", "cc-by-3.0": "cc-by", "cc-by-sa-3.0": "cc-by-sa",
    "cc-by-nd-3.0": "cc-by-nd", "cc-by-nd-4.0": "cc-by-nd", "cc-by-nc-3.0": "cc-by-nc",
    "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc", "cc0-1.0": "cc0",
}
PERMISSIVE = {"mit", "apache-2", "bsd", "bsd-2", "bsd-3", "isc", "cc-by", "cc0"}

#: How sure one place of each kind makes the scan that the text is licensed so.
BASE_WEIGHT, MORE_WEIGHT, TAG_WEIGHT = 0.7, 0.6, 0.9

BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by shunting-yard; None if it is not well formed."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last thing read can stand left of an operator
    exception = False  # whether a plain name must follow
    for token in TOKEN.findall(expression):
        word = token.lower()
        if word in BINDING:
            if not operand:
                return None
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[word]:
                out.append(held.pop())
            held.append(word)
            operand, exception = False, word == "with"
        elif token == "(":
            if operand or exception:
                return None
            held.append(token)
        elif token == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand, exception = True, False
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out if operand else None


def evaluate(order: list[str]) -> tuple[list[str], bool, set[str]]:
    """(labels named, whether a permissive choice satisfies the expression, labels in every choice)."""
    labels: list[str] = []
    stack: list[tuple[bool, frozenset[str]]] = []  # (permissive, labels that no choice avoids)
    for item in order:
        if item in BINDING:
            (right, needs), (left, has) = stack.pop(), stack.pop()
            if item == "with":
                labels.pop()  # the exception is no licence
                stack.append((left, has))
            elif item == "or":
                stack.append((left or right, has & needs))
            else:
                stack.append((left and right, has | needs))
        else:
            label = IDENTIFIERS.get(item.lower(), item.lower())
            labels.append(label)
            stack.append((label in PERMISSIVE, frozenset([label])))
    return labels, stack[0][0], set(stack[0][1])


def _leading(text: str) -> str:
    """What stands behind a tag on its line: the longest start made of identifiers and operators."""
    line = text.split("\n", 1)[0].strip().strip("*/#<>-!").strip()
    tokens, kept, operand = list(TOKEN.finditer(line)), 0, False
    for m in tokens:
        word = m[0].lower()
        if word not in BINDING and m[0] not in "()" and operand:
            break
        if m[0] not in "()":
            operand = word not in BINDING
        kept = m.end()
    return line[:kept]


def _table() -> bytes:
    return bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))


WORD_BYTES = _table()
_automata: list = []


def automata() -> tuple:
    """(phrases, tags), built once in each Python worker."""
    if not _automata:
        phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for table, base in ((MORE_PHRASES, False), (BASE_PHRASES, True)):
            for phrase, label in table.items():
                phrases.add_word(f" {phrase} ", (len(phrase) + 1, label, base))
        for tag in TAGS:
            tags.add_word(tag, len(tag))
        phrases.make_automaton()
        tags.make_automaton()
        _automata.extend((phrases, tags))
    return tuple(_automata)


def scan(text: str) -> dict:
    """All places of phrases and tags in one text."""
    phrases, tags = automata()
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found, base, more, at, seen = [], set(), set(), 0, 0
    doubt = 1.0
    for end, (length, label, is_base) in phrases.iter(flat):
        start = end - length  # of the first word
        if start < at:
            seen, at = 0, 0
        seen += flat.count(" ", at, start)
        at = start
        found.append((seen, label, is_base))
        (base if is_base else more).add(label)
        doubt *= 1 - (BASE_WEIGHT if is_base else MORE_WEIGHT)
    expressions, required = [], set()
    if "dentifier:" in text or "xpression:" in text or "DENTIFIER:" in text or "XPRESSION:" in text:
        low, last = text.translate(_SMALL), -1
        for end, _ in tags.iter(low):
            if end == last:
                continue  # a tag that ends another tag
            last = end
            expression = _leading(text[end + 1 :])
            order = postfix(expression)
            if order:
                labels, permissive, needed = evaluate(order)
                more.update(labels)
                required |= needed
                expressions.append((expression, permissive))
                doubt *= 1 - TAG_WEIGHT
    starts = [k for k, _, is_base in found if is_base]
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | more)),
        "score": 1.0 - doubt,
        "required": ",".join(sorted(required)),
        "permissive": all(p for _, p in expressions) if expressions else None,
        "places": [{"word": k, "label": label} for k, label, _ in sorted(found)],
        "expressions": [{"expression": e, "permissive": p} for e, p in expressions],
    }


_SMALL = {i: i + 32 for i in range(65, 91)}
FIELDS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
    "labels": "string", "score": "double", "required": "string", "permissive": "boolean", "places": "array<struct<word:long,label:string>>",
    "expressions": "array<struct<expression:string,permissive:boolean>>",
}
ARROW = {
    "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(),
    FIELDS["places"]: pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])),
    FIELDS["expressions"]: pa.list_(pa.struct([("expression", pa.string()), ("permissive", pa.bool_())])),
}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, required, permissive, places,
    expressions).

    `required` names the licences that no choice between `or` avoids, over all expressions; `permissive` says
    whether each has a choice of permissive licences alone, and is null without expressions.
    One output row for each input row, repeated rows and null ids included. A null text is empty: no
    words, no places, empty labels, score 0. Overlapping places all count. A malformed expression
    behind a tag is passed over. Other columns are ignored.
    """
    attach(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                rows = [scan(t.as_py() or "") for t in part.column("text")]
                cols = [pa.array([r[k] for r in rows], ARROW[kind]) for k, kind in FIELDS.items()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", *FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{k} {v}" for k, v in FIELDS.items())])
    return docs.mapInArrow(tidy(run), schema).withColumnRenamed("doc_id", id_col)
