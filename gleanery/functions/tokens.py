"""Words of whole Arrow batches in Python tasks: character for character those of the column functions.

What each character folds to, and whether it belongs to a word, is asked of the column functions once per process;
a task looks both up in one table. Folding goes character by character: the one rule of `lower` that looks around, that
of the final sigma, is undone by `casefold`, and `lowered` leaves such texts to the column function.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.words import WORD_PATTERN, casefold

#: Characters that can be letters or numbers, or fold: what lies between is unassigned or private.
PLANES = (range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000))
#: Stands between texts: no text of a table has a lone surrogate.
BREAK = "\ud800"
BATCH_CHARS = 1_000_000
SPACE, LONGER = 0x20, 0  # what is of no word, and what folds to more than one character


@dataclass(frozen=True)
class Alphabet:
    """`table`, packed, has what each character of a word folds to; `longer` the foldings to several characters."""

    table: bytes
    longer: tuple[tuple[str, str], ...]

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The folded words of all texts, and how many each text has."""
        if not texts:
            return [], np.zeros(0, np.int64)
        joined = BREAK.join(texts)
        codes, folded = self._folded(joined)
        if (folded == LONGER).any():
            several = dict(self.longer)
            joined = re.sub(f"[{''.join(map(re.escape, several))}]", lambda hit: several[hit[0]], joined)
            codes, folded = self._folded(joined)
        inside = folded != SPACE
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        ends = np.append(np.flatnonzero(codes == ord(BREAK)), len(codes))
        counts = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
        return folded.tobytes().decode("utf-32-le").split(), counts

    def batches(self, texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[list[str], np.ndarray]]:
        """What `words` gives, for some texts at a time."""
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= most):
                chars += len(texts[hi])
                hi += 1
            yield self.words(texts[lo:hi])
            lo = hi

    def _folded(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, _unpacked(self.table)[codes]


@lru_cache(maxsize=4)
def _unpacked(table: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.uint32)


_alphabets: dict[str, Alphabet] = {}


def _alphabet(spark: SparkSession, name: str, fold: Callable[[Column], Column], pattern: str) -> Alphabet:
    if name not in _alphabets:
        chars = [chr(c) for plane in PLANES for c in plane if c != ord("\n")]
        every = spark.createDataFrame([("\n".join(chars),)], "text string")
        row = every.select(fold(F.col("text")).alias("folded"), F.regexp_replace("text", pattern, "").alias("others")).first()
        folded, others = row["folded"].split("\n"), set(row["others"])
        table = np.full(0x110000, SPACE, np.uint32)
        for ch, to in zip(chars, folded, strict=True):
            if len(to) > 1:
                table[ord(ch)] = LONGER
            elif to not in others:
                table[ord(ch)] = ord(to)
        longer = tuple((ch, to) for ch, to in zip(chars, folded) if len(to) > 1)
        _alphabets[name] = Alphabet(zlib.compress(table.tobytes()), longer)
    return _alphabets[name]


def folding(spark: SparkSession) -> Alphabet:
    """Words as `words` finds them, with stopwords."""
    return _alphabet(spark, "fold", casefold, WORD_PATTERN)


def lowering(spark: SparkSession) -> Alphabet:
    """Words as `model_words` finds them in texts of `lowered`."""
    return _alphabet(spark, "lower", F.lower, r"[\p{L}\p{N}_]+")


def lowered(text: Column) -> Column:
    """`text`, in lower case already if it has a capital sigma."""
    return F.when(F.contains(text, F.lit("Σ")), F.lower(text)).otherwise(text)
