"""The Porter (1980) stemmer over whole Arrow batches: each distinct word is stemmed once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.words import STOP_TERMS

# The suffix tables of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

#: A word with none of these ends is its own stem.
ENDS = ("s", "ed", "ing", "y", "e", "ll", *STEP2, *STEP3, *STEP4)
#: Stems kept in one Python worker: frequent words stay, words that occur once pass through.
STEMS_KEPT = 1 << 15

_SHAPE = str.maketrans("aeiou", "VVVVV")
#: Each table by the length of its suffixes, longest first: the longest that fits is the one that counts.
_BY_LENGTH = [
    [(n, {s: to for s, to in table.items() if len(s) == n}) for n in sorted({len(s) for s in table}, reverse=True)]
    for table in (STEP2, STEP3, dict.fromkeys(STEP4, ""))
]
_ANY = [tuple(table) for table in (STEP2, STEP3, STEP4)]


def shape(word: str) -> str:
    """One letter per character: V for a vowel, C for a consonant. A `y` after a consonant is V."""
    if "y" not in word:
        return re.sub("[^V]", "C", word.translate(_SHAPE))
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "C")
        out += "V" if vowel else "C"
    return out


def _m(stem: str) -> int:
    """Runs of vowels that consonants follow."""
    n, before = 0, None
    for ch in stem:
        vowel = ch in "aeiou" or (ch == "y" and before is False)
        n += before is True and not vowel
        before = vowel
    return n


def _has_vowel(stem: str) -> bool:
    return any(v in stem for v in "aeiou") or ("y" in stem and "V" in shape(stem))


def _short_tail(stem: str) -> bool:
    return shape(stem).endswith("CVC") and stem[-1] not in "wxy"


def _suffix(word: str, step: int) -> tuple[str, str, str] | None:
    """The word without its longest suffix of a table, that suffix, and what stands for it."""
    if word.endswith(_ANY[step]):
        for n, table in _BY_LENGTH[step]:
            if (end := word[-n:]) in table:
                return word[:-n], end, table[end]
    return None


def _swap(word: str, step: int) -> str:
    hit = _suffix(word, step)
    return hit[0] + hit[2] if hit and _m(hit[0]) > 0 else word


def _drop_inflection(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _m(word[:-3]) > 0 else word
    base = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else word
    if base is word or not _has_vowel(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-1:] == base[-2:-1] and base[-1] not in "lsz" and shape(base).endswith("C"):
        return base[:-1]
    return base + "e" if _m(base) == 1 and _short_tail(base) else base


def porter(word: str) -> str:
    return _stem(word) if len(word) > 2 and word.endswith(ENDS) else word


@lru_cache(maxsize=STEMS_KEPT)
def _stem(word: str) -> str:
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and word[-2] != "s":
        word = word[:-1]
    word = _drop_inflection(word)
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, 0), 1)
    hit = _suffix(word, 2)
    if hit and _m(hit[0]) > 1 and (hit[1] != "ion" or hit[0].endswith(("s", "t"))):
        word = hit[0]
    if word.endswith("e"):
        m = _m(word[:-1])
        if m > 1 or (m == 1 and not _short_tail(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _m(word) > 1 else word


class Vocabulary(dict):
    """The number of each word's stem, given when the word is first asked for; -1 for a stopword."""

    def __init__(self) -> None:
        self.stems: list[str] = []
        self._numbers: dict[str, int] = {}
        self._stop = frozenset(STOP_TERMS)

    def __missing__(self, word: str) -> int:
        number = -1
        if word not in self._stop:
            stem = porter(word)
            number = self._numbers.setdefault(stem, len(self.stems))
            if number == len(self.stems):
                self.stems.append(stem)
        self[word] = number
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


TERM_COUNTS = T.ArrayType(
    T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())])
)


def _flat(lists: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The values of a list column, dictionary-encoded, and each row's length."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    encoded = pc.list_flatten(lists).dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded, lengths.astype(np.int64)


def _stemmed(encoded: pa.DictionaryArray) -> pa.DictionaryArray:
    stems = pa.array([porter(w) for w in encoded.dictionary.to_pylist()], pa.string())
    merged = stems.dictionary_encode()
    return pa.DictionaryArray.from_arrays(merged.indices.take(encoded.indices), merged.dictionary)


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(tokens: pa.Array) -> pa.Array:
    """Porter stems of every token list in the batch."""
    encoded, lengths = _flat(tokens)
    stems = _stemmed(encoded)
    return pa.ListArray.from_arrays(_offsets(lengths), stems.dictionary_decode())


@F.arrow_udf(TERM_COUNTS)
def stem_counts(tokens: pa.Array) -> pa.Array:
    """Per row, each distinct stem with its count. One row in, one row out: no shuffle."""
    encoded, lengths = _flat(tokens)
    stems = _stemmed(encoded)
    size = max(len(stems.dictionary), 1)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    codes = stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, counts = np.unique(rows * size + codes, return_counts=True)
    per_row = np.bincount(pairs // size, minlength=len(lengths))
    entries = pa.StructArray.from_arrays(
        [stems.dictionary.take(pa.array(pairs % size)), pa.array(counts.astype(np.int32))],
        names=["term", "tf"],
    )
    return pa.ListArray.from_arrays(_offsets(per_row), entries)
