"""Vector columns: normalise, quantise to int8, and the exact integer dot product."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.tokens import Alphabet, lowered, lowering
from gleanery.params import DENSE_DIM, INT8_SCALE


def l2_normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def quantise(vector: Column) -> Column:
    """clamp(round-half-even(127 x)) as signed bytes."""
    top = float(INT8_SCALE)
    return F.transform(
        vector,
        lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.rint(x * top))).cast("tinyint"),
    )


def dequantise(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / INT8_SCALE)


def dot(left: Column, right: Column) -> Column:
    """Exact: the bytes are widened before they are multiplied."""
    products = F.zip_with(left, right, lambda x, y: x.cast("bigint") * y.cast("bigint"))
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda a, x: a + x)


def similarity(dot_product: Column) -> Column:
    return dot_product / float(INT8_SCALE * INT8_SCALE)


def base64_text(vector: Column) -> Column:
    """The signed bytes in base64, in one line."""
    pairs = F.transform(
        vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")
    )
    return F.translate(F.base64(F.unhex(F.array_join(pairs, ""))), "\r\n", "")


def vector_of(text: Column, dim: int) -> Column:
    """The signed bytes of a base64 text; null unless it is base64 of exactly `dim` bytes."""
    raw = F.try_to_binary(text, F.lit("base64"))
    value = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    signed = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda at: F.when(value(at) > 127, value(at) - 256).otherwise(value(at)).cast("tinyint"))
    return F.when(F.octet_length(raw) == dim, signed)


def model_words(text: Column) -> Column:
    """Word characters and underscores, lower-cased: what the offline embedder counts."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _slot(word: str, dim: int) -> tuple[int, float]:
    digest = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(digest[:4], "big") % dim, 1.0 if digest[4] % 2 else -1.0


#: Words whose slot a worker remembers.
WORDS_KEPT = 150_000


class _Slots(dict):
    """The slot of each word, times two, and one more where its sign is positive."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, word: str) -> int:
        slot, sign = _slot(word, self.dim)
        self[word] = code = slot * 2 + (sign > 0)
        return code


_slots: dict[int, _Slots] = {}


def word_counter(spark: SparkSession) -> Callable[[Column], Column]:
    """How many `model_words` a text has; null for a null text."""
    alphabet = lowering(spark)

    @F.arrow_udf(T.IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        counts = [n for _, some in alphabet.batches(texts.fill_null("").to_pylist()) for n in some.tolist()]
        return pa.array(counts, pa.int32(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return lambda text: count(lowered(text))


def hashed_embedding(dim: int = DENSE_DIM) -> Callable[[Column], Column]:
    """Offline embedder: hashed bag of words, unit length, int8. No model, no network."""

    def embedder(alphabet: Alphabet) -> Callable[[Column], Column]:
        @F.arrow_udf(T.ArrayType(T.ByteType()))
        def embed(texts: pa.Array) -> pa.Array:
            from gleanery.functions import vectors as here  # the worker's own module, which outlives the task

            slots = here._slots.setdefault(dim, here._Slots(dim))
            codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for words, some in alphabet.batches(texts.fill_null("").to_pylist()):
                codes.append(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)))
                counts.append(some)
                if len(slots) > WORDS_KEPT:
                    slots.clear()
            codes, rows = np.concatenate(codes), np.repeat(np.arange(len(texts)), np.concatenate(counts))
            bags = np.bincount(rows * dim + codes // 2, codes % 2 * 2.0 - 1.0, len(texts) * dim).reshape(len(texts), dim)
            norm = np.sqrt((bags * bags).sum(axis=1, keepdims=True))
            unit = np.divide(bags, norm, out=bags, where=norm > 0)
            packed = np.clip(np.rint(unit * INT8_SCALE), -INT8_SCALE, INT8_SCALE).astype(np.int8)
            offsets = pa.array(np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(packed.reshape(-1)))

        return embed

    return lambda text: embedder(lowering(SparkSession.active()))(lowered(text))
