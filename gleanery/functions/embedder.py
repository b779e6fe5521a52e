"""The embedder as a port: what turns passages and questions into int8 vectors.

A model is loaded once in each Python worker and fed Arrow batches. Passages are embedded as they are, questions
behind the model's query prefix. Vectors of another width, or with a value that is no finite number, are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.vectors import INT8_SCALE, hashed_embedding

#: From texts to a matrix with a row for each.
Model = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    """`columns` makes the vector column (array<tinyint> of `dim`) of a text column."""

    dim: int
    columns: Callable[[Column], Column]
    query_prefix: str = ""

    def passage(self, text: Column) -> Column:
        return self.columns(text)

    def query(self, question: Column) -> Column:
        return self.columns(F.concat(F.lit(self.query_prefix), question) if self.query_prefix else question)


def hashed(dim: int) -> Embedder:
    """The offline embedder, a hashed bag of words. It has no prefix: every word counts alike."""
    return Embedder(dim, hashed_embedding(dim))


_loaded: dict[str, Model] = {}


def model(name: str, load: Callable[[], Model], dim: int, query_prefix: str = "") -> Embedder:
    """An embedder that runs a model. `name` (with its revision) tells models of one worker apart."""

    @F.arrow_udf(T.ArrayType(T.ByteType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from gleanery.functions import embedder as here  # the worker's own module, which outlives the task

        if name not in here._loaded:
            here._loaded[name] = load()
        for texts in batches:
            yield here.packed(here._loaded[name](["" if t is None else t for t in texts.to_pylist()]), len(texts), dim)

    return Embedder(dim, embed, query_prefix)


def packed(found: np.ndarray, rows: int, dim: int) -> pa.ListArray:
    """Unit length, then signed bytes; a zero vector stays zero."""
    vectors = np.asarray(found, np.float64).reshape(rows, -1) if rows else np.zeros((0, dim))
    if vectors.shape != (rows, dim):
        raise ValueError(f"the embedder gave {vectors.shape[1]} components where {dim} are needed")
    if not np.isfinite(vectors).all():
        raise ValueError("the embedder gave a value that is no finite number")
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    bytes_ = np.clip(np.rint(unit * INT8_SCALE), -INT8_SCALE, INT8_SCALE).astype(np.int8)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * dim, dim, dtype=np.int32)), pa.array(bytes_.reshape(-1)))


def missing(dim: int) -> Embedder:
    """Stands where no model is at hand: any use of its vectors is an error, with nothing to load."""
    what = F.raise_error(F.lit("no embedding model is configured")).cast("array<tinyint>")
    return Embedder(dim, lambda text: F.when(text.isNotNull() | text.isNull(), what))
