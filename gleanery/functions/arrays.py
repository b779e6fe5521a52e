"""Arrays that travel between tasks as compressed bytes, and where they go."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa


def packed(**arrays: pa.Array) -> bytes:
    """Arrays of any lengths as compressed bytes."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays.values()]
    batch = pa.RecordBatch.from_arrays(lists, names=list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {name: batch.column(name).values for name in batch.schema.names}


def narrow(values: np.ndarray) -> pa.Array:
    """Whole numbers from 0 in as few bytes as hold them."""
    return pa.array(values.astype(np.min_scalar_type(int(values.max(initial=0)))))


def wide(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def slices_of(paths: pa.Array, lines: pa.Array | None, n: int) -> np.ndarray:
    """The slice of each bag: by path, and by line where a path has many bags."""
    encoded = paths.dictionary_encode()
    codes = np.array([crc(p) for p in encoded.dictionary.to_pylist()], np.int64)[wide(encoded.indices)]
    if lines is not None:
        codes = codes + (wide(lines.fill_null(0)) * 2_654_435_761 >> 16)
    return codes % n
