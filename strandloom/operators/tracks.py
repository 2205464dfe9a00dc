"""A piece's numbers by base as one compressed cell: Spark stores and moves it as it is, Python opens it.

Arrays of arrays cost some 110 bytes a base of ten numbers each time that they
are shuffled, and most of the time goes into making them; a cell holds the
numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The column of cells.
PACKED = "packed"
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(tracks: list[np.ndarray]) -> bytes:
    """Matrices of equal length as a cell: how many they are, rows, bytes a number and widths, then all rows compressed."""
    kind = np.dtype(np.result_type(*tracks)).newbyteorder("<")
    rows = np.ascontiguousarray(np.concatenate(tracks, 1).astype(kind, copy=False))
    head = np.array([len(tracks), len(rows), kind.itemsize, *(t.shape[1] for t in tracks)], "<i4").tobytes()
    return head + _CODEC.compress(rows.tobytes(), asbytes=True)


def unpack(cell: bytes) -> list[np.ndarray]:
    """What pack was given."""
    many, rows, size = np.frombuffer(cell, "<i4", 3).tolist()
    widths = np.frombuffer(cell, "<i4", many, 12).tolist()
    data = _CODEC.decompress(pa.py_buffer(cell).slice(12 + 4 * many), rows * sum(widths) * size)
    whole = np.frombuffer(data, f"<f{size}").reshape(rows, sum(widths))
    ends = list(accumulate(widths))
    return [whole[:, end - width : end] for width, end in zip(widths, ends, strict=True)]


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows' arrays by base; those of a row have one length."""
    at, inner = column.offsets.to_numpy(), column.values.offsets.to_numpy()
    flat = column.values.values.to_numpy(zero_copy_only=False)
    return [flat[inner[a] : inner[b]].reshape(b - a, -1) for a, b in zip(at[:-1], at[1:], strict=True)]


def packed(pieces: DataFrame, tracks: tuple[str, ...]) -> DataFrame:
    """pieces with their tracks, arrays by base, as one cell; those without bases are left out. Packed pieces are as they are."""
    if PACKED in pieces.columns:
        return pieces
    kept = [c for c in pieces.columns if c not in tracks]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(arrays(batch.column(t)) for t in tracks), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([pack(list(own)) for own in each], pa.binary())], names=[*kept, PACKED])

    rows = pieces.where(F.length("seq") > 0).select(*kept, *tracks)
    return rows.mapInArrow(work, ", ".join([*(f"{n} {t}" for n, t in rows.select(*kept).dtypes), f"{PACKED} binary"]))
