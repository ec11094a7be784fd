"""Vectors of 16-bit floats: two bytes a component, rounded to the nearest, halves to even.

``rounded`` is the rounding as a column expression, ``pack`` and ``unpack`` the storage: a binary column of little-endian
IEEE 754 halves, in order. Components too large for a half (65,520 and up) become infinite, as the standard says, and a
vector that holds such a one, or a null, is packed as null. A null vector stays null, an empty one is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

LARGEST = 65504.0


def rounded(vector: Column | str) -> Column:
    """array<double> of the nearest halves; those beyond the largest are infinite."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def one(x: Column) -> Column:
        d = x.cast("double")
        # the spacing of halves around x; below 2**-14 it no longer shrinks
        spacing = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(d))), F.lit(-14)) - 10)
        near = F.when(d == 0, d).otherwise(F.rint(d / spacing) * spacing)
        return F.when(F.abs(near) > LARGEST, F.signum(d) * float("inf")).otherwise(near)

    return F.transform(v, one)


def pack_arrow(column: pa.Array) -> pa.Array:
    """Lists of numbers as binaries."""
    out = []
    for v in column:
        if not v.is_valid:
            out.append(None)
            continue
        values = np.array(v.values.to_numpy(zero_copy_only=False), np.float64)
        with np.errstate(over="ignore"):
            h = values.astype(np.float16)
        out.append(h.tobytes() if np.isfinite(h).all() else None)
    return pa.array(out, pa.binary())


def unpack_arrow(column: pa.Array, dim: int) -> np.ndarray:
    """Binaries of ``dim`` components each, none of them null, as rows of doubles."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data.view("<f2").astype(np.float64).reshape(len(column), dim)


def pack(df: DataFrame, vector: str, out: str = "packed") -> DataFrame:
    """df with the column ``out``: the vectors' halves."""
    names = df.columns
    at = names.index(vector)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pack_arrow(b.column(at))], [*names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, BinaryType())]))


def unpack(df: DataFrame, packed: str, out: str = "vector") -> DataFrame:
    """df with the column ``out``: array<float> of the packed halves."""
    names = df.columns
    at = names.index(packed)

    def run(batches):
        for b in batches:
            rows = [None if not x.is_valid else np.frombuffer(x.as_py(), "<f2").astype(np.float32) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float32()))], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")
