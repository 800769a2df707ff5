"""Array files (.npy) as tables, and tables as array files.

Files are read with Spark's ``binaryFile`` reader, so that any store that Spark reads will do; one
task parses one file (the reader takes files of up to 2 GB), any number of files side by side. A
missing file or a file that is no array raises an error that names it.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import ship

# Fixed value: the first bytes of an array file.
MAGIC = b"\x93NUMPY"
ROWS = 100_000  # values in a batch


def parse_header(content: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(type with its byte order, column-major, shape, first byte of the data) of an array file of
    format 1 to 3. Arrays of objects or of records are refused."""
    if content[:6] != MAGIC:
        raise ValueError("not an array file")
    major = content[6]
    if major not in (1, 2, 3):
        raise ValueError(f"array file of unknown format {major}")
    size, at = (struct.unpack_from("<H", content, 8)[0], 10) if major == 1 else (struct.unpack_from("<I", content, 8)[0], 12)
    fields = ast.literal_eval(content[at : at + size].decode("utf-8" if major == 3 else "latin-1"))
    dtype = np.dtype(fields["descr"])
    if dtype.hasobject or dtype.names or dtype.kind not in "iufb":
        raise ValueError(f"array file of type {fields['descr']}: only numbers are read")
    return dtype, bool(fields["fortran_order"]), tuple(fields["shape"]), at + size


def parse_array(content: bytes) -> np.ndarray:
    """The array of a file, in its own shape."""
    dtype, by_column, shape, at = parse_header(content)
    n = int(np.prod(shape, dtype=np.int64))
    if len(content) - at < n * dtype.itemsize:
        raise ValueError("array file that ends early")
    flat = np.frombuffer(content, dtype, n, at)
    return flat.reshape(shape, order="F" if by_column else "C")


def array_bytes(a: np.ndarray) -> bytes:
    """The file (format 1) of an array; its memory order is kept."""
    by_column = a.ndim > 1 and a.flags.f_contiguous and not a.flags.c_contiguous
    head = repr({"descr": a.dtype.str, "fortran_order": by_column, "shape": a.shape}).encode("latin-1")
    pad = -(10 + len(head) + 1) % 64
    head += b" " * pad + b"\n"
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(head)) + head + a.tobytes("F" if by_column else "C")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, descr, column_major, shape) of the array files under ``path`` (globs work)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [_of(p, parse_header, c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[0].str for h in heads], pa.string()), pa.array([h[1] for h in heads], pa.bool_()), pa.array([list(h[2]) for h in heads], pa.list_(pa.int64()))], names=["path", "descr", "column_major", "shape"])

    return _files(spark, path).mapInArrow(run, "path string, descr string, column_major boolean, shape array<bigint>")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, k, value double, whole bigint) of every value of the array files under ``path``, of
    up to three dimensions; indices of dimensions that an array lacks are 0. ``whole`` has integers
    in full, and is null for floats."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = _of(name, parse_array, content)
                if a.ndim > 3:
                    raise ValueError(f"{name}: more than three dimensions")
                a = a.reshape(a.shape + (1,) * (3 - a.ndim))
                flat = a.reshape(-1)
                for at in range(0, len(flat), ROWS):
                    part = flat[at : at + ROWS]
                    i, j, k = np.unravel_index(np.arange(at, at + len(part)), a.shape)
                    whole = pa.nulls(len(part), pa.int64()) if part.dtype.kind == "f" else pa.array(part.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), *(pa.array(x.astype(np.int64)) for x in (i, j, k)), pa.array(part.astype(np.float64)), whole], names=["path", "i", "j", "k", "value", "whole"])

    return _files(spark, path).mapInArrow(run, "path string, i bigint, j bigint, k bigint, value double, whole bigint")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").repartition(F.col("path"))


def _of(name: str, parse, content: bytes):  # noqa: ANN001, ANN202
    try:
        return parse(content)
    except (ValueError, SyntaxError, KeyError, struct.error) as e:
        raise ValueError(f"{name}: {e}") from e


def to_arrays(values: DataFrame, dtype: str = "<f8") -> DataFrame:
    """(name, content): the array file of each ``name`` of ``values(name, i, j, k, value)``; places
    without a value are 0. One task makes one file, which a caller saves where it is wanted."""
    ship(values.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        place = [table.column(c).to_numpy() for c in ("i", "j", "k")]
        shape = tuple(int(x.max()) + 1 for x in place)
        a = np.zeros(shape, dtype)
        a[tuple(place)] = table.column("value").to_numpy().astype(dtype)
        while a.ndim > 1 and a.shape[-1] == 1:
            a = a[..., 0]
        return pa.table({"name": table.column("name")[:1], "content": pa.array([array_bytes(np.ascontiguousarray(a))], pa.binary())})

    return values.select("name", "i", "j", "k", "value").groupBy("name").applyInArrow(run, "name string, content binary")
