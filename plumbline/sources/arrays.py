"""Array files by ranges: .npy, members of .npz, idx and fixed-size records, read by as many tasks as their bytes need."""

from __future__ import annotations

import fnmatch
import io
import json
import math
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StructType

#: Bytes of a partition, and of an Arrow batch, unless one row has more.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Type codes of idx files.
IDX_TYPES = {0x08: ">u1", 0x09: ">i1", 0x0B: ">i2", 0x0C: ">i4", 0x0D: ">f4", 0x0E: ">f8"}
KINDS = ("npy", "npz", "idx", "records")


@dataclass(frozen=True)
class Layout:
    """Where the rows of a file are: ``count`` rows of ``row_bytes`` from ``offset`` on; without a type they are plain bytes."""

    offset: int
    count: int
    row_bytes: int
    dtype: str | None
    deflated: bool = False


def npy_layout(head: bytes) -> Layout:
    f = io.BytesIO(head)
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if dtype.hasobject or dtype.fields:
        raise ValueError(f"arrays of {dtype} can't be read by ranges")
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order can't be read by ranges of rows")
    if not shape:
        raise ValueError("a single number has no rows")
    return Layout(f.tell(), shape[0], dtype.itemsize * math.prod(shape[1:]), dtype.str)


def idx_layout(head: bytes) -> Layout:
    zero, code, dims = struct.unpack(">HBB", head[:4])
    if zero or code not in IDX_TYPES or not dims:
        raise ValueError("not an idx file")
    shape = struct.unpack(f">{dims}I", head[4 : 4 + 4 * dims])
    return Layout(4 + 4 * dims, shape[0], np.dtype(IDX_TYPES[code]).itemsize * math.prod(shape[1:]), IDX_TYPES[code])


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address (local, s3, gs, hdfs) and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    local = path[5:] if path.startswith("file:") else path
    return pafs.LocalFileSystem(), local


def fits(name: str, pattern: str) -> bool:
    """Whether a file name fits a glob pattern with at most one ``{a,b}`` in it."""
    before, brace, rest = pattern.partition("{")
    if not brace:
        return fnmatch.fnmatchcase(name, pattern)
    choices, _, after = rest.partition("}")
    return any(fnmatch.fnmatchcase(name, before + c + after) for c in choices.split(","))


def listed(paths: Sequence[str], pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files, and of those below the folders whose name fits, in order; hidden files are left out."""
    found = []
    for path in paths:
        store, inner = store_of(path)
        info = store.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.is_file:
            found.append((path, info.size))
            continue
        below = store.get_file_info(pafs.FileSelector(inner, recursive=True))
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        found += sorted((prefix + f.path, f.size) for f in below if f.is_file and not f.base_name.startswith(".") and fits(f.base_name, pattern))
    return found


def _stored(store: pafs.FileSystem, inner: str, member: str) -> Layout:
    """Layout of an array in a .npz: plain members are read by ranges like files, deflated ones in one task as a stream."""
    with store.open_input_file(inner) as f:
        with zipfile.ZipFile(f) as z:
            entry = z.getinfo(member + ".npy")
            with z.open(entry) as m:
                layout = npy_layout(m.read(1 << 16))
        if entry.compress_type != zipfile.ZIP_STORED:
            return replace(layout, deflated=True)
        name, extra = struct.unpack("<HH", f.read_at(4, entry.header_offset + 26))
        return replace(layout, offset=entry.header_offset + 30 + name + extra + layout.offset)


def layout_of(path: str, size: int, kind: str, member: str | None = None, header: int = 0, record: int = 0) -> Layout:
    if kind == "records":
        if record < 1:
            raise ValueError("records need a size")
        return Layout(header, max(0, size - header) // record, record, None)
    store, inner = store_of(path)
    if kind == "npz":
        return _stored(store, inner, member or "arr_0")
    with store.open_input_file(inner) as f:
        head = f.read_at(min(size, 1 << 16), 0)
    return npy_layout(head) if kind == "npy" else idx_layout(head)


# ---------------------------------------------------------------- draws without excluded positions


def permuted(at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1 at the places ``at``: four Feistel rounds, walked on until they fall below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift, out = np.uint64(half), at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in range(4):
            h = (right + np.uint64((seed * 0x9E3779B97F4A7C15 + k + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def drawn(at: np.ndarray, n: int, excluded: np.ndarray, seed: int) -> np.ndarray:
    """Positions of the draws ``at`` (0 .. n - excluded - 1) out of n records: none excluded, none twice, each by itself."""
    excluded = np.unique(excluded[(excluded >= 0) & (excluded < n)])
    place = permuted(at, n - len(excluded), seed)
    return place + np.searchsorted(excluded - np.arange(len(excluded)), place, side="right")


# ---------------------------------------------------------------- the source


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    first: int
    count: int
    draw: bool = False


class RangedArrays(DataSource):
    """(path, pos, values): rows of the first axis. A schema without ``values`` reads headers only; ``values`` as BINARY has the bytes."""

    @classmethod
    def name(cls) -> str:
        return "ranged_arrays"

    def schema(self) -> str:
        return "path string, pos bigint, values array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangedReader(dict(self.options), schema)


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        strange = set(schema.names) - {"path", "pos", "values"}
        if strange:
            raise ValueError(f"unknown columns {sorted(strange)}")
        self.options, self.schema = options, schema

    def partitions(self) -> list[Range]:
        o, out = self.options, []
        low, high = int(o.get("first", 0)), int(o.get("end", 1 << 62))
        for path, size in listed(json.loads(o["paths"]), o.get("pattern", "*")):
            layout = layout_of(path, size, o.get("kind", "npy"), o.get("member"), int(o.get("header", 0)), int(o.get("record", 0)))
            many = max(1, int(o.get("bytes", PARTITION_BYTES)) // max(1, layout.row_bytes))
            draws = o.get("draws")
            if draws is not None:
                allowed = layout.count - len(self._excluded(layout.count))
                begin, end = 0, min(int(draws), allowed) if int(draws) >= 0 else allowed
            else:
                begin, end = max(0, low), min(layout.count, high)
            if layout.deflated:
                many = max(1, end - begin)
            out += [Range(path, layout, k, min(many, end - k), draws is not None) for k in range(begin, end, many)]
        return out

    def _excluded(self, n: int) -> np.ndarray:
        """Positions in the file ``excluded``, which counts from 1, a line each; they are few against the records."""
        path = self.options.get("excluded")
        if not path:
            return np.zeros(0, np.int64)
        store, inner = store_of(path)
        with store.open_input_stream(inner) as f:
            at = np.array(f.read().split(), np.int64) - 1
        return np.unique(at[(at >= 0) & (at < n)])

    def _chunks(self, part: Range) -> Iterator[tuple[np.ndarray, bytes | None]]:
        """(positions, bytes of these rows); without values nothing is read."""
        layout, many = part.layout, max(1, BATCH_BYTES // max(1, part.layout.row_bytes))
        if part.draw:
            places = drawn(np.arange(part.first, part.first + part.count), layout.count, self._excluded(layout.count), int(self.options.get("seed", 0)))
        wanted = "values" in self.schema.names
        store, inner = store_of(part.path)
        with store.open_input_file(inner) if wanted else io.BytesIO() as f:
            stream = None
            if wanted and layout.deflated:
                stream = zipfile.ZipFile(f).open(self.options.get("member", "arr_0") + ".npy")
                left = layout.offset + part.first * layout.row_bytes
                while left:
                    left -= len(stream.read(min(left, BATCH_BYTES)))
            for k in range(0, part.count, many):
                n = min(many, part.count - k)
                if part.draw:
                    at = places[k : k + n]
                    yield at, b"".join(f.read_at(layout.row_bytes, layout.offset + int(p) * layout.row_bytes) for p in at) if wanted else None
                else:
                    at = np.arange(part.first + k, part.first + k + n)
                    size = n * layout.row_bytes
                    yield at, (stream.read(size) if stream else f.read_at(size, layout.offset + int(at[0]) * layout.row_bytes)) if wanted else None

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's stand-in where there are no partitions
            return
        fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in self.schema.fields]
        for at, raw in self._chunks(part):
            n, made = len(at), []
            for field, kind in zip(fields, self.schema.fields):
                if field.name == "path":
                    made.append(pa.array([part.path] * n, field.type))
                elif field.name == "pos":
                    made.append(pa.array(at, pa.int64()).cast(field.type))
                elif len(raw) != n * part.layout.row_bytes:
                    raise ValueError(f"{part.path} ends before its last row")
                elif isinstance(kind.dataType, BinaryType):
                    ends = pa.py_buffer((np.arange(n + 1) * part.layout.row_bytes).astype(np.int32))
                    made.append(pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(raw)]))
                else:
                    flat = np.frombuffer(raw, part.layout.dtype or "u1")
                    width = len(flat) // n if n else 0
                    values = pa.array(flat.astype(field.type.value_type.to_pandas_dtype()))
                    made.append(pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * width).astype(np.int32)), values).cast(field.type))
            yield pa.RecordBatch.from_arrays(made, schema=pa.schema(fields))


def array_rows(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    kind: str = "npy",
    pattern: str = "*",
    member: str | None = None,
    header: int = 0,
    record: int = 0,
    schema: str = "path string, pos bigint, values array<double>",
    first: int = 0,
    end: int | None = None,
    partition_bytes: int = PARTITION_BYTES,
    draws: int | None = None,
    excluded: str | None = None,
    seed: int = 0,
) -> DataFrame:
    """(path, pos, values) of the rows of array files: ``kind`` npy, npz (a ``member``), idx, or records of ``record`` bytes after a ``header``.

    A file is cut into ranges of about ``partition_bytes``, whatever its size; a task parses nothing but its own range. ``schema``
    names the columns that are wanted and the type of the values: arrays of numbers, or BINARY for their bytes as they are.
    Rows from ``first`` up to ``end`` are read, or ``draws`` of them (all that are allowed if below 0) in a shuffled order of ``seed``
    that leaves out the positions in the file ``excluded``: no position comes twice, and each draw is found by itself.

    * empty arrays and folders without files: no rows; bytes after the last whole record are left out;
    * arrays of objects, in column order, or without an axis raise; so does a file that ends early;
    * deflated members are one stream, and so one task a member.

    Files must be in a store that Arrow opens (local or mounted folders, S3, GCS, HDFS). For those that only Spark opens,
    see ``files.npy_rows``.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    spark.dataSource.register(RangedArrays)
    given = {"kind": kind, "pattern": pattern, "member": member, "header": header, "record": record, "first": first, "end": end, "bytes": partition_bytes, "draws": draws, "excluded": excluded, "seed": seed}
    reader = spark.read.format("ranged_arrays").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    for k, v in given.items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.schema(schema).load()
