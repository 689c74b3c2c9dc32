"""FITS images as a data source: ``spark.read.format("fits")``.

Option ``rows`` chooses between header cards (``headers``) and lines of pixels (``pixels``). Only what
is asked for is read: header rows read the blocks up to END, pixel rows the bytes of their lines. A
large image is many partitions, cut by byte range at lines; small files share one. Filters on the
path, the plane and the line reach the source, so files and lines that they leave out are not opened.
A file that is not a FITS image, or is cut short, is a row with ``problem`` and nothing else.

Files are opened through pyarrow, by plain path or by URI, in the tasks. The driver lists names and
sizes only.
"""

from __future__ import annotations

import fnmatch
import operator
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from skytable.sources.files import BLOCK, PIXEL_TYPES, _cards, _data_size

NAME = "fits"
HEADERS = "path string, seq int, key string, value string, bytes_read long, problem string"
PIXELS = "path string, plane int, y int, row array<float>, problem string"
FILES = ("*.fits", "*.fit", "*.fz")
#: Bytes of pixels of one partition, and of lines read at once.
PART_BYTES, READ_BYTES = 32 << 20, 4 << 20
#: Most bytes of a header: 400 blocks hold 14,400 cards. A longer one is a problem of that file.
HEADER_BYTES = 400 * BLOCK


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a plain path or a URI, and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Byte range of a file's pixels (from its first pixel on); -1 for all."""

    files: tuple[tuple[str, int, int], ...]


class _Counted:
    """A file that counts what is read of it."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        self.size, self.read = self.file.size(), 0

    def at(self, start: int, length: int) -> bytes:
        data = self.file.read_at(max(0, min(length, self.size - start)), start) if start < self.size else b""
        self.read += len(data)
        return data


def _header(file: _Counted, start: int) -> tuple[list[tuple[str, str | None]], int]:
    """Cards of the header at ``start`` and where its data begins, read block by block."""
    data = b""
    while True:
        more = file.at(start + len(data), BLOCK)
        data += more
        try:
            cards, end = _cards(data, 0)
            return cards, start + end
        except ValueError:
            if len(more) < BLOCK or len(data) >= HEADER_BYTES or (start == 0 and data[:6] != b"SIMPLE"):
                raise


def image_header(file: _Counted) -> list[tuple[str, str | None]]:
    """Cards of the image header; those of a compressed image follow the primary's and win."""
    cards, at = _header(file, 0)
    head = dict(cards)
    while int(head.get("NAXIS") or 0) == 0 and at < file.size:
        more, start = _header(file, at)
        extension = dict(more)
        if extension.get("XTENSION") == "BINTABLE" and extension.get("ZIMAGE") == "true":
            return list({**head, **extension}.items())
        at = start + _data_size(extension)
    return list(head.items())


@dataclass
class Layout:
    """Where the lines of an image lie, and how their numbers are scaled."""

    start: int
    kind: str
    width: int
    height: int
    planes: int
    scale: float
    zero: float
    whole: float

    @property
    def line(self) -> int:
        return np.dtype(self.kind).itemsize * self.width


def layout(file: _Counted) -> Layout:
    cards, at = _header(file, 0)
    h = dict(cards)
    bits, axes = int(h.get("BITPIX") or 0), int(h.get("NAXIS") or 0)
    if bits not in PIXEL_TYPES or axes not in (2, 3):
        raise ValueError("no image of two or three axes in the first part")
    found = Layout(at, PIXEL_TYPES[bits], int(h["NAXIS1"] or 0), int(h["NAXIS2"] or 0), int(h.get("NAXIS3") or 1) if axes == 3 else 1,
                   float(h.get("BSCALE") or 1), float(h.get("BZERO") or 0), float(2 ** bits - 1) if bits > 0 else 1.0)
    if file.size < at + found.line * found.height * found.planes:
        raise ValueError("the pixels end before the last line")
    return found


_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b}


class FitsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pixels = options.get("rows", "headers") == "pixels"
        self.folder = options["path"]
        self.globs = tuple(g.strip() for g in options["glob"].split(",")) if "glob" in options else FILES
        self.part = int(options.get("part_bytes", PART_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on whole files and lines; Spark still applies them, so that problems are judged alike."""
        for f in filters:
            if type(f) in _COMPARE and f.attribute in (("path",), ("plane",), ("y",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f

    def _passes(self, column: str, value: object) -> bool:
        return all(_COMPARE[kind](value, wanted) for c, kind, wanted in self.tests if c == column)

    def _lines(self, wanted: Sequence[int], column: str) -> np.ndarray:
        return np.array([v for v in wanted if self._passes(column, v)], dtype=np.int64)

    def partitions(self) -> Sequence[Piece]:
        fs, root = file_system(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and any(fnmatch.fnmatch(f.base_name.lower(), g.lower()) for g in self.globs) and self._passes("path", f.path))
        out, some, held = [], [], 0
        for path, size in files:
            cost = size if self.pixels else BLOCK
            if self.pixels and size > self.part:
                out += [Piece(((path, a, a + self.part),)) for a in range(0, size, self.part)]
                continue
            some.append((path, 0, -1))
            held += cost
            if held >= self.part or len(some) >= 4096:
                out.append(Piece(tuple(some)))
                some, held = [], 0
        return out + [Piece(tuple(some))] if some else out or [Piece(())]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.folder)
        for path, a, b in partition.files:
            try:
                file = _Counted(fs, path)
                yield from (self._pixel_rows(file, path, a, b) if self.pixels else self._card_rows(file, path))
            except (ValueError, KeyError, OSError) as e:
                if a == 0:
                    yield self._problem(path, f"{type(e).__name__}: {e}")

    def _problem(self, path: str, why: str) -> pa.RecordBatch:
        schema = _PIXEL_SCHEMA if self.pixels else _HEADER_SCHEMA
        return pa.RecordBatch.from_pylist([{n: {"path": path, "problem": why}.get(n) for n in schema.names}], schema=schema)

    def _card_rows(self, file: _Counted, path: str) -> Iterator[pa.RecordBatch]:
        cards = image_header(file)
        n = len(cards)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([k for k, _ in cards], pa.string()), pa.array([v for _, v in cards], pa.string()),
                                          pa.array([file.read] * n, pa.int64()), pa.nulls(n, pa.string())], schema=_HEADER_SCHEMA)

    def _pixel_rows(self, file: _Counted, path: str, a: int, b: int) -> Iterator[pa.RecordBatch]:
        at = layout(file)
        lines = self._lines(range(at.height), "y")
        for plane in self._lines(range(at.planes), "plane").tolist():
            # lines lie bottom up in the file; a line belongs to the partition that holds its first byte
            places = at.line * (plane * at.height + at.height - 1 - lines)
            mine = lines[(places >= a) & ((places < b) | (b < 0))]
            if not len(mine):
                continue
            for some in np.split(mine, np.arange(1, len(mine))[(np.diff(mine) != 1) | (np.arange(1, len(mine)) % max(1, READ_BYTES // max(1, at.line)) == 0)]):
                first = at.start + at.line * (plane * at.height + at.height - 1 - int(some[-1]))
                raw = np.frombuffer(file.at(first, at.line * len(some)), dtype=at.kind).reshape(len(some), at.width)[::-1]
                v = ((raw.astype(np.float64) * at.scale + at.zero) / at.whole).astype(np.float32)
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * at.width)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array(np.full(len(some), plane, np.int32)), pa.array(some.astype(np.int32)),
                                                  pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))), pa.nulls(len(some), pa.string())], schema=_PIXEL_SCHEMA)


_HEADER_SCHEMA = pa.schema([("path", pa.string()), ("seq", pa.int32()), ("key", pa.string()), ("value", pa.string()), ("bytes_read", pa.int64()), ("problem", pa.string())])
_PIXEL_SCHEMA = pa.schema([("path", pa.string()), ("plane", pa.int32()), ("y", pa.int32()), ("row", pa.list_(pa.float32())), ("problem", pa.string())])


class FitsSource(DataSource):
    """``path`` (a folder tree), ``rows`` (headers or pixels), ``glob`` (patterns, by commas), ``part_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PIXELS if self.options.get("rows", "headers") == "pixels" else HEADERS

    def reader(self, schema: object) -> FitsReader:
        return FitsReader(dict(self.options))


def _read(spark: SparkSession, folder: str, rows: str, **options: object) -> DataFrame:
    spark.dataSource.register(FitsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).options(rows=rows, **options).load(folder)


def fits_headers(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Header cards of every FITS file of a folder tree: ``path``, ``seq``, ``key``, ``value``, ``bytes_read`` of the file, ``problem``."""
    return _read(spark, folder, "headers", **options)


def fits_pixels(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Lines of every FITS image of a folder tree, top line first: ``path``, ``plane``, ``y``, ``row``, ``problem``. Integers are scaled to 0..1."""
    return _read(spark, folder, "pixels", **options)


def register_line_function(spark: SparkSession, name: str = "line_pixels") -> None:
    """A table function for SQL on Arrow batches: a table of (image, plane, y, row) in, one row a pixel (image, plane, y, x, v) out."""
    @F.arrow_udtf(returnType="image string, plane int, y int, x int, v float")
    class Pixels:
        def eval(self, lines: pa.RecordBatch):  # noqa: ANN201
            rows = lines.column("row")
            sizes = np.asarray(pa.compute.list_value_length(rows).fill_null(0), dtype=np.int64)
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            x = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.table({"image": lines.column("image").take(of), "plane": lines.column("plane").take(of), "y": lines.column("y").take(of),
                            "x": pa.array(x.astype(np.int32)), "v": pa.compute.list_flatten(rows)})
    spark.udtf.register(name, Pixels)
