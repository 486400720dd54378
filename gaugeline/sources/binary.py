"""Binary files as rows of bytes: shape records and picture headers, walked by offsets in Arrow batches.

A file is one value (spark.sql.sources.binaryFile.maxLength bounds it); what can't be read is an error of its own row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
SHAPES = "file string, record long, kind int, x0 double, y0 double, x1 double, y1 double, parts array<array<struct<x:double,y:double>>>, error string"
#: Kinds of shape records: none, point, lines, polygon.
NONE, DOT, LINES, POLYGON = 0, 1, 3, 5


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def records(file: str, data: bytes):
    """Rows of SHAPES.  Headers of the file and of records are big-endian, all else little-endian; lengths are of 16-bit words."""
    fault = lambda n, why: (file, n, None, None, None, None, None, None, why)
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        yield fault(None, "no shape file")
        return
    end, at = min(len(data), 2 * struct.unpack(">i", data[24:28])[0]), 100
    while at + 12 <= end:
        n, words = struct.unpack(">ii", data[at : at + 8])
        body = memoryview(data)[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0] if len(body) >= 4 else -1
        try:
            if words < 2 or len(body) != 2 * words:
                yield fault(n, "record is cut off")
                return
            if kind == NONE:
                yield (file, n, kind, None, None, None, None, [], None)
            elif kind == DOT:
                x, y = struct.unpack("<dd", body[4:20])
                yield (file, n, kind, x, y, x, y, [[(x, y)]], None)
            elif kind in (LINES, POLYGON):
                box = struct.unpack("<4d", body[4:36])
                parts, points = struct.unpack("<ii", body[36:44])
                begins = np.frombuffer(body, "<i4", parts, 44).tolist()
                xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2).tolist()
                yield (file, n, kind, *box, [[tuple(p) for p in xy[a:b]] for a, b in zip(begins, [*begins[1:], points], strict=True)], None)
            else:
                yield fault(n, f"kind {kind} is not read")
        except (struct.error, ValueError):
            yield fault(n, "record is cut off")
    if at < end:
        yield fault(None, "record is cut off")


def shape_records(contents: DataFrame) -> DataFrame:
    """SHAPES rows of all records of contents(file, content)."""
    kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.float64()] * 4, pa.list_(pa.list_(POINT)), pa.string()]
    names = [f.split()[0] for f in SHAPES.split(", ")]

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for row in records(file, data.as_py() or b""):
                    rows.append((*row[:7], row[7] and [[{"x": x, "y": y} for x, y in part] for part in row[7]] if row[7] is not None else None, row[8]))
                    if len(rows) >= 1000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return contents.select("file", "content").mapInArrow(run, SHAPES)


def reference_system(found: DataFrame, declared: DataFrame, bounds: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """(file, crs, assumed): what is declared(file, crs), or else the system in whose bounds (x0, x1, y0, y1) the lower
    left corner of the file's first record lies; null where none is."""
    first = found.where("error is null and x0 is not null").groupBy("file").agg(F.min(F.struct("record", "x0", "y0")).alias("f"))
    guess = F.lit(None).cast("string")
    for name, (x0, x1, y0, y1) in bounds.items():
        guess = F.coalesce(guess, F.when(F.col("f.x0").between(x0, x1) & F.col("f.y0").between(y0, y1), name))
    both = first.join(declared, "file", "left")
    return both.select("file", F.coalesce("crs", guess).alias("crs"), (F.col("crs").isNull() & guess.isNotNull()).alias("assumed"))


#: Markers of frame headers, and markers without a length.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset((0x01, *range(0xD0, 0xD9)))
END, SCAN = 0xD9, 0xDA


def segments(data: bytes):
    """(marker, body) of a JPEG's segments up to its picture's data; a body that is cut off is None."""
    rest = memoryview(data)[2:] if data[:2] == b"\xff\xd8" else memoryview(data)
    while len(rest) >= 2 and rest[0] == 0xFF:
        mark, rest = rest[1], rest[2:]
        while mark == 0xFF and len(rest):  # fill bytes
            mark, rest = rest[0], rest[1:]
        if mark in BARE:
            continue
        size = int.from_bytes(rest[:2], "big")
        whole = len(rest) >= 2 and len(rest) >= size
        yield mark, rest[2:size] if whole else None
        if not whole or mark in (END, SCAN):
            return
        rest = rest[size:]
    if len(rest) >= 2:
        yield None, rest


def frame_size(data: bytes) -> tuple[int | None, int | None, str | None]:
    """(width, height, error) from the first frame header."""
    for mark, body in segments(data):
        if mark is None:
            return None, None, "no marker where one should be"
        if mark in (END, SCAN):
            return None, None, "no frame header before the picture's data"
        if mark in FRAMES and body is not None and len(body) >= 5:
            return int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), None
    return None, None, "no frame header"


def picture_sizes(contents: DataFrame) -> DataFrame:
    """(file, width, height, error) of contents(file, content)."""

    def run(batches):
        for b in batches:
            wide, high, error = zip(*(frame_size(d.as_py() or b"") for d in b.column(1)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wide, pa.int32()), pa.array(high, pa.int32()), pa.array(error, pa.string())], names=["file", "width", "height", "error"])

    return contents.select("file", "content").mapInArrow(run, "file string, width int, height int, error string")
