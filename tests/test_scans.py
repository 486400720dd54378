"""Drawings, shape files and pictures read from files."""

import struct

import pytest
from pyspark.sql import functions as F

from gaugeline.sources import binary as B
from gaugeline.sources import drawings as D

DRAWING = """999
made by hand
  0
SECTION
  2
BLOCKS
  0
LWPOLYLINE
  8
outline
 70
1
 10
0
 20
0
 10
99
 20
0
 10
99
 20
99
  0
ENDSEC
  0
SECTION
  2
ENTITIES
{own}  0
ENDSEC
  0
EOF
"""


def poly(layer, closed, *xy):
    return f"  0\nLWPOLYLINE\n  8\n{layer}\n 70\n{int(closed)}\n" + "".join(f" 10\n{x}\n 20\n{y}\n" for x, y in xy)


def test_drawings_in_small_splits(spark, tmp_path):
    own = poly("outline", True, (0, 0), (4, 0), (4, 4), (0, 4)) + poly("outline", False, (0, 0), (9, 0), (9, 9)) + poly("outline", False, (0, 0), (5, 0), (5, 5), (0, 0.0004)) + "  0\nLINE\n  8\nfront\n 10\n1\n 20\n2\n 11\n3\n 21\n4\n"
    own += "  0\nPOLYLINE\n  8\nold\n 10\n0\n 20\n0\n 70\n1\n" + "".join(f"  0\nVERTEX\n  8\nold\n 10\n{x}\n 20\n{y}\n 70\n0\n" for x, y in ((1, 1), (3, 1), (2, 5))) + "  0\nSEQEND\n"
    own += "  0\nINSERT\n  8\nmark\n  2\nroom\n 10\n1.5\n 20\n2.5\n  0\nATTRIB\n  1\n 12 \n  2\nuse\n  0\nATTRIB\n  1\n13\n  2\nUSE\n  0\nSEQEND\n  0\nINSERT\n  8\nmark\n  2\nbare\n 10\nx\n 20\n1\n"
    for i in range(6):
        (tmp_path / f"d{i}.dxf").write_text(DRAWING.format(own=own * (1 + i)).replace("\n", "\r\n" if i % 2 else "\n"), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    found = D.entities(spark, f"file://{tmp_path}/*.dxf").cache()
    got = found.groupBy("drawing").pivot("type").count().collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.drawing[-5]: (r.LWPOLYLINE, r.LINE, r.POLYLINE, r.INSERT) for r in got} == {str(i): (3 * (i + 1), i + 1, i + 1, 2 * (i + 1)) for i in range(6)}
    one = found.where("drawing like '%d0.dxf'")
    shapes = [(r.type, r.layer, r.closed, [(p.x, p.y) for p in r.ring]) for r in D.shapes(one.where("type <> 'INSERT'")).orderBy("entity").collect()]
    assert [s[2] for s in shapes] == [True, False, True, False, True] and shapes[4][3] == [(1, 1), (3, 1), (2, 5)] and shapes[3][3] == [(1, 2), (3, 4)]
    blocks = [(r.block, r.x, r.y, r.attributes) for r in D.blocks(one).orderBy("entity").collect()]
    assert blocks == [("room", 1.5, 2.5, {"USE": "13"}), ("bare", None, 1.0, {})]
    edge = D.boundary(one, "outline").collect()
    assert len(edge) == 1 and edge[0].area == pytest.approx(16) and D.boundary(one, "nothing").count() == 0


@pytest.mark.parametrize("size", [1, 11, 64])
def test_entities_across_splits(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(D, "staged", lambda df, _: spark.createDataFrame(df.collect(), df.schema))
    own = poly("outline", True, (0, 0), (4, 0), (4, 4)) + "  0\nPOLYLINE\n  8\n0\n" + "".join(f"  0\nVERTEX\n 10\n{x}\n 20\n0\n" for x in range(4)) + "  0\nSEQEND\n  0\nINSERT\n  2\n\n 70\n0\n"
    (tmp_path / "a.dxf").write_text("999\n0\n  0\nSECTION\n  2\nENTITIES\n" + own + "  0\nENDSEC\n  0\nSECTION\n  2\nENTITIES\n  0\nLINE\n  0\nENDSEC\n  0\nSECTION\n  2\nENTITIES\n  0\nCIRCLE\n 10\n")
    (tmp_path / "b.dxf").write_text("  0\nSECTION\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = [sorted(map(tuple, read(spark, str(tmp_path)).collect())) for read in (D.entities, D.pairs)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    split = [sorted(map(tuple, read(spark, str(tmp_path)).collect())) for read in (D.entities, D.pairs)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split == whole and [(r[1:5], [tuple(p) for p in r[5]][:2]) for r in whole[0]] == [
        ((2, 1, "LWPOLYLINE", "outline"), [(7, 0, "LWPOLYLINE"), (9, 8, "outline")]), ((3, 1, "POLYLINE", "0"), [(25, 0, "POLYLINE"), (27, 8, "0")]), ((4, 1, "INSERT", None), [(55, 0, "INSERT"), (57, 2, "")]), ((7, 6, "LINE", None), [(67, 0, "LINE")])]


def test_group_codes_are_read_as_by_a_cast(spark):
    texts = ["0", " 70 ", "00", "+5", "-1", "2147483647", "2147483648", "5.0", "1e1", "", "+", "x", "0x1", "1_0", "\t8", "\u0663"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").try_cast("int").alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [(t, D.group_code(t)) for t in texts]


def shp(*bodies):
    out = b"".join(struct.pack(">ii", n, len(b) // 2) + b for n, b in enumerate(bodies, 1))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(out) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + out


def test_shape_files(spark, tmp_path):
    outer, hole = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    flat = lambda *xy: b"".join(struct.pack("<2d", *p) for p in xy)
    polygon = struct.pack("<i4d4i", 5, 180000, 650000, 180009, 650009, 2, 9, 0, 5) + flat(*outer, *hole)
    (tmp_path / "a.shp").write_bytes(shp(polygon, struct.pack("<i2d", 1, 3, 4), struct.pack("<i", 0), struct.pack("<i", 31)))
    (tmp_path / "b.shp").write_bytes(shp(struct.pack("<i2d", 1, 3, 4), polygon)[:-10])
    (tmp_path / "c.shp").write_bytes(b"no shapes here")
    (tmp_path / "d.shp").write_bytes(shp())
    found = B.shape_records(B.files(spark, f"file://{tmp_path}/*.shp")).withColumn("file", F.substring("file", -5, 1)).cache()
    got = {(r.file, r.record): r for r in found.collect()}
    assert [[len(p) for p in got["a", 1].parts], got["a", 2].x0, got["a", 3].parts, got["a", 4].error] == [[5, 4], 3.0, [], "kind 31 is not read"]
    assert got["b", 1].error is None and got["b", 2].error == "record is cut off" and got["c", None].error == "no shape file" and not [k for k in got if k[0] == "d"]
    known = {r.file: (r.crs, r.assumed) for r in B.reference_system(found, spark.createDataFrame([("b", "EPSG:4326")], "file string, crs string"), {"EPSG:2039": (100_000, 300_000, 350_000, 800_000)}).collect()}
    assert known == {"a": ("EPSG:2039", True), "b": ("EPSG:4326", False)}


@pytest.mark.parametrize(("data", "want"), [
    (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08\x00\x05\x00\x07\x03abc", (7, 5, None)), (b"\xff\xd8\xff\xc4\x00\x04ab\xff\xda\x00\x02", (None, None, "no frame header before the picture's data")),
    (b"\xff\xd8\xff\xe0\x00\x04ab..", (None, None, "no marker where one should be")), (b"\xff\xd8", (None, None, "no frame header")), (b"", (None, None, "no frame header")), (b"\xff\xd8\xff\xe0\x00\x50ab", (None, None, "no frame header")),
])
def test_picture_headers(data, want):
    assert B.frame_size(data) == want
