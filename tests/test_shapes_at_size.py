"""Work on shapes that has to stay even and bounded as tables grow."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import geometry as G

RING = "array<struct<x:double,y:double>>"


def parts(folder, n):
    """A part table of n rows in one row group."""
    k = range(n)
    cols = {"p_partkey": pa.array(k, pa.int64()), "p_name": [f"part {i}" for i in k], "p_brand": [f"Brand#{i % 25}" for i in k], "p_size": pa.array([i * 7 % 50 + 1 for i in k], pa.int32()), "p_retailprice": [900.0 + i % 1000 / 10 for i in k]}
    pq.write_table(pa.table(cols), f"{folder}/part.parquet", row_group_size=n)
    return str(folder)


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    return parts(tmp_path_factory.mktemp("wide"), 25_000)


def tasks(df):
    """How many tasks the last stage has, and the most rows of one."""
    n = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    return len(n), max(n)


def test_overhang_of_a_long_edge(spark):
    # sampled every 0.05 such an edge has more points than an array holds
    row = [([(0.0, 0.0), (4e9, 3e9), (0.0, 5.0)], [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)])]
    got = spark.createDataFrame(row, f"p {RING}, q {RING}").select(G.overhang(F.col("p"), F.col("q")).alias("o")).first()
    assert got.o == pytest.approx(((4e9 - 9) ** 2 + (3e9 - 9) ** 2) ** 0.5)


def test_which_rings_are_convex(spark):
    star = [(0.0, 3.0), (2.0, -3.0), (-3.0, 1.0), (3.0, 1.0), (-2.0, -3.0)]
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [(0, square), (1, square[::-1]), (2, [*square, square[0]]), (3, square * 2), (4, star), (5, [*square, (1.0, 1.0)])]
    got = spark.createDataFrame(rows, f"i int, r {RING}").select("i", G.convex(G.edges(F.col("r"))).alias("c")).collect()
    assert {r.i: r.c for r in got} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False}


def test_layer_containment_is_spread(spark, wide):
    import __spark_entry__ as entry

    n, most = tasks(entry.queries()["layer_containment"](spark, wide))
    assert n == 3 and most < 10_000


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ring_overlaps_broadcasts_no_rings(spark, wide):
    import __spark_entry__ as entry

    df = entry.queries()["ring_overlaps"](spark, wide)
    assert "BroadcastHashJoin" not in joins(df) and "BroadcastExchange" not in joins(df)


def test_shared_area_far_from_the_origin(spark):
    at = lambda ring: [(x + 180_000.0, y + 650_000.0) for x, y in ring]
    box, dart = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (5.0, 2.0), (1.0, 3.0), (2.0, 2.0)]
    over, apart = [(0.0, 3.0), (4.0, 3.0), (4.0, 9.0), (0.0, 9.0)], [(0.0, 5.0), (4.0, 5.0), (2.0, 9.0)]
    rows = [(0, at(box), at(box[::-1])), (1, at(box), at(over)), (2, at(box), at(apart)), (3, at(box), at(dart)), (4, at([*box, box[0]]), at(dart[::-1]))]
    got = {r.i: r.s for r in spark.createDataFrame(rows, f"i int, p {RING}, q {RING}").select("i", G.intersection_area(F.col("p"), F.col("q")).alias("s")).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([16.0, 4.0, 0.0, 2.75, 2.75], abs=1e-9)


@pytest.mark.parametrize("name", ["polygon_area_contains"])
def test_rows_of_one_row_group_are_spread(spark, wide, name):
    import __spark_entry__ as entry

    n, most = tasks(entry.queries()[name](spark, wide))
    assert n == 3 and most < 10_000


@pytest.mark.parametrize("name", ["drawing_geometry"])
def test_groups_are_measured_after_rows_are_spread(spark, wide, name):
    import __spark_entry__ as entry

    assert "hashpartitioning(p_partkey" in joins(entry.queries()[name](spark, wide))


def test_plot_overlaps_broadcasts_no_boxes(spark, wide):
    import __spark_entry__ as entry

    plan = joins(entry.queries()["plot_overlaps"](spark, wide))
    assert "BroadcastHashJoin" not in plan and "hashpartitioning(p_partkey" in plan


def test_parts_on_drawings_meet_their_rings_without_a_join(spark, wide):
    from gaugeline.plans import scans

    df = scans.placed(spark, wide)
    n, most = tasks(df)
    assert "Join" not in joins(df) and n == 3 and most < 10_000


def test_pairs_of_a_drawing_come_without_a_join(spark, tmp_path):
    from gaugeline.sources import drawings as D

    (tmp_path / "drawing=1").mkdir()
    (tmp_path / "drawing=1/a.txt").write_text("  0\nLINE\n  8\n\n 10\n1.5\n  0\n")
    df = D.pairs(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in df.orderBy("place").collect()] == [(1, 0, "LINE"), (3, 8, ""), (5, 10, "1.5")]
    assert "SortMergeJoin [drawing" not in joins(df)


def test_rings_of_drawings_are_spread(spark, wide):
    from gaugeline.plans import shapes

    n, most = tasks(shapes.rings(spark, wide))
    assert n == 3 and most < 10_000


def test_edges_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from gaugeline.operators import overlay

    monkeypatch.setattr(overlay, "EDGES", 50, raising=False)
    k = F.col("id").cast("double")
    box = F.array(*(F.struct((k * 3 + x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (5.0, 0.5), (4.0, 4.0), (1.0, 5.0))))
    rings = spark.range(200).select(F.floor(F.col("id") / 2).alias("drawing"), F.lit("p").alias("layer"), box.alias("ring"))
    strips = overlay.strips(overlay.cells(rings), ["p"])
    n, _ = tasks(strips)
    assert n >= 200 * 4 // 50  # 4 by the session's number of partitions
    assert strips.agg(F.sum(F.col("area") * F.col("n_p"))).first()[0] == pytest.approx(200 * 17.0)


def sent(spark):
    """Rows of all shuffles so far."""
    none = spark._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lines_of_drawings_are_not_sent(spark, tmp_path):
    from gaugeline.sources import drawings as D

    own = "".join(f"  0\nLINE\n  8\nfront\n 10\n{i}\n 20\n2\n" for i in range(500))
    for i in range(3):
        (tmp_path / f"{i}.dxf").write_text(f"  0\nSECTION\n  2\nENTITIES\n{own}  0\nENDSEC\n")
    before = sent(spark)
    assert len(D.entities(spark, str(tmp_path)).collect()) == 1500
    assert sent(spark) - before < 100


def test_drawings_are_dealt_to_tasks_by_their_parts(spark, wide, monkeypatch, tmp_path):
    from gaugeline.plans import scans
    from gaugeline.sources import tables

    monkeypatch.setattr(tables, "SHAPES", 1000)
    monkeypatch.setattr(scans, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(scans.D, "entities", lambda s, _: s.range(1))
    scans.drawn(spark, wide)
    files = [f.name for f in tmp_path.glob("drawings-*/drawing=*/part-*")]
    assert len(files) == 250 and len({f[:10] for f in files}) > 20
    lines = next(iter(tmp_path.glob("drawings-*/drawing=7/part-*"))).read_text().splitlines()
    assert lines[:4] == ["  0", "SECTION", "  2", "BLOCKS"] and lines[-4:] == ["  0", "ENDSEC", "  0", "EOF"] and [x for x in lines if x[:1] == "7" and len(x) == 3 and x.isdigit()] == [str(k) for k in range(700, 800) if k % 10 < 9]


def test_boundaries_are_found_without_sending_lines(spark, wide):
    import __spark_entry__ as entry

    before = sent(spark)
    assert entry.queries()["drawing_boundary"](spark, wide).count() == 250
    assert sent(spark) - before < 6 * 25_000  # parts are dealt out a few times; they have over 60 lines each
