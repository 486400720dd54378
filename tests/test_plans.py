"""Every registered query against its oracle; queries without one by their known rows."""

import pytest
from oracle import differences

from gaugeline.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf, name):
    assert not differences(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", ["best_evidence_argmax", "feedback_merge_last_wins", "critic_best_match", "verdicts_all_types"])
def test_best_rows_are_found_in_hash_tables(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_hebrew_cleanup(spark):
    from gaugeline.functions import text as X

    rows = spark.createDataFrame([("סעיף: א:ב 3מ", "תכ.נית"), ("abc:def", "12x")], "a string, b string")
    rows = rows.select(X.strip_between_hebrew(rows.a).alias("a"), X.strip_between_hebrew(rows.b).alias("b"), X.space_at_digit_borders(rows.a).alias("spaced"), rows.b.rlike(X.loose_pattern("תכנית")).alias("loose"), X.replacements(rows.a, [("a", "bb"), ("b", "")]).alias("hits")).collect()
    assert [r.a for r in rows] == ["סעיף: אב 3מ", "abc:def"]
    assert rows[0].b == "תכנית" and rows[0].loose and rows[0].spaced.endswith("3 מ") and not rows[1].loose
    assert [r.hits for r in rows] == [0, 4]  # one a, then the three b there are by then


def test_page_specs(spark):
    from gaugeline.sources.tables import page_numbers

    rows = spark.createDataFrame([("1,3-5,4", 9), ("all", 3), ("7-20", 9), ("x", 3)], "spec string, n int")
    got = {r.spec: r.pages for r in rows.select("spec", page_numbers(rows.spec, rows.n).alias("pages")).collect()}
    assert got == {"1,3-5,4": [1, 3, 4, 5], "all": [1, 2, 3], "7-20": None, "x": None}


def test_polygons(spark):
    from pyspark.sql import functions as F

    from gaugeline.operators import geometry as G

    rings = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (2, [(10.0, 0.0), (12.0, 0.0), (11.0, 2.0)]), (3, [(0.0, 0.0), (1.0, 1.0)])]
    r = spark.createDataFrame(rings, "id int, ring array<struct<x: double, y: double>>")
    other = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(20.0, 0.0), (21.0, 0.0), (21.0, 1.0)]))
    got = r.select("id", G.area(r.ring).alias("area"), G.contains(r.ring, F.lit(1.0), F.lit(1.0)).alias("has_point"), G.closed(r.ring).alias("closed"), G.distance(r.ring, other).alias("distance"), G.valid(r.ring).alias("valid")).collect()
    a, b, c = sorted(got)
    assert (a.area, b.area, a.has_point, b.has_point, a.closed) == (12.0, 2.0, True, False, False)
    assert a.distance == 16.0 and b.distance == 8.0 and (a.valid, b.valid, c.valid) == (True, True, False)
    circle = spark.range(1).select(G.area(G.circle(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("a")).first().a
    assert abs(circle - 3.136548) < 1e-6


def test_variant_paths(spark, sf):
    rows = QUERIES["variant_paths"](spark, sf).where("present").limit(5).collect()
    assert rows and all(r.absent is None for r in rows)


def test_chains_of_any_depth_null_titles_and_cycles(spark):
    from gaugeline.operators.tree import ancestor_chains, with_parents

    rows = [(i, i - 1 if i else None, None if i % 7 == 0 else f"t{i}") for i in range(200)] + [(300, 301, "a"), (301, 302, "b"), (302, 300, "c"), (303, 301, "d"), (400, 999, "lost"), (500, 500, "own")]
    nodes = spark.createDataFrame(rows, "id int, parent int, title string").repartition(3)
    up = {r[0]: r for r in rows}

    def chain(i):
        seen, out = set(), []
        while i in up and i not in seen:
            seen.add(i)
            out.append(up[i][2])
            i = up[i][1]
        return out[::-1]

    assert {r.id: r.chain for r in ancestor_chains(nodes).collect()} == {r[0]: chain(r[0]) for r in rows}
    assert ancestor_chains(nodes.where("1 = 0")).count() == 0
    got = {r.id: (r.parent, r.title) for r in with_parents(nodes, "section").collect()}
    assert got[999] == (None, "section") and len(got) == len(rows) + 1


def test_blocks_take_polygons_in_order(spark):
    from gaugeline.operators.matching import blocks_to_polygons

    box = lambda x, y, w=2.0: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    pols = spark.createDataFrame([(1, 10, box(0.0, 0.0)), (1, 11, box(0.0, 0.0, 4.0)), (1, 12, box(10.0, 10.0)), (2, 13, box(0.0, 0.0)), (3, 14, box(0.0, 0.0))], "drawing long, polygon long, ring array<struct<x double, y double>>")
    ins = spark.createDataFrame([(1, 3, 9.0, 9.0), (1, 1, 1.0, 1.0), (1, 2, 1.5, 1.5), (1, 4, 1.0, 1.0), (2, 5, 50.0, 50.0), (2, 6, 1.0, 1.0), (9, 7, 0.0, 0.0)], "drawing long, insert long, x double, y double")
    got = sorted(tuple(r) for r in blocks_to_polygons(ins, pols).collect())
    # the first box that holds it, then the next free one; the nearest free one; nothing left
    assert got == [(1, 1, 10, True), (1, 2, 11, True), (1, 3, 12, False), (2, 5, 13, False)]


def test_block_match_of_the_tables(spark, sf):
    rows = QUERIES["block_polygon_match"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/supplier.parquet").count() and len({r.polygon for r in rows}) == len(rows)


def test_numbers_run_over_range_partitions(spark):
    from pyspark.sql import functions as F

    from gaugeline.operators.dedup import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert all(r.place == r.k + 1 for r in numbered(df, [F.col("k")]).collect())
    assert numbered(df.where("1 = 0"), [F.col("k")]).count() == 0


def test_one_fault_leaves_other_rows(spark):
    from pyspark.sql import functions as F

    from gaugeline.functions import verdicts as V

    rows = spark.createDataFrame([(1, "5", "n"), (2, "five", "n"), (3, None, "n"), (4, "six", "n"), (5, "[1]", "n"), (6, "[2]", "n"), (7, "5", "other"), (8, "5", "m")], "id int, raw string, kind string").withColumn("x", F.col("raw").try_cast("double"))
    judged = F.when(F.col("x").isNull(), V.outcome("unevaluable", "missing_data")).otherwise(V.outcome("pass"))
    faults = [(F.startswith("raw", F.lit("[")), "TypeError", F.lit("a list")), (F.col("raw").isNotNull() & F.col("x").isNull(), "ValueError", F.concat(F.lit("not a number: "), "raw"))]
    o = V.dispatch_attempts(F.col("kind"), {"n": V.attempt(judged, faults), "m": V.attempt(judged, [])})
    got = {r.id: tuple(r.o) for r in rows.select("id", o.alias("o")).collect()}
    assert got[1] == got[8] == ("pass", "none", "high", None) and got[3] == ("unevaluable", "missing_data", "high", None)
    assert got[2][:3] == got[4][:3] == got[5][:3] == ("unevaluable", "engine_error", "high") and got[7][1] == "ambiguous_rule"
    prints = [got[i][3] for i in (2, 4, 5, 7)]
    assert len(set(prints)) == 4 and all(len(p) == 16 for p in prints) and got[5] == got[6]


def test_three_kinds_of_fault_in_one_run(spark, sf):
    import __spark_entry__ as entry

    rows = entry.queries()["isolated_faults"](spark, sf).where("failure_mode in ('engine_error', 'ambiguous_rule') and fingerprint is not null").groupBy("rule_id", "fingerprint").count().collect()
    by_rule = {}
    for r in rows:
        by_rule.setdefault(r.rule_id, set()).add(r.fingerprint)
    assert len(by_rule["F1"]) == 3 and by_rule["F1"] == by_rule["F2"] and len(by_rule["F3"]) == len(by_rule["F4"]) == 1
    assert len(set.union(*by_rule.values())) == 5


def test_cache_computes_once_and_overrides_win(spark, tmp_path):
    from pyspark.sql import functions as F

    from gaugeline.operators import cache as C

    folder, schema, asked = f"file://{tmp_path}/c", "key string, n long", []

    def compute(d):
        asked.append(d.count())
        return d.select("key", F.length("payload").cast("long").alias("n"))

    some = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "yy", 3), (None, "z", 4)], "key string, payload string, n int")
    more = spark.createDataFrame([("a", "x"), ("b", "yy"), ("c", "zzz")], "key string, payload string")
    as_map = lambda d: {r.key: (r.n, r.run, r.overridden) for r in d.collect()}
    assert as_map(C.get_or_compute(some, folder, 1, compute, schema)) == {"a": (1, 1, False), "b": (2, 1, False)}
    assert as_map(C.get_or_compute(some, folder, 2, compute, schema)) == {"a": (1, 1, False), "b": (2, 1, False)}
    C.override(spark.createDataFrame([("b", 9, "by hand")], f"{schema}, note string"), folder, 1, schema)
    C.override(spark.createDataFrame([("b", None, "by hand")], f"{schema}, note string"), folder, 2, schema)
    assert as_map(C.get_or_compute(more, folder, 3, compute, schema)) == {"a": (1, 1, False), "b": (None, 1, True), "c": (3, 3, False)}
    assert asked == [2, 0, 1]
    with pytest.raises(KeyError):
        C.override(spark.createDataFrame([("nobody", 1, None)], f"{schema}, note string"), folder, 3, schema)


def test_a_method_needs_a_handler(spark):
    from pyspark.sql import functions as F

    from gaugeline.functions import text as X

    df = spark.range(2)
    assert X.by_method(df, ["id"], ("a", "b"), {"a": F.lit("x"), "b": F.lit("y")}).count() == 4
    with pytest.raises(ValueError):
        X.by_method(df, ["id"], ("a", "b"), {"a": F.lit("x")})


def test_stream_matches_batch(spark, sf):
    from gaugeline.streaming.jobs import lifecycle

    batch = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in lifecycle(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    stream = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in QUERIES["job_lifecycle_stream"](spark, sf).collect()}
    assert stream and all(batch[k] == v for k, v in stream.items())


def test_lifecycle_has_the_last_windows(spark, sf):
    from pyspark.sql import functions as F

    from gaugeline.streaming.jobs import run_available

    rows = QUERIES["job_lifecycle_stream"](spark, sf).collect()
    got = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in rows}
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert sum(n for n, _ in got.values()) == events.where("ts is not null").select("event_id").distinct().count()
    last = events.agg(F.date_trunc("day", F.max(F.col("ts").cast("timestamp")))).first()[0]
    assert max(start for start, _ in got) == last
    stream = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in run_available(spark, sf, "events.parquet").collect()}
    assert stream and all(got[k] == v for k, v in stream.items())


def test_entry_without_training_data_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
