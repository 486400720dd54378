"""Recursion, overlaps, data checks, geometry, dynamic values and the stream, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import geometry as G
from gaugeline.operators import quality_checks as Q
from gaugeline.operators.tree import ancestor_chains, with_parents
from gaugeline.plans.registry import query
from gaugeline.sources.tables import spread, table
from gaugeline.streaming import jobs


@query("""SELECT concat('r', r_regionkey) AS id, r_name AS chain FROM region UNION ALL SELECT concat('n', n_nationkey), concat(r_name, ' > ', n_name) FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT concat('s', s_suppkey), concat(r_name, ' > ', n_name, ' > ', s_name) FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda d, tag, key, up_tag, up, title: d.select(F.concat(F.lit(tag), key).alias("id"), (F.concat(F.lit(up_tag), up) if up else F.lit(None).cast("string")).alias("parent"), F.col(title).alias("title"))
    nodes = (
        node(table(spark, sf_dir, "region"), "r", "r_regionkey", "", None, "r_name").unionByName(node(table(spark, sf_dir, "nation"), "n", "n_nationkey", "r", "n_regionkey", "n_name"))
        .unionByName(node(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "n", "s_nationkey", "s_name"))
    )
    return ancestor_chains(nodes).select("id", F.array_join("chain", " > ").alias("chain"))


@query("""WITH i AS (SELECT event_id, user_id % 20 AS grp, epoch(ts) AS lo, epoch(ts) + value * 60 AS hi FROM events WHERE event_type = 'purchase')
SELECT a.event_id AS a, b.event_id AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM i a JOIN i b ON a.grp = b.grp AND a.event_id < b.event_id AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.5""")
def pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    lo = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    i = e.select("event_id", (F.col("user_id") % 20).alias("grp"), lo.alias("lo"), (lo + F.col("value") * 60).alias("hi"))
    # intervals meet in the grid cells they touch; a pair counts in the first cell both touch
    cell = 3600.0
    i = i.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    a, b = i.toDF("a", "grp", "alo", "ahi", "cell"), i.toDF("b", "grp", "blo", "bhi", "cell")
    both = a.join(b, ["grp", "cell"]).where("a < b")
    first = F.floor(F.greatest("alo", "blo") / cell) == F.col("cell")
    over = F.least("ahi", "bhi") - F.greatest("alo", "blo")
    return both.where(first & (over > 0.5)).select("a", "b", over.alias("overlap"))


@query("""SELECT 'doc_text_empty' AS "check", CAST(count(*) AS BIGINT) AS bad, count(*) = 0 AS passed FROM documents WHERE text IS NULL OR trim(text) = '' UNION ALL
SELECT 'doc_lang_known', count(*), count(*) = 0 FROM documents WHERE lang NOT IN ('en', 'fr', 'de') UNION ALL SELECT 'doc_length', count(*), count(*) = 0 FROM documents WHERE length(text) <> n_chars UNION ALL
SELECT 'order_line_unique', CAST(coalesce(sum(n - 1), 0) AS BIGINT), coalesce(sum(n - 1), 0) = 0 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) t UNION ALL
SELECT 'label_has_document', count(*), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'line_has_order', count(*), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def dq_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, li = table(spark, sf_dir, "documents"), table(spark, sf_dir, "lineitem")
    rows = Q.row_checks(d, {
        "doc_text_empty": F.col("text").isNull() | (F.trim("text") == ""), "doc_lang_known": ~F.col("lang").isin("en", "fr", "de"), "doc_length": F.length("text") != F.col("n_chars"),
    })
    return (
        rows.unionByName(Q.duplicates(li, ["l_orderkey", "l_linenumber"], "order_line_unique")).unionByName(Q.dangling(table(spark, sf_dir, "labels"), "doc_id", d, "doc_id", "label_has_document"))
        .unionByName(Q.dangling(li, "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey", "line_has_order"))
    )


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 101 = 1 THEN p_partkey + 10000000 ELSE p_partkey // 3 END AS parent, CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS title FROM part),
a AS (SELECT id, parent, title FROM n UNION ALL SELECT DISTINCT parent, CAST(NULL AS BIGINT), 'section' FROM n WHERE parent NOT IN (SELECT id FROM n)),
c AS (SELECT id, [coalesce(title, '-')] AS chain FROM a WHERE parent IS NULL UNION ALL SELECT a.id, list_append(c.chain, coalesce(a.title, '-')) FROM a JOIN c ON a.parent = c.id)
SELECT id, array_to_string(chain, ' > ') AS chain, CAST(len(chain) AS BIGINT) AS depth FROM c""")
def clause_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title chains of a deeper tree in which some parents are missing and some titles are null."""
    k = F.col("p_partkey")
    parent = F.when(k % 101 == 1, k + 10000000).when(k > 0, F.floor(k / 3).cast("long"))
    nodes = with_parents(table(spark, sf_dir, "part").select(k.alias("id"), parent.alias("parent"), F.when(k % 13 != 0, F.col("p_name")).alias("title")), "section")
    return ancestor_chains(nodes).select("id", F.array_join("chain", " > ", "-").alias("chain"), F.size("chain").cast("long").alias("depth"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 3 AS DOUBLE) ELSE p_size * 3 / 2.0 END AS area, CASE WHEN p_partkey % 2 = 0 THEN p_size > 10.5 ELSE 10.5 / p_size + 0.5 / 3 < 1 END AS has_point, p_partkey % 5 = 0 AS closed,
 CAST(100 - p_size AS DOUBLE) AS distance, round(3.13654849 * p_size * p_size, 1) AS circle_area, p_partkey % 11 <> 0 AS valid FROM part""")
def polygon_area_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, containment, closing vertices, distances and circles of rings from each part's size; rings of no area are not valid."""
    k, w = F.col("p_partkey"), F.col("p_size").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, three = F.lit(0.0), F.lit(3.0)
    ring = F.when(k % 2 == 0, F.array(point(zero, zero), point(w, zero), point(w, three), point(zero, three))).otherwise(F.array(point(zero, zero), point(w, zero), point(zero, three)))
    loop = F.when(k % 5 == 0, F.concat(ring, F.array(point(zero, F.lit(0.0005))))).otherwise(ring)
    flat = F.when(k % 11 == 0, F.array(point(zero, zero), point(w, zero), point(w * 2, zero))).otherwise(ring)
    other = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(100.0, 0.0), (101.0, 0.0), (101.0, 1.0), (100.0, 1.0)]))
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", ring.alias("ring"), loop.alias("loop"), flat.alias("flat"), w.alias("w"))
    r = F.col("ring")
    return p.select(
        "p_partkey", G.area(r).alias("area"), G.contains(r, F.lit(10.5), F.lit(0.5)).alias("has_point"), G.closed(F.col("loop")).alias("closed"), G.distance(r, other).alias("distance"),
        F.round(G.area(G.circle(F.lit(0.0), F.lit(0.0), F.col("w"))), 1).alias("circle_area"), G.valid(F.col("flat")).alias("valid"),
    )


DRAWN_SQL = """d AS (SELECT p_partkey, p_brand, 20.0 + p_size % 10 AS pw, 20.0 AS ph, 1.0 + p_size % 7 AS x0, 2.0 + p_partkey % 3 AS y0, 4.0 + p_size % 9 AS bw, 5.0 + p_partkey % 8 AS bh,
  CASE WHEN p_partkey % 5 <> 0 THEN 10.0 + p_size % 6 END AS cap, CASE WHEN p_partkey % 4 <> 0 THEN 2.0 + p_partkey % 4 END AS setback FROM part)"""


@query(f"""WITH {DRAWN_SQL}, g AS (SELECT p_brand, sum(bw * bh) AS footprint, sum(pw * ph) AS plot, min(setback) AS required, min(least(x0, pw - x0 - bw)) AS actual, count(*) AS n, min_by(cap, p_partkey) FILTER (WHERE cap IS NOT NULL) AS cap,
  sum(greatest(least(x0 + bw, 30.0) - greatest(x0, 8.0), 0) * greatest(least(y0 + bh, 30.0) - greatest(y0, 9.0), 0)) AS shared, arg_max(p_partkey, bw * bh * 1000000.0 - p_partkey) AS largest FROM d GROUP BY 1)
SELECT p_brand, CASE WHEN cap IS NULL THEN 'not_applicable' WHEN footprint / plot * 100 <= cap + 0.5 THEN 'pass' ELSE 'fail' END AS coverage, CASE WHEN required IS NULL THEN 'not_applicable' WHEN actual + 0.05 >= required THEN 'pass' ELSE 'fail' END AS setback,
 shared, CASE WHEN shared > 0.5 THEN 'fail' ELSE 'pass' END AS public_space, CASE WHEN n >= 80 THEN 'pass' ELSE 'fail' END AS parking, largest FROM g""")
def drawing_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings by group: covered share against the first cap given, the smallest setback against the nearest boundary,
    the area built on public space, a count of spaces, and the largest footprint."""
    c, k, size = F.col, F.col("p_partkey"), F.col("p_size")
    pw, x0, y0, bw, bh = 20.0 + size % 10, 1.0 + size % 7, 2.0 + k % 3, 4.0 + size % 9, 5.0 + k % 8
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(point(x0, y0), point(x0 + bw, y0), point(x0 + bw, y0 + bh), point(x0, y0 + bh))
    sides = [F.array(point(x, F.lit(0.0)), point(x, F.lit(20.0))) for x in (F.lit(0.0), pw)]
    plot = F.array(point(F.lit(0.0), F.lit(0.0)), point(pw, F.lit(0.0)), point(pw, F.lit(20.0)), point(F.lit(0.0), F.lit(20.0)))
    d = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select("p_partkey", "p_brand", ring.alias("ring"), plot.alias("plot"), F.array(*sides).alias("sides"), F.when(k % 5 != 0, 10.0 + size % 6).alias("cap"), F.when(k % 4 != 0, 2.0 + k % 4).alias("setback"))
    box = lambda r: F.struct(F.element_at(r, 1)["x"].alias("x0"), F.element_at(r, 1)["y"].alias("y0"), F.element_at(r, 3)["x"].alias("x1"), F.element_at(r, 3)["y"].alias("y1"))
    public = F.struct(F.lit(8.0).alias("x0"), F.lit(9.0).alias("y0"), F.lit(30.0).alias("x1"), F.lit(30.0).alias("y1"))
    d = d.select("p_partkey", "p_brand", "cap", "setback", G.area(c("ring")).alias("area"), G.area(c("plot")).alias("plot"), F.array_min(F.transform("sides", lambda s: G.distance(c("ring"), s))).alias("gap"), G.box_overlap(box(c("ring")), public).alias("shared"))
    g = d.groupBy("p_brand").agg(
        F.sum("area").alias("footprint"), F.sum("plot").alias("plot"), F.min("setback").alias("required"), F.min("gap").alias("actual"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(c("cap").isNotNull(), F.struct("p_partkey", "cap")))["cap"].alias("cap"), F.sum("shared").alias("shared"), F.max(F.struct("area", (-k).alias("m")))["m"].alias("largest"),
    )
    verdict = lambda missing, good: F.when(missing, "not_applicable").when(good, "pass").otherwise("fail")
    return g.select(
        "p_brand", verdict(c("cap").isNull(), F.try_divide("footprint", "plot") * 100 <= c("cap") + 0.5).alias("coverage"), verdict(c("required").isNull(), c("actual") + 0.05 >= c("required")).alias("setback"),
        "shared", verdict(F.lit(False), c("shared") <= 0.5).alias("public_space"), verdict(F.lit(False), c("n") >= 80).alias("parking"), (-c("largest")).alias("largest"),
    )


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS absent, true AS present FROM events""")
def variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    e = table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.absent.deep", "string").alias("absent"))
    return e.withColumn("present", F.col("k").isNotNull())


@query("""SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) e GROUP BY 1, 2""")
def job_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, those too that a stream (jobs.run_available) still holds open at its end."""
    return jobs.lifecycle(table(spark, sf_dir, "events"))
