"""Format, table and drawing checks, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions import verdicts as V
from gaugeline.operators import geometry as G
from gaugeline.operators import pages as P
from gaugeline.operators.dedup import first_by
from gaugeline.operators.matching import blocks_to_polygons
from gaugeline.plans.registry import query
from gaugeline.sources.tables import inline, spread, table, values_sql

SCOPES = ["all", "all_text", "first", "except_cover", "first_five", "with_text", "team_page", "odd_name"]
#: What the page that names the team says.
TEAM = "and"


@query(f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM conversations), p AS (SELECT *, min(CASE WHEN n <= 5 AND contains(coalesce(text, ''), '{TEAM}') THEN n END) OVER (PARTITION BY conv_id) AS team FROM t)
SELECT s.scope, CAST(count(*) FILTER (WHERE CASE s.scope WHEN 'first' THEN n = 1 WHEN 'except_cover' THEN n > 1 WHEN 'first_five' THEN n <= 5 WHEN 'with_text' THEN length(trim(text)) > 0 WHEN 'team_page' THEN n = team ELSE true END) AS BIGINT) AS pages
FROM p CROSS JOIN (VALUES """ + ", ".join(f"('{s}')" for s in SCOPES) + ") s(scope) GROUP BY s.scope")
def page_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # turns of a conversation stand for pages; the scopes are given, so each is a column of one pass
    c = table(spark, sf_dir, "conversations")
    c = c.select("conv_id", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))
    c = c.withColumn("team", P.team_page(F.col("n"), F.col("text"), TEAM, Window.partitionBy("conv_id")))
    wide = c.agg(*(F.count_if(P.in_scope(F.lit(s), F.col("n"), F.col("text"), F.col("team"))).alias(s) for s in SCOPES))
    return wide.unpivot([], SCOPES, "scope", "pages")


@query("""SELECT p_partkey, (abs(p_size - 21) <= 2 AND abs(p_partkey % 40 - 29) <= 2) OR (abs(p_size - 29) <= 2 AND abs(p_partkey % 40 - 21) <= 2) AS size_ok, position('brass' IN lower(p_type)) > 0 OR position('steel' IN lower(p_type)) > 0 AS font_ok FROM part""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = P.size_within(F.col("p_size"), F.col("p_partkey") % 40, 21, 29, 2)
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size_ok"), P.allowed_font(F.col("p_type"), ["brass", "steel"]).alias("font_ok"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS hits FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(hits AS BIGINT) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY hits DESC, l_linenumber) AS rn FROM h) t WHERE rn = 1""")
def best_table_by_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.concat(F.lit("s"), F.col("l_linestatus")).alias("s"))
    got = P.best_table(li, "l_orderkey", F.array("l_returnflag", "s"), ["R", "sF"], "l_linenumber")
    return got.select("l_orderkey", "l_linenumber", F.col("hits").cast("long").alias("hits"))


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^ \t\n\r\f\v]+'), lambda x: x <> '')) BETWEEN 1 AND 49 AS divider, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.divider(F.col("text")).alias("divider"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("""SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS images, CAST(count(*) AS BIGINT) AS objects, CASE WHEN count(*) FILTER (WHERE event_type = 'view') >= 3 AND CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) / count(*) >= 0.2 THEN 'pass' ELSE 'fail' END AS verdict FROM events GROUP BY user_id""")
def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("images"), F.count(F.lit(1)).alias("objects"))
    ok = (F.col("images") >= 3) & (F.try_divide(F.col("images").cast("double"), F.col("objects")) >= 0.2)
    return g.withColumn("verdict", F.when(ok, "pass").otherwise("fail"))


ZONES = [("Z1", 0.0, 0.0, 40.0, 30.0), ("Z2", 30.0, 20.0, 70.0, 60.0), ("Z3", 80.0, 0.0, 100.0, 100.0)]


@query(f"""WITH p AS (SELECT event_id, value AS x, CAST(user_id % 100 AS DOUBLE) AS y FROM events WHERE event_type = 'error'), z AS (SELECT * FROM {values_sql(ZONES, "zone, x0, y0, x1, y1")})
SELECT p.event_id, coalesce(min(z.zone), 'stub') AS zone FROM p LEFT JOIN z ON p.x >= z.x0 AND p.x < z.x1 AND p.y >= z.y0 AND p.y < z.y1 GROUP BY p.event_id""")
def points_in_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First zone, by name, that holds a point; points of none get a stub."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.col("value").alias("x"), (F.col("user_id") % 100).cast("double").alias("y"))
    z = F.broadcast(inline(spark, ZONES, "zone string, x0 double, y0 double, x1 double, y1 double"))  # three rows
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return e.join(z, inside, "left").groupBy("event_id").agg(F.coalesce(F.min("zone"), F.lit("stub")).alias("zone"))


@query("""WITH b AS (SELECT p_partkey AS id, CAST(p_partkey % 500 * 20 AS DOUBLE) AS x0, CAST(p_partkey // 500 * 4 AS DOUBLE) AS y0, CAST(p_partkey % 500 * 20 + p_size AS DOUBLE) AS x1, CAST(p_partkey // 500 * 4 + 5 AS DOUBLE) AS y1 FROM part)
SELECT a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM b a JOIN b ON a.id < b.id
WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.5""")
def plot_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = k % 500 * 20, F.floor(k / 500) * 4
    box = F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("p_size")).cast("double").alias("x1"), (y + 5).cast("double").alias("y1"))
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("id"), box.alias("box"))
    # boxes meet in the grid cells they cover; a pair counts in the cell of its overlap's lower left corner
    cell = 10.0
    at = lambda c: F.floor(c / cell)
    g = p.withColumn("cx", F.explode(F.sequence(at(F.col("box.x0")), at(F.col("box.x1"))))).withColumn("cy", F.explode(F.sequence(at(F.col("box.y0")), at(F.col("box.y1")))))
    a, b = g.select(F.col("id").alias("a"), F.col("box").alias("p"), "cx", "cy"), g.select(F.col("id").alias("b"), F.col("box").alias("q"), "cx", "cy")
    own = (at(F.greatest("p.x0", "q.x0")) == F.col("cx")) & (at(F.greatest("p.y0", "q.y0")) == F.col("cy"))
    # merged: sizes guessed from the narrow table would have the boxes broadcast
    return a.join(b.hint("merge"), ["cx", "cy"]).where((F.col("a") < F.col("b")) & own).select("a", "b", G.box_overlap(F.col("p"), F.col("q")).alias("area")).where("area > 0.5")


@query("""WITH v AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_retailprice, p_size FROM part)
SELECT p_partkey, CASE WHEN abs(p_retailprice - 1000 - p_size) / (1000 + p_size) * 100 <= 5 THEN 'match' WHEN EXISTS (SELECT 1 FROM v o WHERE o.p_partkey <> v.p_partkey AND o.cents = v.cents) THEN 'swapped' ELSE 'mismatch' END AS verdict FROM v""")
def discrepancy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value off by over 5 percent is swapped where another row has the same value, to less than a hundredth."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    near = p.groupBy("cents").agg(F.count(F.lit(1)).alias("n"))
    want = 1000 + F.col("p_size")
    off = F.try_divide(F.abs(F.col("p_retailprice") - want), want) * 100
    return p.join(near, "cents").select("p_partkey", F.when(off <= 5, "match").when(F.col("n") > 1, "swapped").otherwise("mismatch").alias("verdict"))


@query("""SELECT s_nationkey, min(s_acctbal) AS required, CAST(count(*) AS BIGINT) AS n, CASE WHEN 500 + 0.05 >= min(s_acctbal) THEN 'pass' ELSE 'fail' END AS setback, CASE WHEN count(*) >= 3 THEN 'pass' ELSE 'fail' END AS parking FROM supplier GROUP BY s_nationkey""")
def drawing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest requirement of a group with five centimetres of slack, and a count against a minimum."""
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("required"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"setback": F.when(F.lit(500 + 0.05) >= F.col("required"), "pass").otherwise("fail"), "parking": F.when(V.compare(F.lit(">="), F.col("n"), F.lit(3)), "pass").otherwise("fail")})


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 5""")
def largest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("g", F.col("o_custkey") % 10)
    return first_by(o, ["g"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).drop("g")


#: Rule sets and the mode that they are made for; a nation's mode is its region.
RULE_SETS = [("S1", "AFRICA"), ("S2", "ASIA"), ("S3", "EUROPE"), ("S4", "ASIA")]
MISSING = "NOT_IN_SUBMISSION"


@query(f"""WITH n AS (SELECT n_nationkey, s.rule_set, r_name = s.mode AS fits FROM nation JOIN region ON r_regionkey = n_regionkey CROSS JOIN {values_sql(RULE_SETS, "rule_set, mode").replace(" AS t(", " AS s(")})
SELECT n_nationkey, rule_set, CAST(NULL AS BIGINT) AS parcel, 'not_applicable' AS verdict FROM n WHERE NOT fits UNION ALL
SELECT n_nationkey, rule_set, c_custkey, CASE WHEN c_acctbal < 0 THEN 'not_submitted' WHEN c_acctbal > 5000 THEN 'pass' ELSE 'fail' END FROM n JOIN customer ON c_nationkey = n_nationkey WHERE fits""")
def regulatory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule set whose mode isn't the nation's gives one not_applicable row without a parcel; a fitting one a row for each
    parcel, not submitted where the parcel's status begins so."""
    c = F.col
    sets = F.array(*(F.struct(F.lit(r).alias("rule_set"), F.lit(m).alias("mode")) for r, m in RULE_SETS))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("r_regionkey") == c("n_regionkey"))
    n = n.select("n_nationkey", c("r_name").alias("own_mode"), F.explode(sets).alias("s")).select("n_nationkey", "s.rule_set", (c("own_mode") == c("s.mode")).alias("fits"))
    gate = n.where("not fits").select("n_nationkey", "rule_set", F.lit(None).cast("long").alias("parcel"), F.lit("not_applicable").alias("verdict"))
    status = F.when(c("c_acctbal") < 0, F.concat(F.lit(f"{MISSING}: sheet "), c("c_custkey").cast("string"))).when(c("c_acctbal") > 5000, "in order").otherwise("over the cap")
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", status.alias("status"))
    rows = own.join(n.where("fits"), c("n_nationkey") == c("c_nationkey"))
    verdict = F.when(F.startswith("status", F.lit(MISSING)), "not_submitted").when(c("status") == "in order", "pass").otherwise("fail")
    return gate.unionByName(rows.select("n_nationkey", "rule_set", c("c_custkey").alias("parcel"), verdict.alias("verdict")))


#: Eight blocks and up to 160 plots on a drawing.
MATCH_SQL = """WITH RECURSIVE ins AS (SELECT s_suppkey // 8 AS d, s_suppkey AS i, s_suppkey % 90 + 0.5 AS x, s_suppkey % 40 + 0.25 AS y, row_number() OVER (PARTITION BY s_suppkey // 8 ORDER BY s_suppkey) AS n FROM supplier),
pol AS (SELECT p_partkey // 160 AS d, p_partkey AS p, p_partkey % 83 AS x0, p_partkey % 37 AS y0, p_size % 9 + 1 AS w FROM part),
hold AS (SELECT i, p, (x > x0 AND x < x0 + w AND y > y0 AND y < y0 + 3) AS inside, (x0 + w / 2 - x) * (x0 + w / 2 - x) + (y0 + 1.5 - y) * (y0 + 1.5 - y) AS far FROM ins JOIN pol ON pol.d = ins.d),
run AS (SELECT DISTINCT d, 0 AS n, CAST([] AS BIGINT[]) AS used FROM ins UNION ALL
 SELECT r.d, r.n + 1, list_append(r.used, arg_min(h.p, row(NOT h.inside, CASE WHEN h.inside THEN 0 ELSE h.far END, h.p))) FROM run r JOIN ins ON ins.d = r.d AND ins.n = r.n + 1 JOIN hold h ON h.i = ins.i AND NOT list_contains(r.used, h.p) GROUP BY r.d, r.n, r.used)
SELECT ins.d AS drawing, ins.i AS "insert", used[run.n] AS polygon, inside AS contained FROM run JOIN ins ON ins.d = run.d AND ins.n = run.n JOIN hold ON hold.i = ins.i AND hold.p = used[run.n]"""


@query(MATCH_SQL)
def block_polygon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as block inserts, parts as plots of their drawings: in the order of inserts each takes the first free plot
    around it, else the nearest free one."""
    c, k = F.col, F.col("p_partkey")
    inserts = table(spark, sf_dir, "supplier").select(F.floor(c("s_suppkey") / 8).alias("drawing"), c("s_suppkey").alias("insert"), (c("s_suppkey") % 90 + 0.5).alias("x"), (c("s_suppkey") % 40 + 0.25).alias("y"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w = k % 83, k % 37, c("p_size") % 9 + 1
    ring = F.array(point(x, y), point(x + w, y), point(x + w, y + 3), point(x, y + 3))
    return blocks_to_polygons(inserts, table(spark, sf_dir, "part").select(F.floor(k / 160).alias("drawing"), k.alias("polygon"), ring.alias("ring")))
