"""Rule resolution and evaluation, bound to the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import verdicts as V
from gaugeline.operators import resolution
from gaugeline.plans.registry import query
from gaugeline.sources.tables import inline, table, values_sql

NUMERIC = [
    ("N1", "total_quantity", "<=", 15000.0, None, None, None, 2.0),
    ("N2", "line_count", ">=", 600.0, None, None, None, None),
    ("N3", "max_discount", "=", 0.1, None, None, None, 0.0),
    ("N4", "total_quantity", None, None, "as marked on the plan", None, None, None),
    ("N5", "returned_quantity", "<", 5100.0, None, None, None, 5.0),
    ("N6", "line_count", "~", 10.0, None, None, None, None),
    ("N7", "total_quantity", None, None, None, 14500.0, 15500.0, 1.0),
    ("N8", "no_such_value", "<=", 1.0, None, None, None, None),
]
NUMERIC_DDL = "rule_id string, parameter string, op string, threshold double, threshold_text string, lo double, hi double, tol double"
NUMERIC_STRUCT = NUMERIC_DDL.replace(" ", ": ").replace(",: ", ", ")
NUMERIC_NAMES = "rule_id, parameter, op, threshold, threshold_text, lo, hi, tol"


def supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, facts): each supplier's values by parameter, from one aggregation."""
    li = table(spark, sf_dir, "lineitem")
    wide = li.groupBy(F.col("l_suppkey").alias("entity")).agg(
        F.sum("l_quantity").alias("total_quantity"), F.count(F.lit(1)).cast("double").alias("line_count"), F.max("l_discount").alias("max_discount"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned_quantity"),
    )
    names = ("total_quantity", "line_count", "max_discount", "returned_quantity")
    return wide.select("entity", F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))).alias("facts"))


FACTS_SQL = """facts AS (
  SELECT entity, parameter, actual FROM (
    SELECT l_suppkey AS entity, sum(l_quantity) AS tq, CAST(count(*) AS DOUBLE) AS lc, max(l_discount) AS md,
           sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS rq FROM lineitem GROUP BY l_suppkey) w,
  LATERAL (VALUES ('total_quantity', tq), ('line_count', lc), ('max_discount', md), ('returned_quantity', rq)) v(parameter, actual)),
entities AS (SELECT DISTINCT l_suppkey AS entity FROM lineitem)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each entity and rule: the rules, given above, are unfolded beside the facts and look their value up,
    so the aggregation is the only shuffle.  A rule whose value is absent gives a row too."""
    c = F.col
    rules = F.from_json(F.lit(json.dumps([dict(zip(NUMERIC_NAMES.split(", "), r, strict=True)) for r in NUMERIC])), f"array<struct<{NUMERIC_STRUCT}>>")
    every = supplier_facts(spark, sf_dir).select("entity", "facts", F.explode(rules).alias("r")).select("entity", "r.*", F.try_element_at("facts", c("r.parameter")).alias("actual"))
    return every.withColumn("o", V.numeric(c("actual"), c("op"), c("threshold"), c("threshold_text"), c("lo"), c("hi"), c("tol")))


JUDGED_SQL = f"""{FACTS_SQL},
banded AS (
  SELECT e.entity, r.*, f.actual, coalesce(nullif(r.tol, 0), 2.0) AS pct,
    CASE WHEN lo IS NOT NULL THEN f.actual BETWEEN lo AND hi WHEN op = '<=' THEN f.actual <= threshold WHEN op = '>=' THEN f.actual >= threshold
         WHEN op = '<' THEN f.actual < threshold WHEN op = '=' THEN f.actual = threshold END AS ok,
    CASE WHEN lo IS NULL THEN threshold WHEN abs(f.actual - lo) <= abs(f.actual - hi) THEN lo ELSE hi END AS edge
  FROM entities e CROSS JOIN (SELECT * FROM {values_sql(NUMERIC, NUMERIC_NAMES)}) r LEFT JOIN facts f ON f.entity = e.entity AND f.parameter = r.parameter),
judged AS (
  SELECT *, CASE WHEN threshold IS NULL AND threshold_text IS NOT NULL THEN 'ambiguous_rule' WHEN actual IS NULL THEN 'missing_data'
                 WHEN lo IS NULL AND (op IS NULL OR threshold IS NULL OR ok IS NULL) THEN 'ambiguous_rule' ELSE 'none' END AS failure_mode,
    CASE WHEN edge = 0 THEN actual = 0 ELSE abs(actual - edge) / abs(edge) * 100 <= pct END AS near FROM banded),
verdicts AS (
  SELECT *, CASE WHEN failure_mode <> 'none' THEN 'unevaluable' WHEN ok AND near THEN 'pass_with_note' WHEN ok THEN 'pass' WHEN near THEN 'fail_borderline' ELSE 'fail' END AS verdict FROM judged)"""


@query(f"WITH {JUDGED_SQL} SELECT entity, rule_id, actual, verdict, failure_mode FROM verdicts")
def numeric_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("entity", "rule_id", "actual", "o.verdict", "o.failure_mode")


@query("""SELECT o_orderkey, CASE WHEN abs(o_totalprice - 50000) <= abs(o_totalprice - 150000) THEN 50000.0 ELSE 150000.0 END AS edge,
  CASE WHEN o_totalprice BETWEEN 50000 AND 150000 THEN CASE WHEN near THEN 'pass_with_note' ELSE 'pass' END WHEN near THEN 'fail_borderline' ELSE 'fail' END AS verdict
  FROM (SELECT *, abs(o_totalprice - e) / e * 100 <= 3 AS near FROM (SELECT *, CASE WHEN abs(o_totalprice - 50000) <= abs(o_totalprice - 150000) THEN 50000.0 ELSE 150000.0 END AS e FROM orders) a) b""")
def range_rule_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    price, lo, hi = F.col("o_totalprice"), F.lit(50000.0), F.lit(150000.0)
    none = F.lit(None)
    got = V.numeric(price, none.cast("string"), none.cast("double"), none.cast("string"), lo, hi, F.lit(3.0))
    return o.select("o_orderkey", V.nearest_edge(price, lo, hi).alias("edge"), got["verdict"].alias("verdict"))


TYPED = [
    ("T1", "numeric", "balance", None, None), ("T2", "document_presence", "has_orders", None, None), ("T3", "document_presence", "has_permit", None, None),
    ("T4", "procedural", "segment", "BUILDING", "="), ("T5", "procedural", "segment", "BUILDING", "!="), ("T6", "procedural", "urgent", None, None),
    ("T7", "geometric", None, None, None), ("T8", "qualitative", None, None, None), ("T9", "qualitative", None, None, None),
]


@query(f"""WITH c AS (SELECT c_custkey, c_acctbal, c_mktsegment, count(o_orderkey) AS n, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS u
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey, rule_id, CASE
  WHEN rule_id = 'T9' AND c_mktsegment = 'MACHINERY' THEN 'not_applicable'
  WHEN rule_type = 'numeric' THEN CASE WHEN c_acctbal >= 0 AND c_acctbal = 0 THEN 'pass_with_note' WHEN c_acctbal >= 0 THEN 'pass' ELSE 'fail' END
  WHEN rule_id = 'T2' THEN CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END
  WHEN rule_id = 'T3' THEN 'unevaluable'
  WHEN rule_id = 'T4' THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'pass' ELSE 'fail' END
  WHEN rule_id = 'T5' THEN CASE WHEN c_mktsegment <> 'BUILDING' THEN 'pass' ELSE 'fail' END
  WHEN rule_id = 'T6' THEN CASE WHEN n = 0 THEN 'unevaluable' WHEN u = 1 THEN 'pass' ELSE 'fail' END
  WHEN rule_type = 'geometric' THEN 'unevaluable' ELSE 'requires_review' END AS verdict
FROM c CROSS JOIN (SELECT * FROM {values_sql(TYPED, "rule_id, rule_type, parameter, expected, op")}) r""")
def verdicts_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("u")).withColumn("u", F.col("u").cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").join(o, "c_custkey", "left")
    docs = F.create_map(F.lit("has_orders"), F.col("n").isNotNull())
    flags = F.map_filter(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("urgent"), F.col("u")), lambda k, v: (k != "urgent") | v.isNotNull())
    rules = F.broadcast(inline(spark, TYPED, "rule_id string, rule_type string, parameter string, expected string, op string"))  # nine rows
    none = F.lit(None)
    by_type = {
        "numeric": V.numeric(F.col("c_acctbal"), F.lit(">="), F.lit(0.0), none.cast("string"), none.cast("double"), none.cast("double"), none.cast("double")),
        "document_presence": V.presence(docs, F.coalesce("parameter", "rule_id")),
        "procedural": V.procedural(flags, F.coalesce("parameter", "rule_id"), F.col("expected"), F.col("op")),
        "geometric": V.geometric(), "qualitative": V.qualitative(),
    }
    skip = (F.col("rule_id") == "T9") & (F.col("c_mktsegment") == "MACHINERY")
    return c.join(rules).select("c_custkey", "rule_id", V.dispatch(F.col("rule_type"), by_type, skip)["verdict"].alias("verdict"))


PLAN_RULES = [("AFRICA", "R1", True), ("AFRICA", "R2", False), ("ASIA", "R1", True), ("ASIA", "R3", True), ("EUROPE", "R4", True), ("AMERICA", "R1", True)]
LINKS = [("AFRICA", "primary"), ("ASIA", "partial"), ("EUROPE", "adjacent_reference"), ("AMERICA", "primary")]


@query(f"""SELECT s_suppkey, r_name AS plan, l.coverage_type, p.rule_code FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN (SELECT * FROM {values_sql(LINKS, "plan, coverage_type")}) l ON l.plan = r_name AND l.coverage_type <> 'adjacent_reference'
JOIN (SELECT * FROM {values_sql(PLAN_RULES, "plan, rule_code, is_active")}) p ON p.plan = r_name AND p.is_active
UNION ALL SELECT s_suppkey, r_name, 'no link', NULL FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name NOT IN ('AFRICA', 'ASIA', 'EUROPE', 'AMERICA')""")
def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("plan"))
    got, unlinked = resolution.governing_rules(s, inline(spark, LINKS, "plan string, coverage_type string"), inline(spark, PLAN_RULES, "plan string, rule_code string, is_active boolean"))
    none = unlinked.select("s_suppkey", "plan", F.lit("no link").alias("coverage_type"), F.lit(None).cast("string").alias("rule_code"))
    return got.select("s_suppkey", "plan", "coverage_type", "rule_code").unionByName(none)


EXCEPTIONS = [(3, "R1", "waived", None, 1), (3, "R1", "relaxed", "2030-01-01", 2), (5, "R2", "waived", "2020-01-01", 3), (7, "R2", "relaxed", None, 4), (7, "R2", "waived", "2019-05-05", 5)]


@query(f"""WITH x AS (SELECT project, rule_code, kind, row_number() OVER (PARTITION BY project, rule_code ORDER BY seq DESC) AS rn
  FROM {values_sql(EXCEPTIONS, "project, rule_code, kind, expires_at, seq")} WHERE expires_at IS NULL OR CAST(expires_at AS DATE) > DATE '2024-01-01')
SELECT s_suppkey, r.rule_code, x.kind, x.kind IS NOT NULL AS overridden FROM supplier CROSS JOIN (VALUES ('R1'), ('R2')) r(rule_code)
LEFT JOIN x ON x.project = s_nationkey AND x.rule_code = r.rule_code AND x.rn = 1""")
def override_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("project"))
    rules = s.select("*", F.explode(F.array(F.lit("R1"), F.lit("R2"))).alias("rule_code"))
    x = inline(spark, EXCEPTIONS, "project int, rule_code string, kind string, expires_at string, seq int").withColumn("expires_at", F.to_date("expires_at"))
    got = resolution.with_exceptions(rules, x, F.lit("2024-01-01").cast("date"), ["seq"])
    return got.select("s_suppkey", "rule_code", "kind", F.col("kind").isNotNull().alias("overridden"))


@query("""SELECT fingerprint, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT substring(sha256(concat(l_returnflag, '|', l_linestatus, '|', CAST(l_linenumber AS VARCHAR), '|', CAST(l_suppkey % 7 AS VARCHAR))), 1, 16) AS fingerprint FROM lineitem WHERE l_discount > 0.05) t
GROUP BY fingerprint HAVING count(*) >= 3""")
def error_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_discount > 0.05")
    seed = F.concat_ws("|", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 7).cast("string"))
    return li.groupBy(V.fingerprint(seed).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("""SELECT o_orderkey, q, lim, CASE WHEN lim IS NULL THEN 'not_applicable' WHEN q IS NULL THEN 'not_submitted' WHEN q <= lim THEN 'pass' WHEN q - lim <= lim * 5.0 / 100 THEN 'fail_borderline' ELSE 'fail' END AS area_verdict,
  CASE WHEN lim IS NULL THEN 'not_applicable' WHEN m IS NULL THEN 'not_submitted' WHEN m <= h THEN 'pass' WHEN m <= h + 0.5 THEN 'fail_borderline' ELSE 'fail' END AS height_verdict
FROM (SELECT o_orderkey, sum(l_quantity) AS q, max(l_quantity) AS m, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN 80.0 ELSE 120.0 END AS lim,
  CASE o_orderpriority WHEN '1-URGENT' THEN 40.0 ELSE 45.0 END AS h FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority) t""")
def content_le_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_quantity").alias("m"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    p = F.col("o_orderpriority")
    lim = F.when(p == "5-LOW", None).when(p == "1-URGENT", 80.0).otherwise(120.0)
    cap = F.when(p == "5-LOW", None).when(p == "1-URGENT", 40.0)
    floors = F.when(p != "5-LOW", 15)
    heights = F.when(F.col("m").isNotNull(), F.array("m"))
    return o.select("o_orderkey", "q", lim.alias("lim"), V.at_most(F.col("q"), lim, F.lit(5.0))["verdict"].alias("area_verdict"), V.height(heights, cap, floors)["verdict"].alias("height_verdict"))


@query("""SELECT c_custkey, n_orders, n_lines, CASE WHEN n_orders = 0 THEN 'not_submitted' WHEN CAST(n_lines AS DOUBLE) / n_orders >= 4.0 THEN 'pass' ELSE 'fail' END AS verdict
FROM (SELECT c_custkey, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_orders, CAST(count(l_orderkey) AS BIGINT) AS n_lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey
  LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey) t""")
def ratio_with_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.coalesce("lines", F.lit(0))).alias("n_lines"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["n_orders", "n_lines"])
    return c.select("c_custkey", "n_orders", "n_lines", V.parking(F.col("n_lines"), F.col("n_orders"), F.lit(4.0))["verdict"].alias("verdict"))


@query("""SELECT p_brand, small, total, unknown, CASE WHEN total = 0 THEN 'not_submitted' WHEN unknown > 0 THEN 'requires_review' WHEN CAST(small AS DOUBLE) / total * 100 >= 20 THEN 'pass' ELSE 'fail' END AS verdict,
  CASE WHEN w = 0 THEN NULL ELSE CAST(v AS DOUBLE) / CAST(w AS DOUBLE) * 100 END AS weighted_pct
FROM (SELECT p_brand, CAST(count(*) FILTER (WHERE p_size <= 10) AS BIGINT) AS small, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE p_size = 50) AS BIGINT) AS unknown,
  coalesce(sum(CAST(p_retailprice AS DECIMAL(18,2))) FILTER (WHERE p_size <= 40 AND p_size <= 10), 0) AS v, coalesce(sum(CAST(p_retailprice AS DECIMAL(18,2))) FILTER (WHERE p_size <= 40), 0) AS w FROM part GROUP BY p_brand) t""")
def share_with_null_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice").cast("decimal(18,2)")
    known = size <= 40  # larger parts report no share: they leave numerator and denominator
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count_if(size <= 10).alias("small"), F.count(F.lit(1)).alias("total"), F.count_if(size == 50).alias("unknown"),
        F.sum(F.when(known & (size <= 10), price)).alias("v"), F.sum(F.when(known, price)).alias("w"),
    )
    share = F.try_divide(F.col("small").cast("double"), F.col("total")) * 100
    verdict = F.when(share.isNull(), "not_submitted").when(F.col("unknown") > 0, "requires_review").when(share >= 20, "pass").otherwise("fail")
    return p.select("p_brand", "small", "total", "unknown", verdict.alias("verdict"), (F.try_divide(F.coalesce("v", F.lit(0)).cast("double"), F.col("w").cast("double")) * 100).alias("weighted_pct"))


#: Rules of a plan by code and scope; the last two have no handler of their scope.
CODES = [("UNIT_COUNT", "per_parcel"), ("MAIN_AREA", "per_parcel"), ("HEIGHT", "per_parcel"), ("SETBACKS", "per_parcel"), ("PARKING", "per_parcel"), ("SMALL_UNITS", "plan_wide"), ("PERMEABLE", "plan_wide"), ("NOISE", "per_parcel"), ("HEIGHT", "plan_wide")]


@query("""WITH f AS (SELECT s_suppkey AS parcel, s_nationkey AS plan, s_suppkey % 60 AS units, 50 AS most_units, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END AS area, CASE WHEN s_suppkey % 11 > 0 THEN 5000.0 END AS cap, 27.0 + s_suppkey % 5 AS high, s_suppkey % 90 AS spaces, s_suppkey % 10 AS small, 1000.0 + s_suppkey % 3 AS plot, CASE WHEN s_suppkey % 4 > 0 THEN 120.0 + s_suppkey % 70 END AS soft FROM supplier),
g AS (SELECT plan, sum(small) * 100.0 / nullif(sum(units), 0) AS small_pct, sum(CASE WHEN soft IS NOT NULL THEN soft END) * 100.0 / sum(CASE WHEN soft IS NOT NULL THEN plot END) AS soft_pct FROM f GROUP BY plan)
SELECT plan, parcel, 'UNIT_COUNT' AS rule_code, CASE WHEN units <= most_units THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN units <= most_units THEN 'NONE' ELSE 'OVERRUN' END AS failure_mode FROM f
UNION ALL SELECT plan, parcel, 'MAIN_AREA', CASE WHEN cap IS NULL THEN 'not_applicable' WHEN area IS NULL THEN 'not_submitted' WHEN area <= cap THEN 'pass' WHEN area - cap <= cap * 3 / 100 THEN 'fail_borderline' ELSE 'fail' END, CASE WHEN cap IS NULL THEN 'NONE' WHEN area IS NULL THEN 'DOCUMENT_NOT_PROVIDED' WHEN area <= cap THEN 'NONE' ELSE 'OVERRUN' END FROM f
UNION ALL SELECT plan, parcel, 'HEIGHT', CASE WHEN high <= 29 THEN 'pass' WHEN high <= 29.5 THEN 'fail_borderline' ELSE 'fail' END, CASE WHEN high <= 29 THEN 'NONE' ELSE 'OVERRUN' END FROM f UNION ALL SELECT plan, parcel, 'SETBACKS', 'requires_review', 'none' FROM f
UNION ALL SELECT plan, parcel, 'PARKING', CASE WHEN units = 0 THEN 'not_submitted' WHEN spaces * 1.0 / units >= 1.3 THEN 'pass' ELSE 'fail' END, CASE WHEN units = 0 THEN 'DOCUMENT_NOT_PROVIDED' WHEN spaces * 1.0 / units >= 1.3 THEN 'NONE' ELSE 'UNDERRUN' END FROM f
UNION ALL SELECT plan, NULL, 'SMALL_UNITS', CASE WHEN small_pct IS NULL THEN 'not_submitted' WHEN small_pct >= 15 THEN 'pass' ELSE 'fail' END, CASE WHEN small_pct IS NULL THEN 'DOCUMENT_NOT_PROVIDED' WHEN small_pct >= 15 THEN 'NONE' ELSE 'UNDERRUN' END FROM g
UNION ALL SELECT plan, NULL, 'PERMEABLE', CASE WHEN soft_pct IS NULL THEN 'not_submitted' WHEN soft_pct >= 15 THEN 'pass' ELSE 'fail' END, CASE WHEN soft_pct IS NULL THEN 'DOCUMENT_NOT_PROVIDED' WHEN soft_pct >= 15 THEN 'NONE' ELSE 'UNDERRUN' END FROM g
UNION ALL SELECT plan, NULL, 'NOISE', 'unevaluable', 'engine_error' FROM g UNION ALL SELECT plan, NULL, 'HEIGHT', 'unevaluable', 'engine_error' FROM g""")
def rule_code_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rules by code: some judge each parcel, some a whole plan; codes without a handler are engine errors of the plan."""
    c, k = F.col, F.col("s_suppkey")
    f = table(spark, sf_dir, "supplier").select(
        k.alias("parcel"), c("s_nationkey").alias("plan"), (k % 60).alias("units"), F.when(k % 7 > 0, c("s_acctbal")).alias("area"), F.when(k % 11 > 0, 5000.0).alias("cap"), F.array(27.0 + k % 5, F.lit(9.0)).alias("heights"), (k % 90).alias("spaces"), (k % 10).alias("small"),
        (1000.0 + k % 3).alias("plot"), F.when(k % 4 > 0, 120.0 + k % 70).alias("soft"))
    given = c("soft").isNotNull()
    share = lambda part, whole: F.try_divide(F.sum(part).cast("double") * 100, F.sum(whole))
    least = lambda s, pct: F.when(s.isNull(), V.outcome("not_submitted", "DOCUMENT_NOT_PROVIDED")).when(s >= pct, V.outcome("pass", "NONE")).otherwise(V.outcome("fail", "UNDERRUN"))
    per_parcel = {
        "UNIT_COUNT": V.count_at_most(c("units"), F.lit(50)), "MAIN_AREA": V.at_most(c("area"), c("cap"), F.lit(3.0)), "HEIGHT": V.height(c("heights"), F.lit(29.0), F.lit(9)), "SETBACKS": V.outcome("requires_review"), "PARKING": V.parking(c("spaces"), c("units")),
    }
    plan_wide = {"SMALL_UNITS": least(share(c("small"), c("units")), 15), "PERMEABLE": least(share(F.when(given, c("soft")), F.when(given, c("plot"))), 15)}
    return V.by_code(f, ["parcel"], CODES, per_parcel, plan_wide, ["plan"])
