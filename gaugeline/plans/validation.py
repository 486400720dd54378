"""Validation suites of the five document stages, bound to the driver's tables.

Parts stand for clauses, events for pages, line items for findings, orders for critiques and fused verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import quality_checks as Q
from gaugeline.plans.registry import query
from gaugeline.sources.tables import table

#: A check is bad rows, and passes without any: SQL of one line of a suite.
LINE = "SELECT '{0}' AS \"check\", CAST({1} AS BIGINT) AS bad, {1} = 0 AS passed FROM {2}"


def suite_sql(head: str, lines: list[tuple[str, str, str]]) -> str:
    return head + " UNION ALL ".join(LINE.format(*x) for x in lines)


CATEGORIES = [f"Brand#{i}" for i in range(1, 21)]
PAGES = 48


@query(suite_sql("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey // 2 + CASE WHEN p_partkey % 101 = 1 THEN 10000000 ELSE 0 END END AS parent,
  CASE WHEN p_partkey % 97 <> 0 THEN p_name ELSE ' ' END AS text, p_size AS page, p_brand AS category, p_retailprice AS price FROM part) """, [
    ("required_fields", "count(*) FILTER (WHERE id IS NULL OR category IS NULL)", "c"), ("text_non_empty", "count(*) FILTER (WHERE trim(text) = '')", "c"),
    ("unique_ids", "count(*) - count(DISTINCT id)", "c"), ("parents_resolve", "count(*)", "c WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM c)"),
    ("pages_in_range", f"count(*) FILTER (WHERE page NOT BETWEEN 1 AND {PAGES})", "c"), ("categories_known", f"count(*) FILTER (WHERE category NOT IN ({', '.join(repr(x) for x in CATEGORIES)}))", "c"),
    ("table_rows_present", "CASE WHEN count(*) FILTER (WHERE category = 'Brand#5' AND price > 900) > 0 THEN 0 ELSE 1 END", "c"), ("count_in_bounds", "CASE WHEN count(*) BETWEEN 100 AND 1000000000 THEN 0 ELSE 1 END", "c"),
]))
def clause_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 7 != 0, F.floor(k / 2) + F.when(k % 101 == 1, 10000000).otherwise(0)).alias("parent"), F.when(k % 97 != 0, F.col("p_name")).otherwise(" ").alias("text"),
        F.col("p_size").alias("page"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"),
    )
    return Q.suite(
        Q.row_checks(c, {
            "required_fields": F.col("id").isNull() | F.col("category").isNull(), "text_non_empty": F.trim("text") == "",
            "pages_in_range": ~F.col("page").between(1, PAGES), "categories_known": ~F.col("category").isin(CATEGORIES),
        }),
        Q.duplicates(c, ["id"], "unique_ids"), Q.dangling(c, "parent", c, "id", "parents_resolve"),
        Q.one(c, "table_rows_present", (F.count_if((F.col("category") == "Brand#5") & (F.col("price") > 900)) == 0).cast("int")), Q.between(c, 100, 1000000000, "count_in_bounds"),
    )


QUALITIES = ("good", "fair", "poor")


@query(suite_sql("""WITH p AS (SELECT event_id AS page, event_type AS kind, CASE WHEN value > 100 THEN 'good' WHEN value > 20 THEN 'fair' WHEN value > 1 THEN 'poor' ELSE 'odd' END AS quality,
  CASE WHEN value > 0.1 THEN props ELSE '' END AS labels FROM events WHERE event_id % 11 <> 3), n AS (SELECT count(*) AS most FROM p), w AS (SELECT o_orderkey AS page FROM orders) """, [
    ("required_fields", "count(*) FILTER (WHERE page IS NULL OR kind IS NULL)", "p"), ("requested_present", "count(*)", "w WHERE page NOT IN (SELECT page FROM p)"),
    ("no_duplicate_pages", "count(*) - count(DISTINCT page)", "p"), ("pages_in_range", "count(*) FILTER (WHERE page NOT BETWEEN 1 AND (SELECT most FROM n))", "p"),
    ("kinds_known", "count(*) FILTER (WHERE kind NOT IN ('view', 'click', 'error', 'signup'))", "p"), ("qualities_known", "count(*) FILTER (WHERE quality NOT IN ('good', 'fair', 'poor'))", "p"),
    ("labels_unless_blank", "count(*) FILTER (WHERE labels = '' AND quality <> 'odd')", "p"),
]))
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    p = table(spark, sf_dir, "events").where("event_id % 11 <> 3").select(
        F.col("event_id").alias("page"), F.col("event_type").alias("kind"), F.when(v > 100, "good").when(v > 20, "fair").when(v > 1, "poor").otherwise("odd").alias("quality"), F.when(v > 0.1, F.col("props")).otherwise("").alias("labels"))
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    most = F.broadcast(p.agg(F.count(F.lit(1)).alias("most")))  # one row
    return Q.suite(
        Q.row_checks(p.join(most), {
            "required_fields": F.col("page").isNull() | F.col("kind").isNull(), "pages_in_range": ~F.col("page").between(F.lit(1), F.col("most")),
            "kinds_known": ~F.col("kind").isin("view", "click", "error", "signup"), "qualities_known": ~F.col("quality").isin(*QUALITIES), "labels_unless_blank": (F.col("labels") == "") & (F.col("quality") != "odd"),
        }),
        Q.present(wanted, p, "page", "requested_present"), Q.duplicates(p, ["page"], "no_duplicate_pages"),
    )


@query(suite_sql("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey + CASE WHEN l_orderkey % 499 = 0 THEN 9000000 ELSE 0 END AS clause, l_linenumber AS page, l_quantity AS x0, l_quantity + l_discount * 100 AS x1,
  CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'medium' ELSE CASE WHEN l_tax > 0.07 THEN 'sure' ELSE 'low' END END AS confidence, CASE WHEN l_linestatus = 'F' THEN 'compliant' WHEN l_tax > 0.02 THEN 'missing' ELSE 'vague' END AS indicator,
  l_suppkey % 9 AS plot FROM lineitem), m AS (SELECT DISTINCT l_suppkey % 8 AS plot FROM lineitem) """, [
    ("required_fields", "count(*) FILTER (WHERE id IS NULL OR clause IS NULL)", "f"), ("clauses_resolve", "count(*)", "f WHERE clause NOT IN (SELECT p_partkey FROM part)"),
    ("pages_in_range", "count(*) FILTER (WHERE page NOT BETWEEN 1 AND 6)", "f"), ("boxes_in_page", "count(*) FILTER (WHERE x0 < 0 OR x1 > 55 OR x0 >= x1)", "f"),
    ("confidence_known", "count(*) FILTER (WHERE confidence NOT IN ('high', 'medium', 'low'))", "f"), ("indicator_known", "count(*) FILTER (WHERE indicator NOT IN ('compliant', 'non_compliant', 'missing'))", "f"),
    ("plots_reconciled", "count(*)", "(SELECT DISTINCT plot FROM f) d WHERE plot NOT IN (SELECT plot FROM m)"), ("requested_clauses_present", "count(*)", "part WHERE p_partkey % 50 = 0 AND p_partkey NOT IN (SELECT clause FROM f)"),
]))
def finding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, li, parts = F.col, table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    f = li.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), (c("l_partkey") + F.when(c("l_orderkey") % 499 == 0, 9000000).otherwise(0)).alias("clause"), c("l_linenumber").alias("page"),
        c("l_quantity").alias("x0"), (c("l_quantity") + c("l_discount") * 100).alias("x1"), (c("l_suppkey") % 9).alias("plot"),
        F.when(c("l_returnflag") == "A", "high").when(c("l_returnflag") == "R", "medium").when(c("l_tax") > 0.07, "sure").otherwise("low").alias("confidence"),
        F.when(c("l_linestatus") == "F", "compliant").when(c("l_tax") > 0.02, "missing").otherwise("vague").alias("indicator"),
    )
    wanted = parts.where("p_partkey % 50 = 0").select(c("p_partkey").alias("clause"))
    return Q.suite(
        Q.row_checks(f, {
            "required_fields": c("id").isNull() | c("clause").isNull(), "pages_in_range": ~c("page").between(1, 6), "boxes_in_page": (c("x0") < 0) | (c("x1") > 55) | (c("x0") >= c("x1")),
            "confidence_known": ~c("confidence").isin("high", "medium", "low"), "indicator_known": ~c("indicator").isin("compliant", "non_compliant", "missing"),
        }),
        Q.dangling(f, "clause", parts, "p_partkey", "clauses_resolve"), Q.present(f.select("plot").distinct(), li.select((c("l_suppkey") % 8).alias("plot")), "plot", "plots_reconciled"),
        Q.present(wanted, f, "clause", "requested_clauses_present"),
    )


@query(suite_sql("""WITH k AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 333 = 0 THEN 7000000 ELSE 0 END AS clause, CASE o_orderstatus WHEN 'F' THEN 'agree' WHEN 'O' THEN 'disagree' ELSE 'cannot_determine' END AS verdict,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 40 <> 1 OR o_orderkey % 401 = 0 THEN 'major' END AS severity, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 60 <> 1 THEN o_totalprice END AS extracted, month(o_orderdate) AS page, o_orderdate FROM orders),
  s AS (SELECT verdict AS value, count(*) FILTER (WHERE id % 1000 <> 7) AS n FROM k GROUP BY 1), h AS (SELECT sum(CAST(concat('0x', substring(md5(concat(CAST(c_custkey AS VARCHAR), c_name)), 1, 8)) AS BIGINT)) AS x, sum(CAST(concat('0x', substring(md5(concat(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 1000 = 5 THEN 'edited' ELSE c_name END)), 1, 8)) AS BIGINT)) AS y FROM customer) """, [
    ("required_fields", "count(*) FILTER (WHERE id IS NULL OR verdict IS NULL)", "k"), ("clauses_in_findings", "count(*)", "k WHERE clause NOT IN (SELECT c_custkey FROM customer)"),
    ("pages_in_range", "count(*) FILTER (WHERE page NOT BETWEEN 1 AND 11)", "k"), ("verdicts_known", "count(*) FILTER (WHERE verdict NOT IN ('agree', 'disagree', 'cannot_determine'))", "k"),
    ("severity_iff_disagree", "count(*) FILTER (WHERE (verdict = 'disagree') <> (severity IS NOT NULL))", "k"), ("disagree_has_value", "count(*) FILTER (WHERE verdict = 'disagree' AND extracted IS NULL)", "k"),
    ("input_digest", "count(*) FILTER (WHERE x <> y)", "h"), ("summary_counts", "count(*) FILTER (WHERE n <> own)", "(SELECT value, n, (SELECT count(*) FROM k WHERE verdict = value) AS own FROM s) t"),
]))
def critique_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, customers = F.col, table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, status = c("o_orderkey"), c("o_orderstatus")
    k = o.select(
        key.alias("id"), (c("o_custkey") + F.when(key % 333 == 0, 7000000).otherwise(0)).alias("clause"), F.when(status == "F", "agree").when(status == "O", "disagree").otherwise("cannot_determine").alias("verdict"),
        F.when((status == "O") & (key % 40 != 1) | (key % 401 == 0), "major").alias("severity"), F.when((status == "O") & (key % 60 != 1), c("o_totalprice")).alias("extracted"), F.month("o_orderdate").alias("page"),
    )
    summary = k.groupBy(c("verdict").alias("value")).agg(F.count_if(c("id") % 1000 != 7).alias("n"))
    said = F.when(c("c_custkey") % 1000 == 5, "edited").otherwise(c("c_name"))  # what the critic says it has read
    same = Q.digests(customers, {"a": [c("c_custkey").cast("string"), c("c_name")], "b": [c("c_custkey").cast("string"), said]})
    disagree = c("verdict") == "disagree"
    return Q.suite(
        Q.row_checks(k, {
            "required_fields": c("id").isNull() | c("verdict").isNull(), "pages_in_range": ~c("page").between(1, 11), "verdicts_known": ~c("verdict").isin("agree", "disagree", "cannot_determine"),
            "severity_iff_disagree": disagree != c("severity").isNotNull(), "disagree_has_value": disagree & c("extracted").isNull(),
        }),
        Q.dangling(k, "clause", customers, "c_custkey", "clauses_in_findings"), Q.one(same, "input_digest", F.count_if(~c("a").eqNullSafe(c("b")))), Q.counted(k, "verdict", summary, "summary_counts"),
    )


@query(suite_sql("""WITH b AS (SELECT o_orderkey AS id, o_orderstatus AS verdict, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS notes FROM orders),
  a AS (SELECT id, CASE WHEN id % 500 = 9 THEN 'X' ELSE verdict END AS verdict, CASE WHEN id % 700 = 11 THEN 'changed' ELSE notes END AS notes, CASE WHEN id % 20 = 0 THEN 'critic' WHEN id % 20 = 1 THEN 'hedged' END AS override,
    id % 20 IN (0, 1) AND id % 160 <> 0 AS applied, id % 40 + CASE WHEN id % 900 = 1 THEN 90000000 ELSE 0 END AS clause FROM b),
  d AS (SELECT id FROM a WHERE id % 60 = 0), s AS (SELECT verdict AS value, count(*) FILTER (WHERE id % 1000 <> 7) AS n FROM a GROUP BY 1) """, [
    ("required_fields", "count(*) FILTER (WHERE id IS NULL OR verdict IS NULL)", "a"), ("clauses_resolve", "count(*)", "a WHERE clause NOT IN (SELECT c_custkey FROM customer)"),
    ("disagreements_applied", "count(*)", "d WHERE id NOT IN (SELECT id FROM a WHERE override = 'critic')"), ("verdicts_known", "count(*) FILTER (WHERE verdict NOT IN ('F', 'O', 'P'))", "a"),
    ("passthrough_unchanged", "count(*)", "a JOIN b ON b.id = a.id WHERE a.override IS NULL AND (a.verdict IS DISTINCT FROM b.verdict OR a.notes IS DISTINCT FROM b.notes)"),
    ("input_digest", "CASE WHEN sum(CAST(concat('0x', substring(md5(concat(CAST(id AS VARCHAR), verdict)), 1, 8)) AS BIGINT)) <> sum(CAST(concat('0x', substring(md5(concat(CAST(id AS VARCHAR), CASE WHEN id % 777 = 5 THEN 'Z' ELSE verdict END)), 1, 8)) AS BIGINT)) THEN 1 ELSE 0 END", "b"), ("summary_counts", "count(*) FILTER (WHERE n <> own)", "(SELECT value, n, (SELECT count(*) FROM a WHERE verdict = value) AS own FROM s) t"),
    ("no_orphan_overrides", "count(*) FILTER (WHERE (override IS NOT NULL) <> applied)", "a"), ("hedged_is_no_pass", "count(*) FILTER (WHERE override = 'hedged' AND verdict = 'P')", "a"),
]))
def fused_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, customers = F.col, table(spark, sf_dir, "customer")
    key = c("o_orderkey")
    b = table(spark, sf_dir, "orders").select(key.alias("id"), c("o_orderstatus").alias("verdict"), F.when(key % 3 == 0, c("o_orderpriority")).alias("notes"))
    i = c("id")
    a = b.select(
        "id", F.when(i % 500 == 9, "X").otherwise(c("verdict")).alias("verdict"), F.when(i % 700 == 11, "changed").otherwise(c("notes")).alias("notes"),
        F.when(i % 20 == 0, "critic").when(i % 20 == 1, "hedged").alias("override"), ((i % 20).isin(0, 1) & (i % 160 != 0)).alias("applied"), (i % 40 + F.when(i % 900 == 1, 90000000).otherwise(0)).alias("clause"),
    )
    summary = a.groupBy(c("verdict").alias("value")).agg(F.count_if(i % 1000 != 7).alias("n"))
    read = Q.digests(b, {"a": [i.cast("string"), c("verdict")], "b": [i.cast("string"), F.when(i % 777 == 5, "Z").otherwise(c("verdict"))]})
    return Q.suite(
        Q.row_checks(a, {
            "required_fields": i.isNull() | c("verdict").isNull(), "verdicts_known": ~c("verdict").isin("F", "O", "P"), "no_orphan_overrides": c("override").isNotNull() != c("applied"),
            "hedged_is_no_pass": (c("override") == "hedged") & (c("verdict") == "P"),
        }),
        Q.dangling(a, "clause", customers, "c_custkey", "clauses_resolve"), Q.present(a.where("id % 60 = 0").select("id"), a.where("override = 'critic'"), "id", "disagreements_applied"),
        Q.unchanged(b, a.where("override is null"), "id", ["verdict", "notes"], "passthrough_unchanged"),
        Q.one(read, "input_digest", F.count_if(~c("a").eqNullSafe(c("b")))), Q.counted(a, "verdict", summary, "summary_counts"),
    )
