"""Feedback, diffs, upserts, set operations and routing, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import merging as M
from gaugeline.operators.dedup import numbered, ranked
from gaugeline.plans.registry import query
from gaugeline.sources.tables import preferred, table


@query("""SELECT n_nationkey, coalesce(s.s_name, 'unassigned') AS manager, CAST(count(c.c_custkey) AS BIGINT) AS entries, CAST(count(c.c_custkey) FILTER (WHERE c.c_acctbal > 0) AS BIGINT) AS approved
FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN customer c ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def feedback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("c_acctbal") > 0).alias("approved"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("manager"))
    n = table(spark, sf_dir, "nation").select("n_nationkey").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    return n.select("n_nationkey", F.coalesce("manager", F.lit("unassigned")).alias("manager"), *(F.coalesce(x, F.lit(0)).alias(x) for x in ("entries", "approved")))


@query("""SELECT c_custkey, CASE WHEN o.o_orderstatus = 'P' THEN 'requires_review' ELSE 'pass' END AS verdict, o.o_orderkey AS by_order FROM customer LEFT JOIN
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) o ON o_custkey = c_custkey AND rn = 1""")
def feedback_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.shiftleft("o_orderkey", 1).bitwiseOR((F.col("o_orderstatus") == "P").cast("long"))).alias("o"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")  # a number for (order, is pending): kept in a hash table
    return c.select("c_custkey", F.when(F.col("o").bitwiseAND(F.lit(1)) == 1, "requires_review").otherwise("pass").alias("verdict"), F.shiftright("o", 1).alias("by_order"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1995 AND o_totalprice > 150000), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1996 AND o_totalprice > 150000)
SELECT o_custkey, 'fixed' AS status FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b) UNION ALL SELECT o_custkey, 'still_open' FROM a WHERE o_custkey IN (SELECT o_custkey FROM b)
UNION ALL SELECT o_custkey, 'newly_detected' FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 150000")
    return M.run_diff(o.where(F.year("o_orderdate") == 1995), o.where(F.year("o_orderdate") == 1996), ["o_custkey"])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, year(o_orderdate) AS y FROM orders), src AS (SELECT o_custkey, CASE WHEN max(o_totalprice) > 200000 THEN 'fail' ELSE 'pass' END AS b FROM o WHERE y = 1995 GROUP BY 1),
rsp AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM o WHERE y = 1996), rev AS (SELECT o_custkey, CASE WHEN o_totalprice > 200000 THEN 'fail' ELSE 'pass' END AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM o WHERE y = 1997)
SELECT s.o_custkey, s.b AS before, v.a AS after, CASE WHEN v.a IS NULL THEN 'unclear' WHEN s.b = 'fail' AND v.a = 'pass' THEN 'fixed' WHEN v.a = s.b AND s.b = 'fail' AND r.o_orderstatus IS NOT NULL THEN 'needs fix' WHEN v.a = s.b THEN 'unchanged' ELSE 'needs fix' END AS status
FROM src s LEFT JOIN rsp r ON r.o_custkey = s.o_custkey AND r.rn = 1 LEFT JOIN rev v ON v.o_custkey = s.o_custkey AND v.rn = 1""")
def three_way_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("y"))
    word = F.when(F.col("o_totalprice") > 200000, "fail").otherwise("pass")
    src = o.where("y = 1995").groupBy("o_custkey").agg(F.when(F.max("o_totalprice") > 200000, "fail").otherwise("pass").alias("before"))
    rsp = o.where("y = 1996").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("answer"))
    rev = o.where("y = 1997").select("o_custkey", "o_orderkey", word.alias("after"))
    got = M.three_way(src, rsp, rev, "o_custkey", "o_orderkey")
    return got.select("o_custkey", "before", "after", M.compared(F.col("before"), F.col("after"), F.col("answer").isNotNull()).alias("status"))


@query("""SELECT coalesce(a.c_custkey, b.k) AS c_custkey, coalesce(nullif(b.seg, ''), a.c_mktsegment) AS c_mktsegment FROM customer a FULL JOIN
(SELECT c_custkey + 1000000 * CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'CHANGED' END AS seg FROM customer WHERE c_custkey % 2 = 0) b ON b.k = a.c_custkey""")
def upsert_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    changes = c.where(k % 2 == 0).select(F.when(k % 10 == 0, k + 1000000).otherwise(k).alias("c_custkey"), F.when(k % 4 == 0, "").otherwise("CHANGED").alias("c_mktsegment"))
    return M.upsert(c, changes, "c_custkey", ["c_mktsegment"])


@query("""SELECT v FROM (SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'V' ELSE '' END, CAST(c_custkey AS VARCHAR)) AS v, c_custkey FROM customer) t WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.col("c_custkey").cast("string")
    base = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("v"), text).alias("v"))
    new = c.select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "V").otherwise(""), text).alias("v"))
    return M.insert_absent(base, new, "v", lambda x: F.concat(F.lit("v"), F.regexp_replace(F.lower(F.trim(x)), "^v", "")))


@query("""SELECT section, item, verdict, CAST(row_number() OVER (ORDER BY section, CASE verdict WHEN 'fail' THEN 0 WHEN 'requires_review' THEN 1 WHEN 'pass' THEN 2 ELSE 99 END, item) AS BIGINT) AS place FROM (
 SELECT 1 AS section, o_orderkey AS item, 'fail' AS verdict FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 2, l_orderkey * 10 + l_linenumber, 'pass' FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1
 UNION ALL SELECT 1, o_orderkey, 'requires_review' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' UNION ALL SELECT 2, o_orderkey, 'odd' FROM orders WHERE o_totalprice < 2000) t""")
def union_four_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    row = lambda d, s, k, v: d.select(F.lit(s).alias("section"), k.alias("item"), F.lit(v).alias("verdict"))
    key = F.col("o_orderkey")
    every = (
        row(o.where("o_totalprice > 400000"), 1, key, "fail").unionByName(row(li.where("l_quantity = 50 and l_discount = 0.1"), 2, F.col("l_orderkey") * 10 + F.col("l_linenumber"), "pass"))
        .unionByName(row(o.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"), 1, key, "requires_review")).unionByName(row(o.where("o_totalprice < 2000"), 2, key, "odd"))
    )
    order = [F.col("section"), ranked(F.col("verdict"), ["fail", "requires_review", "pass"]), F.col("item")]
    return numbered(every, order).select("section", "item", "verdict", "place")


@query("""SELECT p_partkey, coalesce(q.m, p_retailprice) AS p_retailprice, coalesce(q.z, p_size) AS p_size FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS m, CASE WHEN l_partkey % 2 = 0 THEN 7 END AS z FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) q ON q.l_partkey = p_partkey""")
def overlay_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("p_retailprice"))
    over = over.withColumn("p_size", F.when(F.col("p_partkey") % 2 == 0, 7))
    return M.overlay(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), over, "p_partkey", ["p_retailprice", "p_size"])


@query("""WITH b AS (SELECT l_suppkey, l_linenumber AS batch, l_partkey % 50 AS label, l_discount FROM lineitem), n AS (SELECT l_suppkey, count(DISTINCT batch) AS nb FROM b GROUP BY 1)
SELECT b.l_suppkey, CAST(label AS BIGINT) AS label, max(l_discount) AS best, string_agg(DISTINCT CAST(batch AS VARCHAR), ',' ORDER BY CAST(batch AS VARCHAR)) AS batches, count(DISTINCT batch) = any_value(nb) AS everywhere FROM b JOIN n ON n.l_suppkey = b.l_suppkey GROUP BY 1, 2""")
def batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("batch"), (F.col("l_partkey") % 50).alias("label"), "l_discount")
    n = b.groupBy("l_suppkey").agg(F.count_distinct("batch").alias("nb"))
    g = b.groupBy("l_suppkey", "label").agg(F.max("l_discount").alias("best"), F.sort_array(F.collect_set("batch")).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x.cast("string")), ",")
    return g.join(n, "l_suppkey").select("l_suppkey", "label", "best", text.alias("batches"), (F.size("s") == F.col("nb")).alias("everywhere"))


@query("""SELECT n_nationkey, segment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = segment AND (c_nationkey + length(c_mktsegment)) % 6 <> 0)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    # requested: every nation with every segment name there is, a short list that unfolds beside each nation
    names = F.broadcast(c.agg(F.collect_set("c_mktsegment").alias("names")))  # one row
    want = table(spark, sf_dir, "nation").select("n_nationkey").join(names).select("n_nationkey", F.explode("names").alias("segment"))
    have = c.where((F.col("c_nationkey") + F.length("c_mktsegment")) % 6 != 0).select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return want.join(have, ["n_nationkey", "segment"], "left_anti")


@query("""SELECT o_orderkey, o_custkey FROM orders a WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority AND b.o_orderstatus <> 'P' AND b.o_orderdate < a.o_orderdate)""")
def dedupe_oldest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    first = a.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("o_orderdate"))
    return a.join(first, ["o_custkey", "o_orderpriority", "o_orderdate"], "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT doc_id, substring(sha256(text), 1, 16) AS content, n > 1 AS duplicate, l.doc_id IS NOT NULL AS has_label FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY source, sha256(text)) AS n FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    n = d.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "h", F.lit(True).alias("dup"))
    has = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("lab")).distinct()
    both = d.join(n, ["source", "h"], "left").join(has, "doc_id", "left")
    return both.select("doc_id", F.substring("h", 1, 16).alias("content"), F.coalesce("dup", F.lit(False)).alias("duplicate"), F.coalesce("lab", F.lit(False)).alias("has_label"))


@query("""SELECT o_custkey, CAST(src AS BIGINT) AS source_rank, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY src) AS rn FROM (SELECT o_custkey, 0 AS src, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1
UNION ALL SELECT o_custkey, 1, max(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, 2, max(o_totalprice) FROM orders GROUP BY 1) u) t WHERE rn = 1""")
def source_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    top = lambda d: d.groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    got = preferred([top(o.where("o_orderstatus = 'P'")), top(o.where("o_orderstatus = 'F'")), top(o)], "o_custkey")
    return got.select("o_custkey", F.col("source_rank").cast("long").alias("source_rank"), "v")


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND value < 5 THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type = 'signup' AND (SELECT count(*) FROM events WHERE event_type IN ('view', 'click') AND value < 5) > 0 THEN 'failed' ELSE 'kept' END AS parent FROM events""")
def orphan_bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    orphan = F.col("event_type").isin("view", "click") & (F.col("value") < 5)
    any_ = F.broadcast(e.agg(F.coalesce(F.max(orphan), F.lit(False)).alias("changed")))  # one row
    return e.join(any_).select("event_id", F.when(orphan, "failed").otherwise(F.col("event_type")).alias("status"), F.when((F.col("event_type") == "signup") & F.col("changed"), "failed").otherwise("kept").alias("parent"))


@query("""SELECT section, CAST(count(*) AS BIGINT) AS comments FROM (SELECT coalesce(d.lang, 'orphan') AS section FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 7) t GROUP BY section""")
def comment_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") * 7).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return c.join(d, "doc_id", "left").groupBy(F.coalesce("lang", F.lit("orphan")).alias("section")).agg(F.sum("n").alias("comments"))


@query("""SELECT coalesce(a.c_custkey, b.o_custkey) AS key, a.c_custkey IS NOT NULL AS in_schema, b.o_custkey IS NOT NULL AS in_layer FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000) b ON b.o_custkey = a.c_custkey""")
def full_outer_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.lit(True).alias("x"))
    b = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("key"), F.lit(True).alias("y")).distinct()
    return a.join(b, "key", "full").select("key", F.col("x").isNotNull().alias("in_schema"), F.col("y").isNotNull().alias("in_layer"))


@query("""WITH v AS (SELECT 'format' AS part, concat('F', CAST(p_partkey % 5 AS VARCHAR)) AS rule_code, CAST(NULL AS BIGINT) AS parcel, CASE WHEN p_size > 40 THEN 'fail' ELSE 'pass' END AS verdict, p_partkey AS id FROM part
 UNION ALL SELECT 'content', concat('C', CAST(o_orderkey % 7 AS VARCHAR)), o_custkey, CASE WHEN o_totalprice > 300000 THEN 'fail' WHEN o_orderstatus = 'P' THEN 'requires_review' ELSE 'pass' END, o_orderkey FROM orders
 UNION ALL SELECT 'discipline', concat('D', CAST(conv_id % 3 AS VARCHAR)), NULL, CASE WHEN length(text) > 100 THEN 'pass' ELSE 'requires_review' END, conv_id * 1000 + turn FROM conversations
 UNION ALL SELECT 'cad', concat('K', CAST(s_suppkey % 2 AS VARCHAR)), s_suppkey, CASE WHEN s_acctbal < 0 THEN 'fail' ELSE 'pass' END, s_suppkey FROM supplier),
f AS (SELECT rule_code, verdict AS said FROM (SELECT concat(CASE event_id % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'C' WHEN 2 THEN 'D' ELSE 'X' END, CAST(event_id % 6 AS VARCHAR)) AS rule_code, CASE WHEN value > 50 THEN 'pass' ELSE 'fail' END AS verdict, event_id FROM events WHERE event_type = 'click') e
 QUALIFY row_number() OVER (PARTITION BY rule_code ORDER BY event_id DESC) = 1)
SELECT v.part, v.rule_code, v.parcel, v.id, coalesce(f.said, v.verdict) AS verdict, f.said IS NOT NULL AND f.said <> v.verdict AS overridden FROM v LEFT JOIN f ON f.rule_code = v.rule_code""")
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission's verdicts of all four parts in one shape, with the last feedback on a rule in place of its verdict."""
    c = F.col
    none = F.lit(None).cast("long")
    rows = lambda df, part, letter, code, parcel, verdict, ident: df.select(F.lit(part).alias("part"), F.concat(F.lit(letter), code.cast("string")).alias("rule_code"), parcel.alias("parcel"), verdict.alias("verdict"), ident.alias("id"))
    k, o, s = c("p_partkey"), c("o_orderkey"), c("s_suppkey")
    every = (
        rows(table(spark, sf_dir, "part"), "format", "F", k % 5, none, F.when(c("p_size") > 40, "fail").otherwise("pass"), k)
        .unionByName(rows(table(spark, sf_dir, "orders"), "content", "C", o % 7, c("o_custkey"), F.when(c("o_totalprice") > 300000, "fail").when(c("o_orderstatus") == "P", "requires_review").otherwise("pass"), o))
        .unionByName(rows(table(spark, sf_dir, "conversations"), "discipline", "D", c("conv_id") % 3, none, F.when(F.length("text") > 100, "pass").otherwise("requires_review"), c("conv_id") * 1000 + c("turn")))
        .unionByName(rows(table(spark, sf_dir, "supplier"), "cad", "K", s % 2, s, F.when(c("s_acctbal") < 0, "fail").otherwise("pass"), s))
    )
    e = c("event_id")
    code = F.concat(F.when(e % 4 == 0, "F").when(e % 4 == 1, "C").when(e % 4 == 2, "D").otherwise("X"), (e % 6).cast("string"))
    said = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy(code.alias("rule_code")).agg(F.max_by(F.when(c("value") > 50, "pass").otherwise("fail"), e).alias("said"))
    return every.join(said, "rule_code", "left").select("part", "rule_code", "parcel", "id", F.coalesce("said", "verdict").alias("verdict"), F.coalesce(c("said") != c("verdict"), F.lit(False)).alias("overridden"))
