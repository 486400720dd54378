"""Run summaries, clusters, best evidence, coverage and distributions, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions import verdicts as V
from gaugeline.operators import rollup
from gaugeline.operators.dedup import LOW_BITS, first_by, low_bits, packed, ranked
from gaugeline.plans.evaluation import JUDGED_SQL, judged
from gaugeline.plans.registry import query
from gaugeline.sources.tables import inline, table, values_sql

VALUES = ", ".join(f"('{v}')" for v in rollup.VERDICTS)


@query(f"""WITH {JUDGED_SQL} SELECT e.verdict, CAST(count(v.entity) AS BIGINT) AS n, (SELECT CAST(count(DISTINCT entity) AS BIGINT) FROM verdicts WHERE verdict IN ('fail', 'fail_borderline')) AS entities_failing
FROM (VALUES {VALUES}) e(verdict) LEFT JOIN verdicts v ON v.verdict = e.verdict GROUP BY e.verdict""")
def run_summary_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = judged(spark, sf_dir).select("entity", "o.verdict")
    counts = v.groupBy("entity").agg(*(F.count_if(F.col("verdict") == x).alias(x) for x in rollup.VERDICTS))
    total = counts.agg(*(F.sum(x).alias(x) for x in rollup.VERDICTS), F.count_if(sum(F.col(x) for x in rollup.FAILURES) > 0).alias("entities_failing"))
    return total.unpivot(["entities_failing"], list(rollup.VERDICTS), "verdict", "n").select("verdict", "n", "entities_failing")


MODES, CONFIDENCES = ("engine_error", "missing_data", "ambiguous_rule", "extraction_failure", "none"), ("high", "medium", "low")
AXES = [("verdict", v) for v in rollup.VERDICTS] + [("failure_mode", m) for m in MODES] + [("confidence", c) for c in CONFIDENCES]


@query(f"""WITH {JUDGED_SQL}, v AS (SELECT entity, verdict, failure_mode, CASE WHEN verdict IN ('pass_with_note', 'fail_borderline') THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN failure_mode <> 'none' THEN substring(sha256(concat(rule_id, '|', failure_mode)), 1, 16) END AS fingerprint FROM verdicts)
SELECT e.axis, e.value, CAST(count(v.entity) AS BIGINT) AS n FROM {values_sql(AXES, "axis, value").replace(" AS t(", " AS e(")}
LEFT JOIN v ON CASE e.axis WHEN 'verdict' THEN v.verdict WHEN 'failure_mode' THEN v.failure_mode ELSE v.confidence END = e.value GROUP BY 1, 2
UNION ALL SELECT 'cluster', fingerprint, count(*) FROM v WHERE fingerprint IS NOT NULL GROUP BY 2 UNION ALL SELECT 'parcels', 'evaluated', count(DISTINCT entity) FROM v
UNION ALL SELECT 'parcels', 'with_failures', count(DISTINCT entity) FROM v WHERE verdict IN ('fail', 'fail_borderline') UNION ALL SELECT 'total', 'violations', count(*) FROM v""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(axis, value, n): a run's counts by verdict, failure mode and confidence, every value of each there, its
    clusters of equal faults, its parcels and their failures."""
    c, o = F.col, F.col("o")
    v = judged(spark, sf_dir).select(
        "entity", o["verdict"].alias("verdict"), o["failure_mode"].alias("failure_mode"), F.when(o["verdict"].isin("pass_with_note", "fail_borderline"), "medium").otherwise("high").alias("confidence"),
        F.when(o["failure_mode"] != "none", V.fingerprint(F.concat_ws("|", "rule_id", o["failure_mode"]))).alias("fingerprint"),
    )
    # one shuffle by entity carries all enumerations; the clusters are of few different faults
    each = v.groupBy("entity").agg(*(F.count_if(c(a) == x).alias(f"{a}/{x}") for a, x in AXES), F.count(F.lit(1)).alias("total/violations"))
    failed = sum(c(f"verdict/{x}") for x in rollup.FAILURES) > 0
    names = [f"{a}/{x}" for a, x in AXES] + ["total/violations"]
    wide = each.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names), F.count(F.lit(1)).alias("parcels/evaluated"), F.count_if(failed).alias("parcels/with_failures"))
    long = wide.unpivot([], wide.columns, "name", "n").select(F.split_part("name", F.lit("/"), F.lit(1)).alias("axis"), F.split_part("name", F.lit("/"), F.lit(2)).alias("value"), "n")
    return long.unionByName(v.where("fingerprint is not null").groupBy(c("fingerprint").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("axis", F.lit("cluster")))


DISPLAY = ("fail", "fail_borderline", "requires_review", "unevaluable", "pass_with_note", "pass", "not_applicable")


@query(f"""WITH {JUDGED_SQL} SELECT e.place, e.verdict, CAST(count(v.entity) AS BIGINT) AS n, CAST(count(v.entity) FILTER (WHERE v.verdict IN ('fail', 'fail_borderline')) AS BIGINT) AS failures,
 CAST(count(v.entity) FILTER (WHERE v.failure_mode = 'ambiguous_rule') AS BIGINT) AS ambiguous FROM {values_sql([(i, v) for i, v in enumerate(DISPLAY)], "place, verdict").replace(" AS t(", " AS e(")} LEFT JOIN verdicts v ON v.verdict = e.verdict GROUP BY 1, 2""")
def opinion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in the order in which an opinion shows them, with what of each is a failure or for want of a clear rule."""
    v, c = judged(spark, sf_dir).select("o.verdict", "o.failure_mode"), F.col
    got = v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("failure_mode") == "ambiguous_rule").alias("ambiguous"))
    order = F.broadcast(inline(spark, list(enumerate(DISPLAY)), "place int, verdict string"))  # seven rows
    some = order.join(got, "verdict", "left").na.fill(0, ["n", "ambiguous"])
    return some.select("place", "verdict", "n", F.when(c("verdict").isin(*rollup.FAILURES), c("n")).otherwise(0).alias("failures"), "ambiguous")


@query(f"""WITH {JUDGED_SQL} SELECT entity, {', '.join(f"CAST(count(*) FILTER (WHERE verdict = '{v}') AS BIGINT) AS {v}" for v in rollup.VERDICTS)} FROM verdicts GROUP BY entity""")
def verdict_pivot_by_parcel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.pivoted(judged(spark, sf_dir).select("entity", "o.verdict"), "entity", "verdict", rollup.VERDICTS)


@query("""WITH g AS (SELECT l_suppkey, l_shipdate, l_linenumber, count(*) AS n, min(l_orderkey) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)
SELECT l_suppkey, l_linenumber, k AS l_orderkey, CAST(n AS BIGINT) AS n FROM g WHERE n >= 2
UNION ALL SELECT l_suppkey, l_linenumber, k, 1 FROM g WHERE n = 1
UNION ALL SELECT l_suppkey, l_linenumber, l_orderkey, 1 FROM lineitem WHERE l_returnflag <> 'R'""")
def cluster_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", "l_returnflag", "l_orderkey")
    got = rollup.fold(li, ["l_suppkey", "l_shipdate", "l_linenumber"], F.col("l_returnflag") == "R", 2, "l_orderkey")
    return got.select("l_suppkey", "l_linenumber", "l_orderkey", "n")


@query("""SELECT l_orderkey, l_linenumber, confidence FROM (SELECT l_orderkey, l_linenumber, c.confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY c.rank, l_linenumber) AS rn
  FROM lineitem JOIN (VALUES ('A', 'high', 0), ('R', 'medium', 1), ('N', 'low', 2)) c(flag, confidence, rank) ON c.flag = l_returnflag) t WHERE rn = 1""")
def best_evidence_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    rank = ranked(F.col("l_returnflag"), ["A", "R", "N"])
    # rank and line in one number, whose least is kept in a hash table and combined before the shuffle; a struct's would be sorted for
    best = li.groupBy("l_orderkey").agg(F.min(packed(rank, F.col("l_linenumber"))).alias("b"))
    name = F.array(*map(F.lit, ("high", "medium", "low")))
    return best.select("l_orderkey", low_bits(F.col("b")).cast("int").alias("l_linenumber"), F.coalesce(F.try_element_at(name, F.shiftright("b", LOW_BITS).cast("int") + 1), F.lit("medium")).alias("confidence"))


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS pages FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) t GROUP BY l_orderkey")
def evidence_page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("p"))
    return li.select("l_orderkey", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


@query("""WITH l AS (SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem) SELECT l_suppkey, CAST(year(l_shipdate) AS BIGINT) AS y, max(l_quantity) AS most, max(l_quantity) - min(l_quantity) AS spread, CAST(count(DISTINCT l_quantity) AS BIGINT) AS kinds,
 CASE WHEN max(l_quantity) > 49 THEN 'over_ceiling' WHEN max(l_quantity) - min(l_quantity) > 40 THEN 'spread' ELSE 'ok' END AS finding
FROM l GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) >= 2""")
def spread_and_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("y")).agg(
        F.max(q).alias("most"), (F.max(q) - F.min(q)).alias("spread"), F.count_distinct(q).alias("kinds"))
    finding = F.when(F.col("most") > 49, "over_ceiling").when(F.col("spread") > 40, "spread").otherwise("ok")
    return g.where("kinds >= 2").withColumn("finding", finding)


@query("""SELECT user_id, low, high, high - low AS height FROM (SELECT user_id, max(value) FILTER (WHERE event_type = 'view' AND value < 60) AS low, min(value) FILTER (WHERE event_type = 'click' AND value BETWEEN 60 AND 100) AS high FROM events GROUP BY user_id) t
WHERE low IS NOT NULL AND high IS NOT NULL""")
def paired_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max(F.when((kind == "view") & (v < 60), v)).alias("low"), F.min(F.when((kind == "click") & v.between(60, 100), v)).alias("high"))
    return g.where("low is not null and high is not null").withColumn("height", F.col("high") - F.col("low"))


KINDS = ("signup", "purchase", "error", "view", "click")


@query(f"""WITH u AS (SELECT DISTINCT user_id % 10 AS grp, event_type FROM events WHERE value > 30), g AS (SELECT DISTINCT user_id % 10 AS grp FROM events), n AS (SELECT count(*) AS total FROM g)
SELECT k.event_type, CAST(count(u.grp) AS BIGINT) AS present, CAST(any_value(total) AS BIGINT) AS total, CASE WHEN count(u.grp) = 0 THEN 'never' WHEN count(u.grp) = any_value(total) THEN 'always' ELSE 'partial' END AS presence
FROM (VALUES {', '.join(f"('{k}')" for k in KINDS)}, ('refund')) k(event_type) CROSS JOIN n LEFT JOIN u ON u.event_type = k.event_type GROUP BY k.event_type""")
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    names = [*KINDS, "refund"]
    g = e.groupBy((F.col("user_id") % 10).alias("grp")).agg(*(F.max((F.col("event_type") == k) & (F.col("value") > 30)).alias(k) for k in names))
    wide = g.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(k)).alias(k) for k in names)).unpivot(["total"], names, "event_type", "present")
    word = F.when(F.col("present") == 0, "never").when(F.col("present") == F.col("total"), "always").otherwise("partial")
    return wide.select("event_type", "present", "total", word.alias("presence"))


BUCKETS = [("en", "main"), ("fr", "other"), ("de", "other")]


@query(f"""SELECT coalesce(b.bucket, 'unmapped') AS bucket, CASE WHEN n_chars >= 3000 THEN 'FULL' WHEN n_chars >= 800 THEN 'PARTIAL' ELSE 'UNADDRESSED' END AS coverage, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents LEFT JOIN {values_sql(BUCKETS, "lang, bucket").replace(" AS t(", " AS b(")} ON b.lang = documents.lang GROUP BY 1, 2""")
def coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars")
    n = F.col("n_chars")
    kind = F.when(n >= 3000, "FULL").when(n >= 800, "PARTIAL").otherwise("UNADDRESSED")
    b = F.broadcast(inline(spark, BUCKETS, "lang string, bucket string"))  # three rows
    return d.join(b, "lang", "left").groupBy(F.coalesce("bucket", F.lit("unmapped")).alias("bucket"), kind.alias("coverage")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH c AS (SELECT d.lang, l.quality, l.toxic, d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS rn FROM c)
SELECT lang, CAST(quality AS BIGINT) AS quality, CAST(count(*) AS BIGINT) AS n, string_agg(CASE WHEN rn <= 3 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS samples FROM s GROUP BY 1, 2""")
def distributions_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    n = d.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))
    few = first_by(d, ["lang", "quality"], [F.col("doc_id").asc()], 3)
    s = few.groupBy("lang", "quality").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return n.join(s, ["lang", "quality"]).select("lang", F.col("quality").cast("long").alias("quality"), "n", "samples")


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / count(*) AS complete, CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE) / count(*) AS unknown
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source HAVING CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) / count(*) < 0.5 OR CAST(count(*) FILTER (WHERE toxic = 1) AS DOUBLE) / count(*) > 0.1""")
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    share = lambda c: F.try_divide(F.count_if(F.col(c) == 1).cast("double"), F.count(F.lit(1)))
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), share("quality").alias("complete"), share("toxic").alias("unknown"))
    return g.where("complete < 0.5 or unknown > 0.1")


@query("""SELECT o_custkey, o_orderkey, CAST(n AS BIGINT) AS n_orders FROM (SELECT o_custkey, o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn <= 3 OR o_orderstatus = 'F' AND rn <= 5""")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    o = o.withColumn("n_orders", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    return o.where("rn <= 3 or o_orderstatus = 'F' and rn <= 5").select("o_custkey", "o_orderkey", "n_orders")


@query("SELECT o_custkey, CAST(coalesce(max(CAST(substring(o_orderpriority, 1, 1) AS BIGINT)), 0) + 1 AS BIGINT) AS next_version FROM orders GROUP BY o_custkey")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.max(F.substring("o_orderpriority", 1, 1).cast("long"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.coalesce(v, F.lit(0)) + 1).alias("next_version"))


@query("SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n, max(p_size) AS most, CAST(sum(CASE WHEN p_size IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN p_name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM part GROUP BY ALL")
def filled_fields_and_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    filled = sum(F.col(c).isNotNull().cast("long") for c in ("p_size", "p_name"))
    return p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("most"), F.sum(filled).alias("filled"))


@query("""SELECT l_suppkey, min(CASE WHEN l_discount > 0.08 THEN 0 WHEN l_discount > 0.05 THEN 1 ELSE 2 END) AS worst, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
 (CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) - 22000000) / 22000000 * 100 AS delta_pct FROM lineitem GROUP BY l_suppkey""")
def severity_and_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.min(F.when(d > 0.08, 0).when(d > 0.05, 1).otherwise(2)).alias("worst"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return g.withColumn("delta_pct", F.try_divide(F.col("total") - 22000000, F.lit(22000000.0)) * 100)


@query(f"""WITH {JUDGED_SQL}, r AS (SELECT entity, verdict, failure_mode, CASE WHEN failure_mode <> 'none' THEN failure_mode ELSE rule_id END AS block, rule_id FROM verdicts),
b AS (SELECT entity, verdict, block, min(rule_id) AS rule_id, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT entity, verdict, block, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY entity ORDER BY CASE verdict {' '.join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(DISPLAY))} ELSE 99 END, rule_id) AS BIGINT) AS place FROM b""")
def parcel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report shows of each parcel: rows of one fault as one block with a count, in the order of display."""
    c, o = F.col, F.col("o")
    r = judged(spark, sf_dir).select("entity", o["verdict"].alias("verdict"), F.when(o["failure_mode"] != "none", o["failure_mode"]).otherwise(c("rule_id")).alias("block"), "rule_id")
    b = r.groupBy("entity", "verdict", "block").agg(F.min("rule_id").alias("rule_id"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(ranked(c("verdict"), list(DISPLAY)), "rule_id"))
    return b.select("entity", "verdict", "block", "n", place.cast("long").alias("place"))
