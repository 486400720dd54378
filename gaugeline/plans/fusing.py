"""Evidence matching and fusion, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import text as X
from gaugeline.operators import fusion
from gaugeline.operators import quality_checks as Q
from gaugeline.plans.registry import query
from gaugeline.sources.staging import staged
from gaugeline.sources.tables import inline, table, values_sql

MAPPING = [("1-URGENT", "BUILDING", "same"), ("2-HIGH", "BUILDING", "any"), ("3-MEDIUM", "MACHINERY", "plan_wide"), ("5-LOW", "AUTOMOBILE", "unbound")]


@query(f"""WITH cu AS (SELECT c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 3 END AS plot, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1, 2),
o AS (SELECT o_orderpriority, o_orderkey % 3 AS plot, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o.o_orderpriority, CAST(o.plot AS BIGINT) AS plot, CAST(count(cu.n) AS BIGINT) AS matches, CAST(coalesce(sum(cu.n), 0) AS BIGINT) AS evidence, CAST(any_value(o.n) AS BIGINT) AS findings
FROM o JOIN {values_sql(MAPPING, "priority, segment, scope").replace(" AS t(", " AS m(")} ON m.priority = o.o_orderpriority LEFT JOIN cu ON cu.c_mktsegment = m.segment AND
 (m.scope = 'any' OR m.scope = 'same' AND o.plot = cu.plot OR m.scope = 'plan_wide' AND cu.plot IS NULL OR m.scope = 'unbound' AND (cu.plot IS NULL OR o.plot = cu.plot)) GROUP BY 1, 2""")
def mapping_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # evidence and findings are summed by (key, plot) before they meet
    key = F.col("c_custkey")
    cu = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.when(key % 4 != 0, key % 3).alias("eplot")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 3).alias("plot")).agg(F.count(F.lit(1)).alias("findings"))
    m = inline(spark, MAPPING, "o_orderpriority string, segment string, scope string")
    o = o.join(m, "o_orderpriority")
    both = o.join(cu, (o["segment"] == cu["segment"]) & fusion.plot_binds(o["scope"], o["plot"], cu["eplot"]), "left")
    return both.groupBy("o_orderpriority", "plot").agg(F.count("n").alias("matches"), F.coalesce(F.sum("n"), F.lit(0)).alias("evidence"), F.first("findings").alias("findings"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE agree) AS BIGINT) AS agreed, CAST(count(*) FILTER (WHERE agree) AS DOUBLE) / count(*) * 100 AS agreement_pct
FROM (SELECT d.source, (CASE WHEN d.n_chars >= 200 THEN 1 ELSE 0 END) = l.quality AS agree FROM documents d JOIN labels l ON l.doc_id = d.doc_id) t GROUP BY source""")
def critic_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    agree = (F.col("n_chars") >= 200).cast("int") == F.col("quality")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("agreed"), (F.try_divide(F.count_if(agree).cast("double"), F.count(F.lit(1))) * 100).alias("agreement_pct"))


@query("""WITH c AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT p_partkey, p_size % 10 AS want FROM part)
SELECT p_partkey, l_orderkey, l_linenumber FROM (SELECT f.p_partkey, c.l_orderkey, c.l_linenumber, row_number() OVER (PARTITION BY f.p_partkey ORDER BY CASE WHEN c.l_suppkey % 10 = f.want THEN 0 ELSE 1 END, c.l_orderkey, c.l_linenumber) AS rn
FROM f LEFT JOIN c ON c.l_partkey = f.p_partkey) t WHERE rn = 1""")
def critic_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey")
    f = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 10).alias("want"))
    # (other page, order, line) in two numbers, each the least of a hash table: lines of an order are under 2^12
    line = F.shiftleft("l_orderkey", 12).bitwiseOR(F.col("l_linenumber").cast("long"))
    own = F.col("l_suppkey") % 10 == F.col("want")
    best = f.join(c, "p_partkey").groupBy("p_partkey").agg(F.min(F.when(own, line)).alias("own"), F.min(line).alias("any")).withColumn("b", F.coalesce("own", "any"))
    return f.select("p_partkey").join(best, "p_partkey", "left").select("p_partkey", F.shiftright("b", 12).alias("l_orderkey"), F.col("b").bitwiseAND(F.lit(4095)).cast("int").alias("l_linenumber"))


NOTES = [f"as measured, {m} on sheet 2" for m in fusion.HEDGING_MARKERS] + ["measured", None]
FUSED_SQL = f"""b AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'fail' ELSE 'requires_review' END AS verdict,
   n.note AS notes, o_custkey, l.l_orderkey AS evidence_id, o_totalprice, CAST(floor(o_totalprice / 1000) AS BIGINT) AS sub, 150 AS lim,
   q IS NOT NULL AND o_orderkey % 5 <> 0 AS matched, CASE WHEN o_orderkey % 11 = 0 THEN 'disagree' ELSE 'agree' END AS critic, o_orderkey % 13 = 0 AS deferred,
   CASE CAST(q AS BIGINT) % 4 WHEN 0 THEN 'compliant' WHEN 1 THEN 'non_compliant' WHEN 2 THEN 'missing' ELSE 'odd' END AS indicator, CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'low' END AS confidence
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
  LEFT JOIN {values_sql([(i, x) for i, x in enumerate(NOTES)], "i, note").replace(" AS t(", " AS n(")} ON n.i = o_orderkey % 19),
f AS (SELECT *, verdict = 'pass' AND ({' OR '.join(f"coalesce(notes, '') LIKE '%{m}%'" for m in fusion.HEDGING_MARKERS)}) AS hedged, verdict = 'pass' AND sub <= lim AS sure,
   CASE indicator WHEN 'compliant' THEN 'pass' WHEN 'non_compliant' THEN 'fail' WHEN 'missing' THEN 'not_submitted' ELSE 'requires_review' END AS ev FROM b),
s AS (SELECT *, CASE WHEN NOT matched AND hedged THEN 1 WHEN NOT matched THEN 0 WHEN hedged THEN 2 WHEN critic = 'disagree' AND sure THEN 3 WHEN critic = 'disagree' THEN 4 WHEN deferred THEN 5
   WHEN confidence = 'high' AND ev <> verdict AND sure THEN 6 WHEN confidence = 'high' AND ev <> verdict THEN 7 ELSE 8 END AS st FROM f),
fused AS (SELECT *, CASE WHEN st IN (1, 2, 4) THEN 'requires_review' WHEN st = 7 THEN ev ELSE verdict END AS final_verdict,
 CASE WHEN st IN (1, 2) THEN 'hedged_reasoning_escalation' WHEN st = 4 THEN 'm3_critic_disagreement' WHEN st = 7 THEN 'm2_finding' WHEN st = 5 THEN 'dwg_deferred_annotation' WHEN st IN (3, 6) THEN 'm2_provenance_suppressed' END AS override_source,
 st IN (3, 6) AS sidecar, st IN (2, 5, 6, 8) AS annotated FROM s)"""


def fused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    o = table(spark, sf_dir, "orders").join(q, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k = F.col("o_orderkey")
    verdict = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").otherwise("requires_review")
    notes = F.try_element_at(F.array(*map(F.lit, NOTES)), (k % 19 + 1).cast("int"))
    r = F.col("q") % 4
    rows = o.select(
        "o_orderkey", "o_custkey", "o_totalprice", notes.alias("notes"), F.col("l_orderkey").alias("evidence_id"), verdict.alias("verdict"), fusion.hedged(verdict, notes, fusion.HEDGING_MARKERS).alias("hedged"), (F.col("q").isNotNull() & (k % 5 != 0)).alias("matched"),
        F.when(k % 11 == 0, "disagree").otherwise("agree").alias("critic"), (k % 13 == 0).alias("deferred"),
        fusion.numeric_pass(verdict, F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("150")).alias("sure_pass"),
        F.when(r == 0, "compliant").when(r == 1, "non_compliant").when(r == 2, "missing").otherwise("odd").alias("indicator"), F.when(k % 3 == 0, "high").otherwise("low").alias("confidence"),
    )
    return fusion.fuse(rows)


@query(f"WITH {FUSED_SQL} SELECT o_orderkey, final_verdict, override_source, sidecar, annotated FROM fused")
def fusion_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_rows(spark, sf_dir).select("o_orderkey", "final_verdict", "override_source", "sidecar", "annotated")


@query(f"""WITH {FUSED_SQL} SELECT 'before' AS part, verdict AS value, CAST(count(*) AS BIGINT) AS n FROM fused GROUP BY 2 UNION ALL SELECT 'after', final_verdict, count(*) FROM fused GROUP BY 2
UNION ALL SELECT 'source', override_source, count(*) FROM fused WHERE override_source IS NOT NULL GROUP BY 2 UNION ALL SELECT 'new', final_verdict, count(*) FROM fused WHERE final_verdict = 'fail' AND verdict <> 'fail' GROUP BY 2""")
def fusion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fusion changed a run, from one pass: verdicts before and after, sources of overrides, failures that are new."""
    f, c = fused_rows(spark, sf_dir), F.col
    new = F.when((c("final_verdict") == "fail") & (c("verdict") != "fail"), "fail")
    parts = {"before": c("verdict"), "after": c("final_verdict"), "source": c("override_source"), "new": new}
    facts = F.array(*(F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()))
    return f.select(F.explode(facts).alias("x")).select("x.*").where("value is not null").groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FUSED_SQL}, h AS (SELECT sum(CAST(concat('0x', substring(md5(concat(CAST(o_orderkey AS VARCHAR), verdict)), 1, 8)) AS BIGINT)) AS engine, sum(CASE WHEN evidence_id IS NOT NULL THEN CAST(concat('0x', coalesce(substring(md5(CAST(evidence_id AS VARCHAR)), 1, 8), '0')) AS BIGINT) END) AS evidence FROM b)
SELECT 'finding' AS kind, o_orderkey, final_verdict AS verdict, CASE WHEN override_source IS NOT NULL THEN concat(coalesce(notes || chr(10) || chr(10), ''), override_source) ELSE notes END AS notes, CAST(engine AS BIGINT) AS engine_digest, CAST(evidence AS BIGINT) AS evidence_digest FROM fused, h
UNION ALL SELECT 'sidecar', o_orderkey, ev, concat('beside ', verdict), CAST(engine AS BIGINT), CAST(evidence AS BIGINT) FROM fused, h WHERE sidecar""")
def fused_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused rows with their notes, the sidecar rows beside them, and on every row the digests of both inputs."""
    f, c = staged(fused_rows(spark, sf_dir), "fused"), F.col  # fused once, read for the digests and for the rows
    both = Q.digests(f, {"engine_digest": [c("o_orderkey").cast("string"), c("verdict")], "evidence_digest": [c("evidence_id").cast("string")]})
    notes = F.when(c("override_source").isNotNull(), X.appended(c("notes"), c("override_source"))).otherwise(c("notes"))
    row = lambda kind, verdict, note: F.struct(F.lit(kind).alias("kind"), "o_orderkey", verdict.alias("verdict"), note.alias("notes"))
    beside = F.when(c("sidecar"), row("sidecar", fusion.indicator_verdict(c("indicator")), F.concat(F.lit("beside "), c("verdict"))))
    rows = f.select(F.explode(F.filter(F.array(row("finding", c("final_verdict"), notes), beside), lambda r: r.isNotNull())).alias("r")).select("r.*")
    return rows.join(F.broadcast(both))  # one row
