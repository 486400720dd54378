"""Small text, label and drawing functions, bound to the driver's tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.functions import drawing as D
from gaugeline.functions import text as X
from gaugeline.functions import verdicts as V
from gaugeline.operators import cache as C
from gaugeline.operators import pages as P
from gaugeline.plans.registry import query
from gaugeline.sources.staging import shared_dir
from gaugeline.sources.tables import table

ALIASES = [("ECONOMY", "ECONOMY/BUDGET"), ("LARGE", "LARGE/GRAND")]
SUFFIXES = [r"\s+gear", r"\s+bolt", "hot"]


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULLIF(trim(p_type), '') ELSE p_name || chr(10) || chr(10) || p_type END AS notes, substring(split_part(p_name || ' is here. More', '. ', 1), 1, 12) AS clause,
 CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || ',' || CAST(p_size + 1 AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN NULL ELSE CAST(p_size AS VARCHAR) || ',7,8' END AS plots, split_part(p_name, ' ', 2) IN ('gear', 'bolt') AND split_part(p_name, ' ', 1) IN ('red', 'hot') AS evident,
 replace(replace(p_type, 'ECONOMY', 'ECONOMY/BUDGET'), 'LARGE', 'LARGE/GRAND') AS uses, CASE WHEN p_name IN ('hot gear', 'hot bolt') THEN p_name ELSE regexp_replace(regexp_replace(p_name, '[[:space:]]+gear$', ''), '[[:space:]]+bolt$', '') END AS short FROM part""")
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes appended, first clauses, compound plot labels, labels of known words, land-use aliases, names without suffixes."""
    c, k = F.col, F.col("p_partkey")
    size = c("p_size").cast("string")
    label = F.when(k % 4 == 0, F.concat(size, F.lit(" + "), (c("p_size") + 1).cast("string"))).when(k % 4 == 1, size).when(k % 4 == 2, F.concat(size, F.lit("/x"))).otherwise(F.concat(size, F.lit(", 7/8")))
    plots = F.array_join(F.transform(X.compound_plots(label), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.appended(F.when(k % 3 == 0, "  ").otherwise(c("p_name")), c("p_type")).alias("notes"), X.terse(F.concat(c("p_name"), F.lit(" is here. More")), 12).alias("clause"), plots.alias("plots"),
        X.self_evident(c("p_name"), ["red", "hot", "gear", "bolt"]).alias("evident"), X.replaced(c("p_type"), ALIASES).alias("uses"), X.without_suffixes(c("p_name"), SUFFIXES).alias("short"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 'substantive' WHEN o_orderstatus = 'F' THEN 'unexplained' WHEN o_orderstatus = 'O' AND o_orderkey % 3 > 0 THEN 'conditional' WHEN o_orderstatus = 'O' THEN 'clean' ELSE 'unknown' END AS basis,
 CASE WHEN o_orderkey % 7 = 0 THEN 'not_applicable' WHEN o_orderkey % 5 = 0 THEN 'not_submitted' WHEN o_orderkey % 13 <= 8 THEN 'pass' ELSE 'fail' END AS units, 'requires_review' AS setbacks FROM orders""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basis of a decision, a unit count against its cap, and what only a person can judge."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    verdict = F.when(s == "F", "rejected").when(s == "O", "approved")
    units = V.count_at_most(F.when(k % 5 != 0, k % 13).cast("double"), F.when(k % 7 != 0, 8.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.decision_basis(F.coalesce(verdict, F.lit("open")), k % 3).alias("basis"), units["verdict"].alias("units"), V.qualitative()["verdict"].alias("setbacks"))


EXACT, PREFIXES, PATTERNS = {"Brand#1": "PLOT", "brand#2": "BUILDING"}, [("BRAND#3", "PARKING")], [(r"#(4|5)$", "TREES")]


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'PLOT' WHEN p_brand = 'Brand#2' THEN 'BUILDING' WHEN p_brand LIKE 'Brand#3%' THEN 'PARKING' WHEN p_brand IN ('Brand#4', 'Brand#5') THEN 'TREES' ELSE 'UNKNOWN' END AS role,
 CASE p_partkey % 4 WHEN 0 THEN 'BASEMENT' WHEN 1 THEN 'GROUND_REFERENCE,TRUE_BUILDING_TOP' WHEN 2 THEN CASE WHEN p_size BETWEEN 35 AND 100 THEN 'INTERMEDIATE_LEVEL' ELSE '' END ELSE 'TRUE_BUILDING_TOP' END AS kinds,
 CASE WHEN p_partkey % 3 = 0 THEN 'FULL' WHEN p_partkey % 3 = 1 THEN 'PARTIAL' ELSE 'UNADDRESSED' END AS coverage, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS pixel, p_size > 25 AS outside FROM part""")
def drawing_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer roles in four tiers, kinds of heights, page coverage, worldfiles, and sample points out of bounds."""
    c, k, size = F.col, F.col("p_partkey"), F.col("p_size").cast("double")
    context = F.when(k % 4 == 0, "basement -1").when(k % 4 == 1, "ground/top").when(k % 4 == 3, "roof")
    found = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("b"), F.lit("z"))).otherwise(F.array(F.lit("z")))
    world = F.when(k % 6 == 0, "1.0\n0\n0").otherwise(F.concat(size.cast("string"), F.lit("\n0\n0\n-1.0\r\n100\n200\n")))
    points = F.transform(F.array(*map(F.lit, (1.0, 2.0, 3.0))), lambda t: F.struct((size + t / 100).alias("x"), F.lit(1.0).alias("y")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", D.layer_role(c("p_brand"), EXACT, PREFIXES, PATTERNS).alias("role"), F.array_join(D.dimension_kinds(size, context), ",").alias("kinds"), D.page_coverage(F.array(F.lit("a"), F.lit("b")), found).alias("coverage"),
        D.worldfile(world)["x_size"].alias("pixel"), D.outside_bounds(points, 0.0, 0.0, 26.0, 10.0).alias("outside"),
    )


def spelled(batches):
    """Stands for an expensive call, made once for each value."""
    for b in batches:
        yield pd.DataFrame({"p_type": b["p_type"], "spelled": ["-".join(x) for x in b["p_type"]]})


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_type, '(.)', '\\1-', 'g'), '-$', '') AS spelled FROM part""")
def call_once_per_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.once_per_value(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", "p_type string, spelled string", spelled).select("p_partkey", "spelled")


@query("SELECT DISTINCT sha256(coalesce(text, '')) AS content FROM conversations WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM conversations WHERE conv_id % 3 = 0)")
def cache_miss_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that a cache, filled from a third of the conversations, doesn't hold yet."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    return P.cache_misses(c, c.where("conv_id % 3 = 0"), "content")


MEASURED = "key string, words long, digits long"


@query(r"""WITH c AS (SELECT sha256(coalesce(text, '')) AS key, min(coalesce(text, '')) AS t, bool_or(conv_id % 3 = 0) AS first FROM conversations GROUP BY 1),
m AS (SELECT key, first, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(t, '[0-9]')) AS BIGINT) AS digits FROM c)
SELECT key, CASE WHEN key LIKE 'a%' AND first THEN 5 WHEN key LIKE '7%' AND first THEN 500 ELSE words END AS words, CASE WHEN first AND (key LIKE 'a%' OR key LIKE '7%') THEN 0 ELSE digits END AS digits, CASE WHEN first THEN 1 ELSE 2 END AS run, first AND (key LIKE 'a%' OR key LIKE '7%') AS overridden,
 CASE WHEN CASE WHEN key LIKE 'a%' AND first THEN 5 WHEN key LIKE '7%' AND first THEN 500 ELSE words END <= 100 THEN 'pass' ELSE 'fail' END AS verdict FROM m""")
def extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of contents by their hash: a first run over a third of the conversations, some of whose results are then
    overridden by hand, and a second one over all, which computes only what the store lacks; overrides change verdicts."""
    folder = f"{shared_dir(spark)}/extractions-{uuid.uuid4().hex[:12]}"
    c = table(spark, sf_dir, "conversations").select("conv_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.coalesce("text", F.lit("")).alias("payload"))
    measure = lambda d: d.select("key", F.regexp_count("payload", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.regexp_count("payload", F.lit("[0-9]")).cast("long").alias("digits"))
    got = C.get_or_compute(c.where("conv_id % 3 = 0"), folder, 1, measure, MEASURED)
    by_hand = got.where("key like 'a%'").select("key", F.lit(5).cast("long").alias("words"), F.lit(0).cast("long").alias("digits"), F.lit("counted by hand").alias("note"))
    C.override(by_hand.withColumn("words", F.lit(7).cast("long")).unionByName(got.where("key like '7%'").select("key", F.lit(500).cast("long").alias("words"), F.lit(0).cast("long").alias("digits"), F.lit(None).cast("string").alias("note"))), folder, 1, MEASURED)
    C.override(by_hand, folder, 2, MEASURED)  # the later one wins
    got = C.get_or_compute(c, folder, 2, measure, MEASURED)
    return got.withColumn("verdict", F.when(F.col("words") <= 100, "pass").otherwise("fail"))
