"""Text rules, classification, segmentation and parsing, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeline.functions import text as X
from gaugeline.operators.dedup import numbered
from gaugeline.plans.registry import query
from gaugeline.sources.tables import page_numbers, table, values_sql

TERMS = [("fire", "the and"), ("fire", "idiot"), ("trees", "und die"), ("trees", "les des"), ("water", "zzzz")]


@query(f"""SELECT r.rule, coalesce(bool_or(position(r.term IN lower(d.text)) > 0), false) AS found, CAST(min(CASE WHEN position(r.term IN lower(d.text)) > 0 THEN d.doc_id END) AS BIGINT) AS first_page,
 CASE WHEN bool_or(position(r.term IN lower(d.text)) > 0) THEN 'pass' WHEN r.rule = 'water' THEN 'fail' ELSE 'requires_review' END AS verdict
FROM {values_sql(TERMS, "rule, term").replace(" AS t(", " AS r(")} CROSS JOIN documents d GROUP BY r.rule""")
def text_pattern_any_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the terms are few and given: one pass over the texts with a column for each rule
    low = F.lower("text")
    rules = {r: [t for q, t in TERMS if q == r] for r, _ in TERMS}
    d = table(spark, sf_dir, "documents").select("doc_id", *(F.greatest(*(F.instr(low, F.lit(t)) > 0 for t in ts), F.lit(False)).alias(r) for r, ts in rules.items()))
    wide = d.agg(*(F.min(F.when(F.col(r), F.col("doc_id"))).alias(r) for r in rules))
    long = wide.unpivot([], list(rules), "rule", "first_page")
    hit = F.col("first_page").isNotNull()
    return long.select("rule", hit.alias("found"), "first_page", F.when(hit, "pass").when(F.col("rule") == "water", "fail").otherwise("requires_review").alias("verdict"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{3}')) AS BIGINT) AS hits, CASE WHEN len(regexp_extract_all(text, '[0-9]{3}')) >= 2 THEN 'pass' ELSE 'fail' END AS verdict FROM documents WHERE regexp_matches(text, '[0-9]{3}')""")
def regex_hit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count("text", F.lit("[0-9]{3}")).cast("long")
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]{3}")).select("doc_id", n.alias("hits"))
    return d.withColumn("verdict", F.when(F.col("hits") >= 2, "pass").otherwise("fail"))


@query("""WITH h AS (SELECT doc_id, (CASE WHEN position(' the ' IN text) > 0 THEN 1 ELSE 0 END) + (CASE WHEN position(' with ' IN text) > 0 THEN 1 ELSE 0 END) + (CASE WHEN position(' from ' IN text) > 0 THEN 1 ELSE 0 END) AS terms FROM documents)
SELECT CAST(terms AS BIGINT) AS terms, CAST(count(*) AS BIGINT) AS pages, min(doc_id) AS first_page FROM h GROUP BY 1""")
def terms_on_same_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sum((F.instr("text", F.lit(f" {t} ")) > 0).cast("long") for t in ("the", "with", "from"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("terms")).groupBy("terms").agg(F.count(F.lit(1)).alias("pages"), F.min("doc_id").alias("first_page"))


CLASSES = [("symbols", "[$%&*]{3}"), ("shouting", "!!"), ("piped", " [|] "), ("address", "[a-z]+@[a-z]+"), ("number", "[0-9]{4}")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in CLASSES) + " ELSE 'plain' END AS class FROM documents")
def first_match_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_class(F.col("text"), CLASSES, "plain").alias("class"))


WORDS = ["the", "die", "les", "que", "and"]


@query("""WITH h AS (SELECT doc_id, text, w.i, w.word, position(w.word IN text) AS pos FROM documents CROSS JOIN (VALUES """ + ", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS)) + """) w(i, word) WHERE position(w.word IN text) > 0)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, word, substring(text, pos, 120) AS span FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS rn FROM h) t WHERE rn = 1""")
def earliest_pattern_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.earliest(F.col("text"), WORDS).alias("e"))
    return d.where("e.at is not null").select("doc_id", F.col("e.at").cast("long").alias("pos"), "e.word", "e.span")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS seen FROM l WHERE line <> ''),
k AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, max(i) OVER (PARTITION BY doc_id) AS last FROM s WHERE seen = 1)
SELECT doc_id, CAST(i AS BIGINT) AS start_line, CAST(coalesce(nxt, last + 1) AS BIGINT) AS end_line, concat('f', lpad(CAST(seq AS VARCHAR), 3, '0')) AS item FROM k""")
def segments_by_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("line <> ''")
    # the first of equal lines of a document starts a segment, which ends where the next starts
    first = d.groupBy("doc_id", "line").agg((F.min("i") + 1).alias("i"))
    w = Window.partitionBy("doc_id").orderBy("i")
    last = F.max("i").over(Window.partitionBy("doc_id"))
    return first.select("doc_id", F.col("i").cast("long").alias("start_line"), F.coalesce(F.lead("i").over(w), last + 1).cast("long").alias("end_line"), F.format_string("f%03d", F.row_number().over(w)).alias("item"))


@query(r"""WITH p AS (SELECT p_name AS name, count(*) AS parts, list_distinct(list_filter(string_split_regex(lower(p_name), '[\s,/()]+'), lambda x: x <> '')) AS t FROM part GROUP BY p_name),
q AS (SELECT DISTINCT concat(p_name, ' (', p_type, ')') AS label, list_distinct(list_filter(string_split_regex(lower(concat(p_name, ' ', p_type)), '[\s,/()]+'), lambda x: x <> '')) AS t FROM part)
SELECT name, label, CAST(parts AS BIGINT) AS parts, CAST(len(list_intersect(p.t, q.t)) AS DOUBLE) / len(list_distinct(list_concat(p.t, q.t))) AS score FROM p JOIN q ON CAST(len(list_intersect(p.t, q.t)) AS DOUBLE) / len(list_distinct(list_concat(p.t, q.t))) >= 0.5""")
def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_type")
    a = p.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("parts")).withColumn("t", X.tokens(F.lower(F.col("name"))))
    b = p.distinct().select(F.format_string("%s (%s)", "p_name", "p_type").alias("label"), X.tokens(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("u"))
    a, b = a.select("name", "parts", "t"), b.select("label", "u")
    # common words would pair nearly all names: each set's words are put in order of rarity, and of n words only the
    # first n - ceil(least * n) + 1 are looked at, one of which any pair that is alike enough shares
    words = a.select(F.explode("t").alias("w")).unionByName(b.select(F.explode("u").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("f"))

    def rare(d, key, tokens):
        n = F.size("o")
        each = d.select(key, F.explode(tokens).alias("w")).join(words, "w").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
        return each.select(key, F.explode(F.slice("o", F.lit(1), n - F.ceil(n * F.lit(0.5)).cast("int") + 1)).alias("x")).select(key, "x.w")

    pairs = rare(a, "name", "t").join(rare(b, "label", "u"), "w").select("name", "label").distinct()
    both = pairs.join(a, "name").join(b, "label")
    return both.select("name", "label", "parts", X.jaccard(F.col("t"), F.col("u")).alias("score")).where("score >= 0.5")


@query("""SELECT doc_id, a AS latin, CASE WHEN a + b = 0 THEN NULL ELSE CAST(a AS DOUBLE) / (a + b) END AS share, a + b > 0 AND CAST(a AS DOUBLE) / (a + b) >= 0.3 AND a >= 4 AS predominantly
FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS a, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS b FROM documents) t""")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = X.script_share(F.col("text"), "[A-Za-z]", "[A-Za-z0-9]")
    latin = F.regexp_count("text", F.lit("[A-Za-z]")).cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", latin.alias("latin"), share.alias("share"))
    return d.withColumn("predominantly", F.coalesce((F.col("share") >= 0.3) & (F.col("latin") >= 4), F.lit(False)))


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS num, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS exact_price,
 CAST(p_size AS DOUBLE) AS low, CAST(p_size + 5 AS DOUBLE) AS high, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey AS INTEGER) END AS plot FROM part""")
def value_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = X.number_range(F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + 5).cast("string"), F.lit(" m")))
    label = F.concat(F.when(F.col("p_partkey") % 3 == 0, "lot_").otherwise("plot_"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.first_number(F.col("p_brand")).alias("num"), X.whole(F.col("p_retailprice")).alias("exact_price"), span["low"].alias("low"), span["high"].alias("high"), X.plot_number(label).alias("plot"))


@query(r"""SELECT doc_id, sha256(trim(replace(regexp_replace(text, '[[:space:]]+', ' ', 'g'), 'the', 'THE'))) AS cleaned, sha256(nullif(regexp_replace(text, '[""" + X.SPACE + r""",/().\-–—]+', '', 'g'), '')) AS squashed FROM documents""")
def normalise_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.replaced(X.normalised(text), [("the", "THE")]), 256).alias("cleaned"), F.sha2(X.squashed(text), 256).alias("squashed"))


@query("""WITH b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), n AS (SELECT item_id, w, count(*) AS c FROM b GROUP BY 1, 2),
m AS (SELECT item_id + 1 AS item_id, w, count(*) AS c FROM b GROUP BY 1, 2) SELECT n.item_id, CAST(count(*) FILTER (WHERE coalesce(m.c, 0) < n.c) AS BIGINT) AS lost, bool_and(coalesce(m.c, 0) >= n.c) AS preserved
FROM n LEFT JOIN m ON m.item_id = n.item_id AND m.w = n.w GROUP BY 1""")
def token_multiset_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w"))
    n = b.groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("c"))
    m = n.select((F.col("item_id") + 1).alias("item_id"), "w", F.col("c").alias("k"))
    both = n.join(m, ["item_id", "w"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return both.groupBy("item_id").agg(F.count_if(F.col("k") < F.col("c")).alias("lost"), F.min(F.col("k") >= F.col("c")).alias("preserved"))


@query("""SELECT page_id, replace(replace(replace(coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(regexp_extract(html, '<a href="([^"]*)"', 1), '')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title,
 length(html) - length(replace(html, '<p', 'x')) AS paragraphs FROM pages""")
def html_escape_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = X.html_escaped(X.first_match(F.col("html"), ["<title>([^<]*)</title>", '<a href="([^"]*)"']))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<p")).cast("long").alias("paragraphs"))


@query("""SELECT conv_id, turn, CASE WHEN length(trim(text)) < 40 THEN 'error' WHEN length(text) > 600 THEN 'truncated' ELSE 'ok' END AS guard, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 197), '...') ELSE text END AS shown,
 CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'general' END AS category, substring(trim(text), 1, 50) AS fallback FROM conversations""")
def truncate_and_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    guard = F.when(F.length(F.trim("text")) < 40, "error").when(F.length("text") > 600, "truncated").otherwise("ok")
    kind = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("general")
    return c.select("conv_id", "turn", guard.alias("guard"), X.capped(F.col("text")).alias("shown"), kind.alias("category"), F.substring(F.trim("text"), 1, 50).alias("fallback"))


@query("""SELECT section, CAST(row_number() OVER (ORDER BY a, b, section) AS BIGINT) AS place, n FROM (SELECT concat(CAST(p_size AS VARCHAR), '.', CAST(p_partkey % 12 AS VARCHAR)) AS section, p_size AS a, p_partkey % 12 AS b, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL) t""")
def natural_section_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string"))
    g = table(spark, sf_dir, "part").groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(g.withColumn("key", X.section_key(F.col("section"))), [F.col("key"), F.col("section")]).select("section", "place", "n")


@query("""SELECT o_orderkey, concat('rev', CAST(o_orderkey % 20 + 1 AS VARCHAR)) AS next_rev, concat('v', CAST(o_orderkey % 9 AS VARCHAR), '.1') AS canonical, CAST(o_orderdate AS DATE) AS session_date FROM orders""")
def version_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat_ws("/", F.dayofmonth("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.year("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", X.next_revision(F.concat(F.lit("rev"), (k % 20).cast("string"))).alias("next_rev"), X.canonical_version(F.concat(F.lit(" V"), (k % 9).cast("string"), F.lit(".1"))).alias("canonical"), X.iso_date(text).alias("session_date"),
    )


LABEL_SQL = "concat('סע:יף ', CAST(p_partkey AS VARCHAR), 'מ ', repeat('א.ב ', p_partkey % 3), CASE p_partkey % 5 WHEN 0 THEN 'תכ.נית' WHEN 1 THEN 'תכ  נית' WHEN 2 THEN 'תכ-- נית' ELSE 'תכן' END, CASE WHEN p_partkey % 4 = 0 THEN ' § 5' ELSE '' END, ' a:b')"


@query(rf"""SELECT p_partkey, regexp_replace({LABEL_SQL}, '([\x{{0590}}-\x{{05FF}}])[:.]([\x{{0590}}-\x{{05FF}}])', '\1\2', 'g') AS cleaned, regexp_replace(regexp_replace({LABEL_SQL}, '(\pL)([0-9])', '\1 \2', 'g'), '([0-9])(\pL)', '\1 \2', 'g') AS spaced,
 p_partkey % 5 < 2 AS loose, replace(replace({LABEL_SQL}, 'א.ב', 'AB'), '§', 'סעיף') AS replaced, CAST(p_partkey % 3 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS hits FROM part""")
def hebrew_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with stray marks between Hebrew letters, digits without spaces, and letters pulled apart."""
    k = F.col("p_partkey")
    plan = F.when(k % 5 == 0, "תכ.נית").when(k % 5 == 1, "תכ  נית").when(k % 5 == 2, "תכ-- נית").otherwise("תכן")
    label = F.concat(F.lit("סע:יף "), k.cast("string"), F.lit("מ "), F.repeat(F.lit("א.ב "), (k % 3).cast("int")), plan, F.when(k % 4 == 0, " § 5").otherwise(""), F.lit(" a:b"))
    p = table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))
    pairs = [("א.ב", "AB"), ("§", "סעיף")]
    return p.select(
        "p_partkey", X.strip_between_hebrew(F.col("label")).alias("cleaned"), X.space_at_digit_borders(F.col("label")).alias("spaced"), F.col("label").rlike(X.loose_pattern("תכנית")).alias("loose"),
        X.replaced(F.col("label"), pairs).alias("replaced"), X.replacements(F.col("label"), pairs).alias("hits"),
    )


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 9 + 1 AS n, o_orderkey % 4 + 1 AS a, o_orderkey % 4 + 1 + o_orderkey % 3 AS b, o_orderkey % 6 + 1 AS c FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN array_to_string(range(1, n + 1), ',') WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN b <= n AND c <= n THEN array_to_string(list_sort(list_distinct(list_concat(range(a, b + 1), [c]))), ',') END
  ELSE CASE WHEN c <= n THEN CAST(c AS VARCHAR) END END AS pages FROM s""")
def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, c = k % 4 + 1, k % 6 + 1
    text = lambda x: x.cast("string")
    spec = F.when(k % 5 == 0, " All ").when(k % 5 == 1, F.concat(text(a), F.lit("-x"))).when(k % 5 == 2, F.concat(text(a), F.lit("-"), text(a + k % 3), F.lit(", "), text(c))).otherwise(text(c))
    o = table(spark, sf_dir, "orders").select("o_orderkey", spec.alias("spec"), (k % 9 + 1).alias("n"))
    pages = F.transform(page_numbers(F.col("spec"), F.col("n")), lambda x: x.cast("string"))
    return o.select("o_orderkey", F.array_join(pages, ",").alias("pages"))


PAGE_TERMS = ("the", "and", "der", "les", "que")
#: Check methods in the order of the format rules; each has a handler over a document's pages.
METHODS = (
    "pdf_metadata", "text_extraction", "regex_pattern", "table_detection", "pdf_image_detection", "page_structure_analysis", "manual_review", "pixel_color_sample", "regex_on_plan_pages", "footer_image_count",
)


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, pages): a conversation's turns as the pages of a document, in order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), "role").alias("p"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))


PAGED_SQL = """t AS (SELECT conv_id, list(struct_pack(turn := turn, text := coalesce(text, ''), role := role) ORDER BY turn) AS pages FROM conversations GROUP BY 1)"""
FOUND_SQL = "list_filter([" + ", ".join(f"'{t}'" for t in PAGE_TERMS) + "], lambda x: contains({0}, x))"


@query(f"""WITH {PAGED_SQL}, l AS (SELECT *, list_filter(list_transform(flatten(list_transform(pages, lambda p: string_split(p.text, chr(10)))), lambda x: trim(x)), lambda x: length(x) >= 10) AS lines, array_to_string(list_transform(pages, lambda p: p.text), chr(10)) AS all_text,
  list_distinct(list_filter(list_transform(string_split_regex(pages[1].text, '[|·•\n\r\t.]'), lambda x: trim(x)), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+'))) AS tokens FROM t),
m AS (SELECT *, list_sort(list_transform(tokens, lambda x: struct_pack(n := -len(list_filter(pages, lambda p: contains(p.text, x))), l := -length(x), token := x)))[1] AS best FROM l)
SELECT conv_id, CAST(len(lines) AS BIGINT) AS blocks, CASE WHEN len(lines) > 0 THEN CAST(len(list_filter(lines, lambda x: regexp_matches(regexp_extract(x, '[A-Za-zÀ-ÿ]'), '[A-Z]'))) AS DOUBLE) / len(lines) END AS block_ratio, CAST(len({FOUND_SQL.format("all_text")}) AS BIGINT) AS distinct_terms,
 CAST(list_min(list_transform(list_filter(pages, lambda p: len({FOUND_SQL.format("p.text")}) >= 2), lambda p: p.turn)) AS BIGINT) AS same_page, len({FOUND_SQL.format("all_text")}) = {len(PAGE_TERMS)} AS all_terms, best.token AS token, CAST(-best.n AS BIGINT) AS token_pages,
 CAST(list_sum(list_transform(pages, lambda p: len(regexp_extract_all(p.text, '[a-z]+tion')))) AS BIGINT) AS matches, CAST(len(list_filter(pages, lambda p: regexp_matches(p.text, '[a-z]+tion'))) AS BIGINT) AS hit_pages FROM m""")
def text_extraction_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six text rules over a document's pages: share of lines that begin in a script, distinct terms, terms on one
    page, all terms, the first page's token on most pages, and counts of a pattern and of the pages it hits."""
    c = F.col
    found = lambda text: F.filter(F.array(*map(F.lit, PAGE_TERMS)), lambda t: F.contains(text, t))
    texts = F.transform("pages", lambda p: p["text"])
    lines = F.filter(F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, "\n"))), lambda x: F.trim(x)), lambda x: F.length(x) >= 10)
    tokens = F.array_distinct(F.filter(F.transform(F.split(F.element_at(texts, 1), r"[|·•\n\r\t.]"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 4) & ~x.rlike("^[0-9]+$")))
    d = paged(spark, sf_dir).select("conv_id", "pages", texts.alias("texts"), lines.alias("lines"), F.array_join(texts, "\n").alias("text"), tokens.alias("tokens"))
    best = F.array_min(F.transform("tokens", lambda t: F.struct((-F.size(F.filter(c("texts"), lambda p: F.contains(p, t)))).alias("n"), (-F.length(t)).alias("l"), t.alias("token"))))
    upper = F.size(F.filter("lines", lambda x: F.regexp_extract(x, "[A-Za-zÀ-ÿ]", 0).rlike("[A-Z]")))
    first = F.array_min(F.transform(F.filter("pages", lambda p: F.size(found(p["text"])) >= 2), lambda p: p["turn"]))
    counts = F.transform("texts", lambda t: F.regexp_count(t, F.lit("[a-z]+tion")))
    return d.select(
        "conv_id", F.size("lines").cast("long").alias("blocks"), F.try_divide(upper.cast("double"), F.size("lines")).alias("block_ratio"), F.size(found(c("text"))).cast("long").alias("distinct_terms"), first.cast("long").alias("same_page"),
        (F.size(found(c("text"))) == len(PAGE_TERMS)).alias("all_terms"), best["token"].alias("token"), (-best["n"]).cast("long").alias("token_pages"),
        F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("matches"), F.size(F.filter(counts, lambda x: x > 0)).cast("long").alias("hit_pages"),
    )


METHOD_SQL = {
    "pdf_metadata": "len(pages) >= 2", "text_extraction": "contains(pages[1].text, 'the')", "regex_pattern": "len(list_filter(pages, lambda p: regexp_matches(p.text, '[0-9]+'))) >= 1", "table_detection": "len(list_filter(pages, lambda p: contains(p.text, ' | '))) > 0",
    "pdf_image_detection": "len(list_filter(pages, lambda p: p.role = 'assistant')) * 2 >= len(pages)", "page_structure_analysis": "len(list_filter(pages, lambda p: len(string_split(p.text, ' ')) < 50)) > 0",
    "regex_on_plan_pages": "len(list_filter(pages, lambda p: p.role = 'assistant' AND len(regexp_extract_all(p.text, 'th')) < 2)) = 0", "footer_image_count": "len(list_filter(pages[2:], lambda p: len(regexp_extract_all(p.text, '[.]')) < 1)) = 0",
}


@query(f"""WITH {PAGED_SQL} """ + " UNION ALL ".join(f"SELECT conv_id, '{m}' AS method, " + (f"CASE WHEN {METHOD_SQL[m]} THEN 'pass' ELSE 'fail' END" if m in METHOD_SQL else "'requires_review'" if m == "manual_review" else "'unevaluable'") + " AS verdict FROM t" for m in METHODS))
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format rule by its method's handler, in one pass over the pages; images are no input, so pixels can't be judged."""
    c, pages = F.col, F.col("pages")
    some = lambda f: F.size(F.filter(pages, f))
    ok = lambda x: F.when(x, "pass").otherwise("fail")
    handlers = {
        "pdf_metadata": ok(F.size(pages) >= 2), "text_extraction": ok(F.contains(F.element_at(pages, 1)["text"], F.lit("the"))), "regex_pattern": ok(some(lambda p: p["text"].rlike("[0-9]+")) >= 1),
        "table_detection": ok(some(lambda p: F.contains(p["text"], F.lit(" | "))) > 0), "pdf_image_detection": ok(some(lambda p: p["role"] == "assistant") * 2 >= F.size(pages)),
        "page_structure_analysis": ok(some(lambda p: F.size(F.split(p["text"], " ")) < 50) > 0), "manual_review": F.lit("requires_review"), "pixel_color_sample": F.lit("unevaluable"),
        "regex_on_plan_pages": ok(some(lambda p: (p["role"] == "assistant") & (F.regexp_count(p["text"], F.lit("th")) < 2)) == 0),
        "footer_image_count": ok(F.size(F.filter(F.slice(pages, F.lit(2), F.size(pages)), lambda p: F.regexp_count(p["text"], F.lit("[.]")) < 1)) == 0),
    }
    return X.by_method(paged(spark, sf_dir), ["conv_id"], METHODS, handlers)


BASES = [("plan", r"(?:plan|Der) ([a-zß-ÿ]+)"), ("law", r"([A-Z][a-z]+) the "), ("custom", r"^([^ ]+)")]


@query("""SELECT doc_id, CASE WHEN b1 <> '' THEN 'plan' WHEN b2 <> '' THEN 'law' WHEN b3 <> '' THEN 'custom' END AS basis, coalesce(nullif(b1, ''), nullif(b2, ''), nullif(b3, '')) AS named, CAST(len(items) AS BIGINT) AS findings, list_min(items) AS first_item, score, score < 0.7 AS low FROM (
 SELECT doc_id, regexp_extract(text, '(?:plan|Der) ([a-zß-ÿ]+)', 1) AS b1, regexp_extract(text, '([A-Z][a-z]+) the ', 1) AS b2, regexp_extract(text, '^([^ ]+)', 1) AS b3, regexp_extract_all(text, '[a-z]+ ([a-z]+tion)[.]', 1) AS items,
  (CASE WHEN n_chars > 500 THEN 0.4 ELSE 0.0 END) + (CASE WHEN lang = 'en' THEN 0.35 ELSE 0.0 END) + (CASE WHEN contains(text, chr(10)) THEN 0.25 ELSE 0.0 END) AS score FROM documents) t""")
def protocol_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each protocol's rule basis by ordered patterns, its listed findings, and an additive confidence; low ones are marked."""
    c, text = F.col, F.col("text")
    items = F.regexp_extract_all(text, F.lit(r"[a-z]+ ([a-z]+tion)[.]"), F.lit(1))
    sure = X.score([(c("n_chars") > 500, 0.4), (c("lang") == "en", 0.35), (F.contains(text, F.lit("\n")), 0.25)])
    d = table(spark, sf_dir, "documents").select("doc_id", X.first_class(text, BASES, None).alias("basis"), X.first_match(text, [p for _, p in BASES]).alias("named"), items.alias("items"), sure.alias("score"))
    return d.select("doc_id", "basis", "named", F.size("items").cast("long").alias("findings"), F.array_min("items").alias("first_item"), "score", (c("score") < 0.7).alias("low"))


#: Protocols in an old layout (label, then value) and a new one (value, then label), with spellings of some labels.
LAYOUTS = {
    "old": {"block": [r"(?m)^Block: *(\d+)"], "lot": [r"(?m)^Lot: *(\d+)", r"(?m)^Plot no\. *(\d+)"], "applicant": [r"(?m)^Applicant: *(.+)$"], "request": [r"(?m)^Request: *(.+)$"]},
    "new": {"block": [r"(\d+) +block"], "lot": [r"(\d+) +lot"], "applicant": [r"(?m)^(.+?) +\(applicant\)"], "request": [r"(?m)^(.+?) +\(request\)"]},
}


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS kind, CAST(o_custkey AS VARCHAR) AS block, CAST(o_orderkey % 97 AS VARCHAR) AS lot, concat('Person ', o_orderpriority) AS who, concat('Build ', o_orderstatus) AS what FROM orders)
SELECT id, CASE kind WHEN 4 THEN NULL WHEN 1 THEN 'new' ELSE 'old' END AS layout, CASE WHEN kind <> 4 THEN block END AS block, CASE WHEN kind <> 4 THEN lot END AS lot, CASE WHEN kind NOT IN (3, 4) THEN who END AS applicant, CASE WHEN kind IN (0, 1, 2) THEN what END AS request FROM o""")
def layout_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of protocols in two layouts, of mixed ones, whose missing fields fall back to the other layout, of ones with
    another spelling, and of texts without any."""
    k, c = F.col("o_orderkey"), F.col
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    block, lot, who, what = c("o_custkey"), k % 97, s("Person ", c("o_orderpriority")), s("Build ", c("o_orderstatus"))
    text = (
        F.when(k % 5 == 0, s("Protocol\nBlock: ", block, "\nLot:  ", lot, "\nApplicant: ", who, "\nRequest: ", what, "\n"))
        .when(k % 5 == 1, s("Protocol\n", block, " block ", lot, "  lot\n", who, " (applicant)\n", what, " (request)\n"))
        .when(k % 5 == 2, s("Applicant: ", who, "\nRequest: ", what, "\n", block, " block ", lot, " lot\n"))
        .when(k % 5 == 3, s("Block: ", block, "\nPlot no. ", lot, "\nApplicant: \n")).otherwise(s("Nothing said about ", block))
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), X.layout_fields(text, LAYOUTS).alias("f")).select("id", "f.*")
