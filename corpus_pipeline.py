"""A corpus pipeline of five operators: quality, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept.

Defined results of all stages: columns beyond those of documents are dropped, whatever their names; a null text counts
as empty; a null doc_id or source is a value like any other; an empty table gives an empty table.  Rows that are equal in
all columns are one document after near-dedup, and rows that repeat a doc_id are told apart by their texts.  A document
without words is scored like any other, is no copy of another, is taken 0 words of and so drops out in the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import bpe, minhash, mixing, quality, suffix
from gaugeline.llm.common import small_side, staged
from gaugeline.llm.queries import RANKS, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its quality score is lower.
LEAST_QUALITY = 0.5
#: Similarity in percent; a repeated passage has so many bytes, or, if its words are short, so many words.
NEAR, PASSAGE, PASSAGE_WORDS = 80, 256, 51


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among them, rejects."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs.select(*COLUMNS), quality.fit(docs, labels)).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest doc_id (null last).  A doc_id may be
    null or repeated: rows are told apart by 128 bits of all columns, and equal rows become one."""
    rows = identified(docs.select(*COLUMNS))
    found = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), NEAR).select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = staged(found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first).select("first.row"), "pipeline-kept")
    return rows.dropDuplicates(["row"]).join(kept, "row", "left_semi").select(*COLUMNS)


def identified(docs: DataFrame) -> DataFrame:
    """docs with row, a 64-bit hash of their columns; where different rows share one, told by a second hash, all but the
    first of them get another.  At 10^10 rows these are a few; they are counted before they are broadcast."""
    nulls = [F.col(c).isNull() for c in COLUMNS]
    rows = docs.withColumns({"row": F.xxhash64(*COLUMNS, *nulls), "other": F.xxhash64(F.lit("other"), *COLUMNS, *nulls)})
    shared = rows.groupBy("row").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("row", "low")
    shared = staged(shared, "pipeline-shared")
    if not shared.limit(1).count():
        return rows.drop("other")
    rows = rows.join(small_side(shared), "row", "left")
    return rows.withColumn("row", F.when(F.col("other") != F.col("low"), F.xxhash64("row", "other")).otherwise(F.col("row"))).drop("other", "low")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; a document of which no word is left goes."""
    cut = suffix.remove_repeats(docs.select(*COLUMNS), PASSAGE, words=PASSAGE_WORDS).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"), "n_removed"
    )
    return cut.where((F.col("n_removed") == 0) | (mixing.words(F.col("text")) > 0)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.  Rows of one doc_id, source and text are one document, whose
    copies are those of all its rows."""
    flat = lambda c, tag: F.coalesce(F.concat(F.lit(tag), F.col(c).cast("string")), F.lit("-"))
    key = F.concat(flat("doc_id", "d"), F.lit("/"), F.col("tie").cast("string"), F.lit("/"), flat("source", "s")).alias("key")
    copies = mixing.mix(docs, key=True).select(key, "copies").groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    own = docs.select(*COLUMNS, mixing.tie().alias("tie")).select(*COLUMNS, key).groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    taken = own.join(copies, "key").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document taken."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Learned models, hash rounding and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{i}")
    return docs
