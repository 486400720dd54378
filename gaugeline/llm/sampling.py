"""A bounded, repeatable sample of labelled texts, one task that fits a model on it, and scores beside any columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def picked(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, of the smallest hashes h.  Counted first, so that the one task that orders them is sent
    little more than it keeps; that may, by chance, leave a few less."""
    share = 1.25 * most / max(1, rows.count())
    return rows.where(F.col("h") <= F.lit(int(-(2**63) + min(1.0, share) * (2**64 - 2**12)))).orderBy("h", "doc_id").limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, max_bytes: int, unlabelled: int = 0) -> DataFrame:
    """(h, doc_id, text, label) of at most `most` labelled documents (label 0 or 1) and at most `unlabelled` others
    (label -1) of at most max_bytes bytes, first in a hash order of doc_id.  The ids are bounded, so they are broadcast."""
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "label")
    h = F.xxhash64("doc_id", F.lit("fit")).alias("h")
    own = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    fits = F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes
    ids = picked(own.select("doc_id", "label", h), most)
    if unlabelled:
        every = docs.where("doc_id is not null").select("doc_id").join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
        ids = ids.unionByName(picked(every.select("doc_id", F.lit(-1).alias("label"), h), unlabelled).distinct())
    return docs.where(fits).join(F.broadcast(ids), "doc_id").select("h", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def fit_in_task(sample: DataFrame, fit: Callable[[list[bytes], list[int]], bytes]) -> bytes:
    """Run fit on the whole (bounded) sample in one task; its model's bytes come to the driver."""

    def run(batches):
        rows = []
        for b in batches:
            rows += zip(*(c.to_pylist() for c in b.columns), strict=True)
        rows = sorted(set(rows))
        yield pa.RecordBatch.from_arrays([pa.array([fit([r[2].encode("utf-8", "surrogatepass") for r in rows], [int(r[3]) for r in rows])], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(got[0]) if got else fit([], [])


def sent_texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch that scored sends."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def scored(docs: DataFrame, scorer: Callable) -> DataFrame:
    """docs with the score that scorer, a mapInArrow function of (row[, text]), returns beside each row; a column of
    docs named score is replaced.  Columns travel in a struct, so none clashes; a text that is no string is sent as one
    beside it, others travel once."""
    rest = [c for c in docs.columns if c != "score"]
    other = [] if docs.schema["text"].dataType == T.StringType() else [F.col("text").cast("string").alias("text")]
    rows = docs.select(F.struct(*rest).alias("row"), *other)
    made = rows.mapInArrow(scorer, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return made.select("row.*", "score")
