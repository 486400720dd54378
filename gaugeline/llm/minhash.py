"""Near-duplicate detection by min-max hashing.

Each text's set of word shingles gets PERMUTATIONS random hash functions, and of
each both the smallest and the largest value are kept: two signature values for
one evaluation, each equal for two sets with probability their Jaccard
similarity.  Values are banded; texts that share a band are candidates, and every
link is confirmed on the full sets.

Texts with equal sets collapse to one class first.  In a bucket only links to its
centre are tried; buckets that still span several components are then compared
across components, so no link between different sets is lost to the star while a
group of copies costs its size, not its square.  That comparison goes by blocks of a
bucket's texts, with two exact bounds on what an intersection can be; a pair becomes a row
only if it passes both.

Defined results: null or wordless text has an empty set and no link (component is
itself, kept).  Rows that repeat a doc_id count as one document for links.  A null
doc_id takes no part: its component is null and it is kept.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adjacent import in_blocks, pairs_within, stretches
from .bytehash import U, Hasher, chunks, column_bytes, lower_ascii, mix, shingle_sets, table, word_hashes
from .common import staged
from .graph import absorb, components

SHINGLE = 5
BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Parts of the universe of shingles in which shared elements are counted.
PARTS = 64
#: Texts of a bucket that are compared with so many others at a time.
BLOCK = 2000


def sets_of(batch_text, k: int):
    """Per chunk: (first row, set values, set begins)."""
    h, coef = Hasher(), table(23, k + 1)
    data, off = column_bytes(batch_text)
    for i, j in chunks(off):
        part = lower_ascii(data[off[i] : off[j]])
        w, first = word_hashes(h, part, off[i : j + 1] - off[i])
        yield i, *shingle_sets(w, first, k, coef)


def signatures(x: np.ndarray, begin: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """(sets, 2 * permutations): min and max under each permutation, side by side."""
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, 2 * len(mult)), np.uint64)
    if len(full):
        at = begin[:-1][full]
        for i, (m, c) in enumerate(zip(mult, add, strict=True)):
            v = (x * m + c) >> U(24)
            out[full, 2 * i] = np.minimum.reduceat(v, at)
            out[full, 2 * i + 1] = np.maximum.reduceat(v, at)
    return out


def sketcher(k: int, bands: int, rows: int):
    n = bands * rows // 2
    mult, add, coef = table(31, n), table(37, n), table(41, rows + 1)

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                ids = b.column(0)
                for i, x, begin in sets_of(b.column(1), k):
                    n_docs = len(begin) - 1
                    size = np.diff(begin)
                    sums = [np.concatenate([[U(0)], np.cumsum(mix(x * U(c)))]) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
                    key = [s[begin[1:]] - s[begin[:-1]] for s in sums]
                    sig = signatures(x, begin, mult, add).reshape(n_docs, bands, rows)
                    acc = np.arange(bands, dtype=np.uint64)[None, :] * coef[rows]
                    for r in range(rows):
                        acc = acc + mix(sig[:, :, r]) * coef[r]
                    band = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * bands), pa.array(mix(acc).view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, n_docs), pa.array(size.astype(np.int64)), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), band],
                        names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                    )

    return run


def set_writer(k: int):
    """Each text's set, and how many of its elements fall into each of PARTS parts of the universe."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                ids = b.column(0)
                for i, x, begin in sets_of(b.column(1), k):
                    n = len(begin) - 1
                    doc = np.repeat(np.arange(n), np.diff(begin))
                    parts = np.bincount(doc * PARTS + (x & U(PARTS - 1)).astype(np.int64), minlength=n * PARTS).astype(np.int32)
                    sets = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(x.view(np.int64)))
                    parts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PARTS), pa.array(parts))
                    yield pa.RecordBatch.from_arrays([ids.slice(i, n), sets, parts], names=["id", "elements", "parts"])

    return run


def sets_for(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, elements, parts) of the documents in ids(doc_id), staged.  Texts are joined by a merge at every size."""
    some = docs.hint("merge").join(ids.distinct().hint("merge"), "doc_id", "left_semi")
    return staged(some.mapInArrow(set_writer(k), "id long, elements array<long>, parts array<int>"), "mh-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b), those whose full sets reach percent similarity; an id that several rows repeat
    is linked if any of its rows is."""
    left, right = sets.select("id", "elements").toDF("a", "x"), sets.select("id", "elements").toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        .where(F.lit(100) * both >= F.lit(percent) * (F.size("x") + F.size("y") - both))
        .select("a", "b").distinct()
    )


def spanning(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return rows.join(mixed, "bucket", "left_semi").select(rows.columns)


def shared_counts(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, shared, parts): how many of a set's elements any other set of these ids has, in all and by part.

    Elements of one set only are counted by their one owner, so nothing is joined
    back and a common element costs one row for each task."""
    sets = sets.join(ids.distinct().withColumnRenamed("doc_id", "id"), "id", "left_semi")
    own = (
        sets.select("id", F.explode("elements").alias("e")).groupBy("e").agg(F.min("id").alias("id"), F.max("id").alias("hi"))
        .where("id = hi").groupBy("id", F.col("e").bitwiseAND(F.lit(PARTS - 1)).alias("part")).count()
        .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "count"))).alias("own"))
    )
    size = sets.groupBy("id").agg(F.max("parts").alias("parts"))
    rest = F.transform("parts", lambda n, i: n - F.coalesce(F.try_element_at("own", i.cast("long")), F.lit(0).cast("long")))
    out = size.join(own, "id", "left").select(F.col("id").alias("doc_id"), rest.alias("parts"))
    return out.select("doc_id", F.aggregate("parts", F.lit(0).cast("long"), lambda x, y: x + y).alias("shared"), "parts")


def allowed(percent: int):
    """Pairs (a, b) of a bucket's sets whose shared elements leave room for the intersection that a link needs:
    (100 + percent) * intersection >= percent * (n + n'), bounded by the smaller share in all and by parts."""

    def run(batches):
        for t, begin in stretches(batches, "bucket"):
            ids, n, shared = (t.column(c).to_numpy() for c in ("doc_id", "n_shingles", "shared"))
            parts = np.asarray(t.column("parts").combine_chunks().flatten(), np.int64).reshape(len(t), PARTS)
            for x, y in pairs_within(t, begin, "component"):
                need = percent * (n[x] + n[y])
                ok = (100 + percent) * np.minimum(shared[x], shared[y]) >= need
                x, y, need = x[ok], y[ok], need[ok]
                ok = (100 + percent) * np.minimum(parts[x], parts[y]).sum(1) >= need
                x, y = x[ok], y[ok]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs(doc_id, text): links are pairs of
    texts with 100 * intersection >= percent * union of their k-word shingle sets."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = staged(
        base.mapInArrow(sketcher(k, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "mh-sketch"
    )
    live = sketch.where("doc_id is not null and n_shingles > 0")
    classes = staged(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "mh-classes")
    member = staged(live.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "rep").distinct(), "mh-member")
    # one row of each class carries its bands; a class's rows all have the same ones
    heads = (
        live.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "k1", "k2"], "left_semi")
        .select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    )
    rank = F.xxhash64("doc_id")
    best = (
        heads.groupBy("bucket").agg(F.min(F.struct(rank, "doc_id")).alias("c"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("bucket", F.col("c.doc_id").alias("centre"))
    )
    crowded = staged(heads.join(best, "bucket"), "mh-crowded")
    star = staged(
        crowded.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct(), "mh-star"
    )
    sets = sets_for(base, star.select(F.col("a").alias("doc_id")).union(star.select("b")), k)
    edges = staged(verified(star, sets, percent), "mh-links")
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comp = components(edges.union(same), "mh-cc1")
    # buckets that still hold several components: compare across components
    tagged = crowded.select("bucket", "doc_id", "n_shingles").distinct().join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    open_ = staged(spanning(tagged), "mh-open")
    shared = shared_counts(open_.select("doc_id"), sets)
    rich = open_.join(shared, "doc_id").select("bucket", "doc_id", "n_shingles", "component", "shared", "parts")
    # a link needs an intersection of least * (n + n') / (100 + percent); no set has more than its shared elements
    least = rich.groupBy("bucket").agg(F.min("n_shingles").alias("least"))
    able = rich.join(least, "bucket").where(F.lit(100 + percent) * F.col("shared") >= F.lit(percent) * (F.col("n_shingles") + F.col("least")))
    able = staged(spanning(able.select(rich.columns)), "mh-able")
    # a second star, now with a centre drawn for each bucket: a text meets as many centres as it has buckets
    drawn = able.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc_id", "bucket"), "doc_id")).alias("c"))
    second = able.join(drawn, "bucket").where("doc_id <> c.doc_id").select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = staged(second.join(tried, ["a", "b"], "left_anti"), "mh-star2")
    if second.limit(1).count():
        comp = absorb(comp, staged(verified(second, sets, percent), "mh-links2"), "mh-cc2")
        able = able.drop("component").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
            "bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"), "shared", "parts"
        )
        able = staged(spanning(able), "mh-able2")
        tried = tried.union(second)
    # what is left: pairs of two components in a bucket that the shared elements, part by part, still allow
    left = in_blocks(able, "bucket", "doc_id", BLOCK).mapInArrow(allowed(percent), "a long, b long").distinct()
    cross = staged(left.join(tried, ["a", "b"], "left_anti"), "mh-cross")
    if cross.limit(1).count():
        comp = absorb(comp, staged(verified(cross, sets, percent), "mh-more"), "mh-cc3")
    out = sketch.select("doc_id", "n_shingles").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
