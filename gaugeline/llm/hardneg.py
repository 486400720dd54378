"""Hard negatives by bit-sliced integer products.

Components are integers, floor(scale * x).  A row's components are cut into bit-planes of their two's complement.  The
product of an anchor with a row is summed plane by plane, the most significant first: what the planes to come can add
lies between the sums of the anchor's negative and of its positive components, times 2^planes - 1, so each pair's score
lies in an interval that halves with each plane.  Pairs whose interval can't qualify any more go: they would be lower
than as many sure ones as are asked for, or out of the wanted range.  The last plane makes a score exact.

Anchors are a stated set of queries, compared with all rows: they are numbered and taken in blocks of a bounded number
of bytes.  A block goes to every partition of the rows, which returns its best rows for each anchor, and the partitions'
best are ranked by Spark.  Positives come first, for the range of negatives hangs on their scores.

Defined results: rows with a null vec_id or label, a null vector, or a null or non-finite component take no part;
components that a shorter vector lacks are 0; of rows that share a vec_id that with the smallest label, then vector,
counts; equal scores are ordered by vec_id; extra columns are ignored; an empty table gives an empty result.  Scores are
exact at any size of components, and returned as the nearest 64-bit integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.dedup import numbered

from .common import staged

#: Bytes of a block of anchors, as 64-bit components; rows and anchors of one tile of scores.
BLOCK_BYTES, ROWS, ANCHORS = 8 << 20, 4096, 256
#: Planes that are left when pairs are first looked at one by one.
SINGLE = 3
LIMIT = 1 << 63


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): the rows that take part, one a vec_id."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))
    twice = staged(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "negatives-twice")
    if not twice.limit(1).count():
        return rows
    one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")
    return rows.join(twice, "vec_id", "left_anti").unionByName(one)


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x), a row a vector; shorter vectors end in zeros.  Of Python's integers where 64 bits are too few."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    big = flat.size and float(np.abs(flat).max()) * scale >= 2**52
    flat = np.array([floor_of(x, scale) for x in flat.tolist()], object) if big else np.floor(flat * scale).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def floor_of(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], 1)


class Sliced:
    """Rows as bit-planes, and the products of anchors with them."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray):
        width = max(anchors.shape[1], rows.shape[1])
        anchors, rows = widened(anchors, width), widened(rows, width)
        most = lambda x: int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
        self.bits = most(rows).bit_length() + 1
        one = most(anchors) * max(1, width)
        exact = one << (self.bits + 8)
        # the narrowest numbers in which a plane's products, and the whole scores, are exact
        self.plane = np.float32 if one < 2**24 else np.float64 if one < 2**53 else object
        self.total = np.int64 if exact < LIMIT else object
        self.anchors = anchors.astype(self.plane)
        self.rows = rows
        self.planes = {}
        self.low, self.high = (np.minimum(anchors, 0).astype(self.total).sum(1), np.maximum(anchors, 0).astype(self.total).sum(1)) if width else (np.zeros(len(anchors), np.int64),) * 2

    def sliced(self, j: int) -> np.ndarray:
        if j not in self.planes:
            self.planes[j] = ((self.rows >> j) & 1).astype(self.plane)
        return self.planes[j]

    def weight(self, j: int) -> int:
        return -(1 << j) if j == self.bits - 1 else 1 << j

    def added(self, j: int, a: slice) -> np.ndarray:
        """What plane j adds to the scores of anchors a with all rows."""
        return (self.anchors[a] @ self.sliced(j).T).astype(self.total) * self.weight(j)

    def added_to(self, j: int, i: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.einsum("kd,kd->k", self.anchors[i], self.sliced(j)[r]).astype(self.total) * self.weight(j) if self.plane is not object else (self.anchors[i] * self.sliced(j)[r]).sum(1) * self.weight(j)

    def rest(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """What the planes below j can add at least and at most, for each anchor."""
        return self.low * ((1 << j) - 1), self.high * ((1 << j) - 1)


def kept(sliced: Sliced, a: slice, allowed: np.ndarray, groups: np.ndarray, least: np.ndarray, most: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of anchors a that can be among the first k of a group.

    Each group g is of anchor groups[g] of a and wants scores from least[g] (rises to the k-th best so far) to most[g]."""
    n = len(sliced.rows)
    part = np.zeros((a.stop - a.start, n), sliced.total)
    alive = allowed
    j = sliced.bits
    while j > min(SINGLE, sliced.bits - 1):
        j -= 1
        part = part + sliced.added(j, a)
        low, high = (x[a][:, None] for x in sliced.rest(j))
        if j <= SINGLE + 1:  # wider intervals hardly tell
            alive = np.zeros_like(alive)
            for g, i in enumerate(groups):
                can = np.flatnonzero(allowed[i])
                can = can[qualify(part[i, can] + low[i], part[i, can] + high[i], least[g], None if most is None else most[g], k)]
                alive[i, can] = True
            allowed = alive
    i, r = np.nonzero(alive)
    scores = part[i, r]
    while j > 0:
        j -= 1
        scores = scores + sliced.added_to(j, a.start + i, r)
        low, high = sliced.rest(j)
        begins = np.searchsorted(i, np.arange(part.shape[0] + 1))
        stay = np.zeros(len(i), bool)
        for g, x in enumerate(groups):
            s = slice(begins[x], begins[x + 1])
            stay[s] |= qualify(scores[s] + low[a][x], scores[s] + high[a][x], least[g], None if most is None else most[g], k)
        i, r, scores = i[stay], r[stay], scores[stay]
    return a.start + i, r, scores


def qualify(low: np.ndarray, high: np.ndarray, least, most, k: int) -> np.ndarray:
    """Of intervals [low, high]: those that can lie in [least, most] and above the k-th of those that surely do."""
    can = high >= least
    if most is not None:
        can &= low <= most
    sure = low[(low >= least) & (high <= most)] if most is not None else low[low >= least]
    if len(sure) >= k:
        can &= high >= np.sort(sure)[-k]
    return can


def clipped(x) -> int:
    return max(-LIMIT, min(LIMIT - 1, int(x)))


class Best:
    """The first k (score, vec_id) of each group so far."""

    def __init__(self, groups: int, k: int, least: list[int]):
        self.k, self.rows, self.least = k, [[] for _ in range(groups)], list(least)

    def add(self, g: int, scores: list, ids: list) -> None:
        have = sorted(self.rows[g] + [(-s, v) for s, v in zip(scores, ids, strict=True)])[: self.k]
        self.rows[g] = have
        if len(have) == self.k:
            self.least[g] = max(self.least[g], -have[-1][0])


def seek(anchor_ids: np.ndarray, anchor_labels: np.ndarray, anchors: np.ndarray, owner: np.ndarray, least: list[int], most: list[int] | None, k: int, scale: int):
    """Over rows(vec_id, label, embedding): for each group g the first k rows with a score from least[g] to most[g], of
    the label of its anchor owner[g] and another vec_id (most None) or of other labels; (g, score, vec_id)."""

    def run(batches):
        best = Best(len(owner), k, least)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids = b.column(0).to_numpy()
                labels = b.column(1).to_numpy()
                sliced = Sliced(anchors, integers(b.column(2), scale))
                for top in range(0, len(anchors), ANCHORS):
                    a = slice(top, min(top + ANCHORS, len(anchors)))
                    same = labels == anchor_labels[a][:, None]
                    allowed = same & (ids != anchor_ids[a][:, None]) if most is None else ~same
                    g0, g1 = np.searchsorted(owner, [a.start, a.stop])
                    bound = None if most is None else most[g0:g1]
                    i, r, scores = kept(sliced, a, allowed, owner[g0:g1] - top, best.least[g0:g1], bound, k)
                    begins = np.searchsorted(i, np.arange(a.start, a.stop + 1))
                    for g in range(g0, g1):
                        s = slice(begins[owner[g] - top], begins[owner[g] - top + 1])
                        fits = scores[s] >= best.least[g]
                        if most is not None:
                            fits &= scores[s] <= most[g]
                        if fits.any():
                            best.add(g, [int(x) for x in scores[s][fits]], ids[r[s][fits]].tolist())
        out = [(g, str(-s), v) for g, rows in enumerate(best.rows) for s, v in rows]
        if out:
            g, s, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.string()), pa.array(v, pa.int64())], names=["g", "score", "vec_id"])

    return run


def ranked(found: DataFrame, group: str, k: int) -> DataFrame:
    """The first k of each group, of the k each partition returned: by score, then vec_id."""
    digits = F.length(F.ltrim(F.col("score"), F.lit("-")))
    below = F.startswith("score", F.lit("-"))
    # scores are decimal strings, of any length: by sign, then length, then digits
    order = [below.asc(), F.when(below, digits).otherwise(-digits).asc(), F.when(~below, F.col("score")).desc(), F.when(below, F.col("score")).asc(), F.col("vec_id").asc()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors(vec_id, embedding, label).

    anchor says, by vec_id, which rows are queries."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    queries = numbered(rows.where(anchor), [F.col("vec_id").asc()])
    queries = staged(queries.select("place", "vec_id", "label", "embedding"), "negatives-anchors")
    facts = queries.agg(F.max("place"), F.max(F.size("embedding"))).first()
    size = max(1, BLOCK_BYTES // (8 * max(1, facts[1] or 1)))
    schema = "g long, score string, vec_id long"
    made = []
    for begin in range(0, facts[0] or 0, size):
        block = queries.where(F.col("place").between(begin + 1, begin + size)).orderBy("place").toArrow()  # BLOCK_BYTES at most
        ids = block.column("vec_id").to_numpy()
        labels, own = block.column("label").to_numpy(), integers(block.column("embedding").combine_chunks(), scale)
        none = -(1 << 2200)  # below any score of finite components
        near = rows.mapInArrow(seek(ids, labels, own, np.arange(len(ids)), [none] * len(ids), None, positives, scale), schema)
        near = sorted((r.g, r.rank, r.vec_id, int(r.score)) for r in ranked(near, "g", positives).collect())  # `positives` rows an anchor of the block
        fits = [(g, v, s, -(-percent[0] * s // 100), percent[1] * s // 100) for g, _, v, s in near if percent[0] * s <= percent[1] * s]
        if not fits:
            continue
        owner = np.array([f[0] for f in fits])
        far = rows.mapInArrow(seek(ids, labels, own, owner, [f[3] for f in fits], [f[4] for f in fits], negatives, scale), schema)
        pairs = spark.createDataFrame([(n, int(ids[f[0]]), f[1], clipped(f[2])) for n, f in enumerate(fits)], "g long, anchor_id long, positive_id long, positive_score long")
        long_score = F.coalesce(F.col("score").try_cast("long"), F.when(F.startswith("score", F.lit("-")), F.lit(-LIMIT)).otherwise(F.lit(LIMIT - 1)))
        made.append(staged(ranked(far, "g", negatives).join(F.broadcast(pairs), "g").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", long_score.alias("negative_score")), "negatives-mined"))
    if not made:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(made[0].schema).parquet(*(m.staged_path for m in made))
