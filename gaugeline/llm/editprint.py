"""Document fingerprints by a randomised edit embedding.

A random walk reads a text's code points: at step j it emits the current character
and moves on or stays by a bit drawn from (j mod PERIOD, character), the same for every text.
After an edit two walks fall back into step, so edit distance turns into Hamming
distance of the emitted strings.  That takes a time with a heavy tail; and walks that drift apart by a whole period
lock there.  A longer period makes that rarer, but segments of a long text then take longer to join.  The walk is sampled at steps drawn once for all
texts, at a density 2^-level that halves as texts double, and each sample keeps a
four-bit hash of the emitted character.  A finer level's samples contain a coarser
one's, so texts of different lengths compare at the coarser level.

fingerprint = "<level>:<hex digits>"; likeness = share of equal digits at the common
sample steps, corrected for chance (1/16) and cut at 0.

Alike texts are found by bit-sampled bands over the whole fingerprint, at its own level and
the next coarser one, and every link is confirmed on the fingerprints.

Defined results: null counts as empty; two empty texts have likeness 1, an empty
and another 0; rows that repeat a doc_id follow in the order of their texts' hashes, rows
equal in both in any order; a null doc_id comes first in the order.  Extra columns are
ignored; an empty table gives an empty result.  A single document is its own next.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .adjacent import in_blocks, pairs_within, stretches
from .bytehash import U, mix, table
from .common import small_side, staged
from .graph import absorb, components

#: Expected samples of a text at its level lie between TARGET and twice that.
TARGET = 128
#: Characters walked at a time, both texts of each row.
CHUNK_CHARS = 1 << 20
#: Phases after which the walk's bits repeat, kinds of characters it tells apart, characters of a segment.
PERIOD, CLASSES, SEGMENT = 256, 1 << 10, 8192
#: Chance that two texts of just the likeness asked for share no band.
MISS = 1e-4
#: A digit of two unlike texts of one language is equal about once in so many times: by chance, or for a common character.
UNLIKE = 7.5
#: Texts of a bucket that are compared with so many others at a time; centres that each text is tried with before.
BLOCK, TURNS = 2000, 4
#: Rows of 16 bytes up to which texts' components, and open buckets, are broadcast.
COMPONENTS = 500_000


class Walk:
    """The shared randomness: how long a walk that reaches a character at a phase stays
    there, and for every step its depth (sampled at levels up to it) and digit hash."""

    def __init__(self):
        some = table(71, CLASSES * -(-PERIOD // 32)).reshape(CLASSES, -1, 1)
        bits = ((some >> (np.arange(32, dtype=np.uint64) + U(17))) & U(1)).reshape(CLASSES, -1)[:, :PERIOD].copy()
        bits[:, 0] |= U(1) - bits.max(1)
        moves, stay = bits.T == 1, np.zeros((PERIOD + 1, CLASSES), np.uint16)
        for _ in range(2):  # backwards, twice round: a stay may run past the period's end
            for phase in range(PERIOD - 1, -1, -1):
                stay[phase] = np.where(moves[phase], 1, stay[phase + 1] + 1)
            stay[PERIOD] = stay[0]
        self.stay = np.ascontiguousarray(stay[:PERIOD].T).ravel()
        self.digit = np.zeros(0, np.uint64)
        self.depth = np.zeros(0, np.int8)
        self.steps: dict[int, np.ndarray] = {}

    def grow(self, n: int) -> None:
        if len(self.digit) < n:
            n = 1 << int(n).bit_length()
            j = np.arange(n, dtype=np.uint64)
            with np.errstate(over="ignore"):
                self.digit = mix(j * U(0xD1342543DE82EF95) + U(3)) | U(1)
                g = mix(j + U(0x5851F42D4C957F2D))
                low = g & (~g + U(1))
            self.depth = np.where(g == 0, 63, np.log2(np.maximum(low, U(1)).astype(np.float64))).astype(np.int8)
            self.steps = {}

    def sampled(self, level: int) -> np.ndarray:
        if level not in self.steps:
            self.steps[level] = np.flatnonzero(self.depth >= level)
        return self.steps[level]


def level_of(n: int) -> int:
    """A walk takes about two steps a character."""
    return max(0, int(np.ceil(np.log2(max(1, 2 * n) / (2 * TARGET)))))


def stays(x: np.ndarray, off: np.ndarray, walk: Walk) -> np.ndarray:
    """Steps spent at each character of the texts x[off[i]:off[i+1]].

    Texts are cut into segments that walk side by side, each first from phase 0; walks
    from different phases soon meet, so a second pass from the true phase of the segment
    before ends where it meets the first."""
    d, at = np.zeros(len(x), np.uint16), np.zeros(len(x), np.uint16)
    segs = np.maximum(1, -(-np.diff(off) // SEGMENT))
    text = np.repeat(np.arange(len(segs)), segs)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(segs) - segs, segs)
    start = off[text] + nth * SEGMENT
    size = np.minimum(off[text + 1] - start, SEGMENT)
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    phase = np.zeros(len(s), np.int64)
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k, "left"))  # segments longer than k
        i = s[:m] + k
        t = walk.stay.take(x[i] * PERIOD + phase[:m])
        d[i], at[i] = t, phase[:m]
        phase[:m] = (phase[:m] + t) % PERIOD
    end = np.zeros(len(s), np.int64)
    end[order] = phase
    todo = np.flatnonzero((nth > 0) & (size > 0))
    while len(todo):
        lane, phase, k, again = todo, end[todo - 1], 0, []
        while len(lane):
            i = start[lane] + k
            apart = at[i] != phase
            lane, phase, i = lane[apart], phase[apart], i[apart]
            t = walk.stay.take(x[i] * PERIOD + phase)
            d[i], at[i] = t, phase
            phase = (phase + t) % PERIOD
            k += 1
            done = size[lane] <= k
            if done.any():
                changed = done & (end[lane] != phase)
                end[lane[done]] = phase[done]
                nxt = lane[changed] + 1
                nxt = nxt[nxt < len(nth)]
                again.append(nxt[nth[nxt] > 0])
                lane, phase = lane[~done], phase[~done]
        todo = np.unique(np.concatenate(again)) if again else np.zeros(0, np.int64)
        todo = todo[size[todo] > 0]
    return d


def fingerprints(texts: list[str], walk: Walk) -> list[str]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    with np.errstate(over="ignore"):
        x = (mix(codes.astype(np.uint64) + U(1)) % U(CLASSES)).astype(np.int64)
    until = np.cumsum(stays(x, off, walk).astype(np.int64))
    hexa = np.frombuffer(b"0123456789abcdef", np.uint8)
    names = table(73, CLASSES)
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        level = level_of(int(b - a))
        if a == b:
            out.append(f"{level}:")
            continue
        ends = until[a:b] - (until[a - 1] if a else 0)
        walk.grow(int(ends[-1]) + 1)
        steps = walk.sampled(level)
        steps = steps[: np.searchsorted(steps, ends[-1])]
        seen = names[x[a:b][np.searchsorted(ends, steps, "right")]]
        with np.errstate(over="ignore"):
            out.append(f"{level}:{hexa[(seen * walk.digit[steps]) >> U(60)].tobytes().decode()}")
    return out


def depths(walk: Walk, level: int, n: int) -> np.ndarray:
    """Depths of the first n steps sampled at a level."""
    while len(steps := walk.sampled(level)) < n:
        walk.grow(2 * len(walk.depth) + 1024)
    return walk.depth[steps[:n]]


def likeness(a: str, b: str, walk: Walk) -> float:
    """0 to 1 from two fingerprints alone."""
    (la, _, a), (lb, _, b) = a.partition(":"), b.partition(":")
    if a == b and la == lb:
        return 1.0
    if not a or not b:
        return 0.0
    level = max(int(la), int(lb))

    def at(own: str, x: str) -> np.ndarray:
        d = np.frombuffer(x.encode(), np.uint8)
        return d if int(own) == level else d[depths(walk, int(own), len(d)) >= level]

    x, y = at(la, a), at(lb, b)
    n = max(len(x), len(y))
    if not n:
        return 0.0
    m = min(len(x), len(y))
    return max(0.0, float(((x[:m] == y[:m]).sum() / n - 1 / 16) / (15 / 16)))


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def printed(rows: list[tuple], following: str, walk: Walk) -> list[list]:
    """Columns of PRINTS for rows (doc_id, text) in their order, and the text that follows the last."""
    texts = [r[1] for r in rows]
    other = [edited(a, b) for a, b in zip(texts, [*texts[1:], following], strict=True)]
    prints = fingerprints([*texts, following, *other], walk)
    mine, theirs = prints[: len(texts) + 1], prints[len(texts) + 1 :]
    return [
        [r[0] for r in rows], [len(x) for x in texts], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in other], mine[:-1], theirs,
        [likeness(a, b, walk) for a, b in zip(mine, theirs, strict=False)], [likeness(a, b, walk) for a, b in zip(mine, mine[1:], strict=False)],
    ]


KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def pair_prints(batches):
    """PRINTS of a partition's sorted rows (doc_id, text), and its edges: the text of its first row (kind "head") and
    its last row (kind "open"), whose next document is another partition's head."""
    from pyspark import TaskContext

    walk, part = Walk(), TaskContext.get().partitionId()

    def record(cols, kind=None, texts=None):
        n = len(cols[0])
        arrays = [pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.string()), pa.array(texts or [None] * n, pa.string())], names=[*NAMES, "part", "kind", "text"])

    def edge(kind, doc, text):
        return record([[doc], [len(text)], *[[None]] * 5], kind, [text])

    held: list[tuple] = []
    size, first = 0, True
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if first:
                yield edge("head", doc, text)
                first = False
            if size > CHUNK_CHARS:
                yield record(printed(held, text, walk))
                held, size = [], 0
            held.append((doc, text))
            size += len(text)
    if len(held) > 1:
        yield record(printed(held[:-1], held[-1][1], walk))
    if held:
        yield edge("open", *held[-1])


def last_prints(batches):
    """PRINTS of single rows (doc_id, text, following)."""
    walk = Walk()
    for b in batches:
        for doc, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(printed([(doc, text)], following, walk), KINDS, strict=True)], names=NAMES)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """PRINTS of docs(doc_id, text).  Documents are range-partitioned by doc_id; each partition's last row meets the
    head of the next partition that has rows, the last one's the first's, in a join of one row a partition."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    found = staged(d.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pair_prints, f"{PRINTS}, part int, kind string, text string"), "ep-edits")
    heads = found.where("kind = 'head'").select("part", F.col("text").alias("following"))
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    to = heads.select("part").withColumn("next", following)  # one row a partition
    last = found.where("kind = 'open'").select("part", "doc_id", "text").join(to, "part").join(heads.withColumnRenamed("part", "next"), "next")
    return found.where("kind is null").select(*NAMES).unionByName(last.select("doc_id", "text", "following").mapInArrow(last_prints, PRINTS))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for docs(doc_id, text)."""

    def run(batches):
        walk = Walk()
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < CHUNK_CHARS):
                    size += len(texts[j])
                    j += 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fingerprints(texts[i:j], walk), pa.string())], names=["doc_id", "fingerprint"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def share_of(least: float) -> float:
    """The share of equal digits at which two fingerprints have the likeness least."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    return least * 15 / 16 + 1 / 16


def banding(n: int, least: float) -> tuple[int, int]:
    """(bands, digits of each): so many digits that different texts rarely share a band by chance at this number of
    texts, and then so many bands that alike ones miss all with a chance of MISS."""
    digits = max(5, 1 + math.ceil(math.log(max(n, 1), UNLIKE)))
    share = share_of(min(least, 0.999))
    # the sampled digits are different ones, of some 128
    met = math.prod((share * TARGET - i) / (TARGET - i) for i in range(digits))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - met))), digits


def banded(bands: int, digits: int):
    """The bands of a fingerprint at its own level and, of its nested samples, the next coarser one.

    A band has a random order of all sample places and takes the first digits of it that the fingerprint has: alike
    texts of different lengths take the same unless one falls on a place that only the longer has.  Fingerprints
    of fewer than 2 * digits take half their digits."""
    order = table(79, bands)

    def places(m: int, band_places: dict[int, np.ndarray]) -> np.ndarray:
        if m not in band_places:
            rank = mix(order[:, None] * (np.arange(m, dtype=np.uint64)[None, :] + U(1)))
            band_places[m] = np.argsort(rank, axis=1, kind="stable")[:, : max(1, min(digits, m // 2))]
        return band_places[m]

    def run(batches):
        walk, kept = Walk(), {}
        value = np.zeros(256, np.uint64)
        value[list(b"0123456789abcdef")] = np.arange(16)
        with np.errstate(over="ignore"):
            for b in batches:
                rows: dict[tuple[int, int], tuple[list, list]] = {}
                for node, p in zip(b.column("node").to_pylist(), b.column("fingerprint").to_pylist(), strict=True):
                    own, _, d = p.partition(":")
                    own, d = int(own), value[np.frombuffer(d.encode(), np.uint8)]
                    for level, x in ((own, d), (own + 1, d[depths(walk, own, len(d)) > own])):
                        if len(x):
                            for c, v in zip(rows.setdefault((level, len(x)), ([], [])), (2 * node + (level > own), x), strict=True):
                                c.append(v)
                for (level, m), (nodes, x) in rows.items():
                    at = places(m, kept)
                    key = np.zeros((len(nodes), bands), np.uint64)
                    took = np.stack(x)
                    for k in range(at.shape[1]):
                        key = mix(key + took[:, at[:, k]] + U(k + 1))
                    key = mix(key ^ (order + U(level)) * U(0x9FB21C651E98DF25))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), bands))], names=["bucket", "entry"])

    return run


def alike(least: float):
    """Links (a, b, likeness) that join all components which any links of least join, from rows (bucket, lo, hi, mine, entry, component,
    fingerprint) sorted by bucket, lo, hi: a block of a bucket, or two that meet.  Texts are compared at the bucket's
    level, where it is the own level of one of them."""

    def run(batches):
        walk = Walk()
        for t, begin in stretches(batches, "bucket"):
            entry, rows = t.column("entry").to_numpy(), []
            for e, p in zip(entry.tolist(), t.column("fingerprint").to_pylist(), strict=True):
                own, _, d = p.partition(":")
                d = np.frombuffer(d.encode(), np.uint8)
                rows.append(d[depths(walk, int(own), len(d)) > int(own)] if e & 1 else d)
            size = np.array([len(r) for r in rows])
            digits = np.zeros((len(rows), size.max()), np.uint8)
            for i, r in enumerate(rows):
                digits[i, : len(r)] = r
            # components that a link joins are one from then on: no task returns more links than it has components
            _, label = np.unique(t.column("component").to_numpy(), return_inverse=True)
            for x, y in pairs_within(t, begin, "component"):
                most = np.maximum(size[x], size[y])
                ok = (label[x] != label[y]) & ~((entry[x] & entry[y] & 1).astype(bool)) & (np.minimum(size[x], size[y]) >= (share_of(least) - 1e-9) * most)
                x, y, most = x[ok], y[ok], most[ok]
                same = (digits[x] == digits[y]).sum(1) - (digits.shape[1] - most)  # beyond both texts all is equal
                like = (same / most - 1 / 16) / (15 / 16)
                found = []
                for k in np.flatnonzero(like >= least).tolist():
                    p, q = label[x[k]], label[y[k]]
                    if p != q:
                        label[label == q] = p
                        found.append((*sorted((int(entry[x[k]]) >> 1, int(entry[y[k]]) >> 1)), float(like[k])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "likeness"])

    return run


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Of pairs(a, b), those whose fingerprints reach least, with their likeness."""

    def run(batches):
        walk = Walk()
        for b in batches:
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([likeness(p, q, walk) for p, q in zip(x, y, strict=True)], pa.float64())], names=["a", "b", "likeness"])

    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    prints = nodes.select("node", "fingerprint").join(small_side(staged(ids, "ep-ids"), COMPONENTS), "node", "left_semi")
    both = pairs.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long, likeness double").where(F.col("likeness") >= least)


def bucket_runs(batches):
    """Of rows (bucket, entry) in this order, those of buckets with several entries, each with the first of them that
    its partition holds.  Runs that a batch of rows cuts stay in any case."""
    last, lead = None, 0
    for b in batches:
        bucket, entry = b.column("bucket").to_numpy(), b.column("entry").to_numpy()
        if not len(bucket):
            continue
        new = np.concatenate([[last is None or bucket[0] != last], bucket[1:] != bucket[:-1]])
        firsts = np.concatenate([[] if new[0] else [lead], entry[new]]).astype(np.int64)
        run = np.cumsum(new) - int(new[0])
        keep = (np.bincount(run)[run] > 1) | (run == run[0]) | (run == run[-1])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(entry[keep]), pa.array(firsts[run][keep])], names=["bucket", "entry", "first"])
        last, lead = bucket[-1], firsts[-1]


def spanning(rows: DataFrame, component: DataFrame) -> DataFrame:
    """Rows (bucket, entry, node, component) of the buckets that hold more than one component."""
    name = small_side(component.toDF("node", "c"), COMPONENTS)
    tagged = rows.join(name, "node", "left").select("bucket", "entry", "node", F.coalesce("c", "node").alias("component"))
    mixed = tagged.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return tagged.join(small_side(staged(mixed.select("bucket"), "ep-mixed"), COMPONENTS), "bucket", "left_semi").select(tagged.columns)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Different pairs (a, b) of different nodes, the smaller first."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def left_open(rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Links of least between texts of different components in a bucket, compared in blocks: all that join components
    which no other link found joins."""
    with_prints = rows.join(nodes.select("node", "fingerprint"), "node").select("bucket", "entry", "component", "fingerprint")
    found = in_blocks(with_prints, "bucket", "entry", BLOCK).mapInArrow(alike(least), "a long, b long, likeness double")
    return found.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def links_of(prints: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, components): each different fingerprint is a node(node, f, fingerprint, docs); the links
    (a, b, likeness) found join all nodes that links of likeness least between texts sharing a band join.

    Each text is first tried with one centre, the first text of its buckets, then TURNS - 1 times with one drawn in a
    bucket that is still open; what stays open is compared across components, in blocks."""
    # staged, so that the numbers stay
    nodes = prints.groupBy("f").agg(F.first("fingerprint").alias("fingerprint"), F.count(F.lit(1)).alias("docs"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "ep-nodes")
    bands = nodes.select("node", "fingerprint").mapInArrow(banded(*banding(nodes.count(), least)), "bucket long, entry long")
    node = lambda c: F.shiftright(c, 1)
    order = ("bucket", "entry")
    rows = staged(bands.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(bucket_runs, "bucket long, entry long, first long"), "ep-bands")
    first = rows.groupBy(node("entry").alias("a")).agg(F.min(node("first")).alias("b"))
    links = staged(verified(staged(both_ways(first), "ep-pairs0"), nodes, least), "ep-links0")
    component = components(links.select("a", "b"), "ep-cc0")
    rows = rows.select("bucket", "entry", node("entry").alias("node"))
    for turn in range(1, TURNS):
        rows = staged(spanning(rows, component), f"ep-open{turn}")
        drawn = F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("o"), "node", "component")
        centre = rows.groupBy("bucket").agg(F.min(drawn).alias("c"))
        tried = rows.join(centre, "bucket").where("component <> c.component").groupBy(F.col("node").alias("a")).agg(F.min("c.node").alias("b"))
        more = staged(verified(staged(both_ways(tried), f"ep-pairs{turn}"), nodes, least), f"ep-links{turn}")
        links, component = links.union(more), absorb(component, more.select("a", "b"), f"ep-cc{turn}")
    more = staged(left_open(spanning(rows, component), nodes, least), "ep-more")
    if more.limit(1).count():
        links = links.union(more)
        component = absorb(component, more.select("a", "b"), "ep-cc")
    return nodes, links, component


def similar_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness): links between doc_ids that join all documents which links of likeness least between
    texts sharing a band join; of equal fingerprints the smallest doc_id stands for all.  A null doc_id takes no part."""
    prints = staged(hashed(prints).where("doc_id is not null").distinct(), "ep-prints")
    nodes, links, _ = links_of(prints, least)
    rep = staged(prints.groupBy("f").agg(F.min("doc_id").alias("rep")), "ep-reps")
    same = prints.join(rep, "f").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    ids = nodes.select("node", "f").join(rep, "f").select("node", "rep")
    other = links.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
    return same.unionByName(other).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def hashed(prints: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, f): f, a fingerprint's MD5, is what joins carry in its place."""
    return prints.select("doc_id", "fingerprint").withColumn("f", F.md5(F.col("fingerprint").cast("binary")))


def similar_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_docs, n_links), a row for each row of prints(doc_id, fingerprint), null and repeated
    doc_ids included.  Documents joined by links of likeness least between texts that share a band have one class_id,
    the least hash of the class's fingerprints; n_links counts the links confirmed between its different fingerprints."""
    prints = staged(hashed(prints), "ep-prints")
    nodes, links, component = links_of(prints, least)
    own = nodes.select("node", "f", "docs").join(component.toDF("node", "c"), "node", "left")
    own = staged(own.select("node", "f", "docs", F.coalesce("c", "node").alias("component")), "ep-classes")
    n = links.join(own.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("n_links"))
    about = own.groupBy("component").agg(F.min("f").alias("class_id"), F.sum("docs").alias("n_docs"))
    about = about.join(n, "component", "left").select("component", "class_id", "n_docs", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    named = own.join(about, "component").select("f", "class_id", "n_docs", "n_links")
    return prints.select("doc_id", "f").join(named, "f").select("doc_id", "class_id", "n_docs", "n_links")
