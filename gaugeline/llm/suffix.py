"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

A window of min_bytes bytes repeats if it also starts anywhere else, in any text.  Its
ANCHOR-byte string with the smallest hash (the leftmost of equals) is fixed by the
window's bytes alone, so equal windows have equal anchors at equal offsets.  Only the
suffixes that start at anchors are indexed (about one in (min_bytes - ANCHOR) / 2), each
with the run of windows it anchors.

A suffix array is the table of these suffixes in the order of their bytes: by the first 16,
then by the name (a hash) of the first ANCHOR, as prefix doubling names longer prefixes,
then by the run's content and the place.  It is range-partitioned, so that suffixes of
one beginning may lie in several partitions and a common one fills none; neighbours are
compared within a partition, and the edges of partitions, two rows each, among each other.

A new batch is sorted and merge-scanned against every level: neighbours that share ANCHOR
bytes or more are met.  Levels of equal size merge with it, as carries in a binary counter,
and a merge is a scan of its parts, so a suffix is rewritten a logarithmic number of times.
Levels stay in a folder with numbered manifests; a later run opens it and adds its batch.

Neighbours met are resolved exactly: runs equal as wholes repeat whole; runs of one anchor
that differ are cut into blocks of windows, judged by the bytes that all windows of a block
share and by all its bytes; the windows of blocks that stay open are compared one by one.
Blocks and windows are ordered and scanned like suffixes, so no group's members have to
meet in one task.

Copies: each distinct text is indexed once, under a hash of its bytes; a text of at least
min_bytes bytes that occurs twice repeats whole.

Defined results: null counts as empty; texts under min_bytes bytes have no such string;
rows that repeat a doc_id are texts like any other; columns of docs whose names are those
of added ones are replaced, other extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .adjacent import FLAGS, scan, settled
from .bytehash import CHUNK, U, Hasher, column_bytes, mix
from .common import drop_staged, newest, stage_path, staged

MIN_BYTES = 400
ANCHOR = 64
BLOCK = 16
BATCHES = 4
#: Bytes of a text between whose starts spans are merged at a time.
REACH = 1 << 16
#: Texts that a worker unfolds at a time, and rows it gathers before it sends them.
FEW, SENT = 512, 20_000
SUFFIX = "b0 long, b1 long, anchor long, whole long, k1 long, k2 long, pos long, n int, lead int"
ORDER = ("b0", "b1", "anchor", "whole", "k1", "k2", "pos")
PLACE = ("k1", "k2", "pos")


def sliding_min_at(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each w-long window of x."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[:n], head[w - 1 : w - 1 + n])
    # the minima are few: find, for each stretch of equal minimum, the places that hold it
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    at = np.empty(n, np.int64)
    for a, b in zip(change, np.concatenate([change[1:], [n]]), strict=True):
        places = np.flatnonzero(x[a : b - 1 + w] == low[a]) + a
        at[a:b] = places[0] if len(places) == 1 else places[np.searchsorted(places, np.arange(a, b), "left")]
    return at


def segments(data: np.ndarray, off: np.ndarray, least: int):
    """(text, first byte, bytes, windows): pieces of at most CHUNK window starts with the bytes their windows need."""
    for i in range(len(off) - 1):
        a, n = int(off[i]), int(off[i + 1] - off[i]) - least + 1
        for p in range(0, max(n, 0), CHUNK):
            k = min(CHUNK, n - p)
            yield i, p, data[a + p : a + p + k + least - 1], k


def runs_of(h: Hasher, d: np.ndarray, least: int):
    """Runs of windows with one anchor: (start, windows, anchor, anchor hash, hash of all the run's bytes)."""
    s = h.prefix(d)
    grams = mix(starting(h, s, ANCHOR))
    at = sliding_min_at(grams, least - ANCHOR + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    whole = mix(h.spans(s, first, first + count + least - 1) + count.astype(np.uint64))
    return first, count, at[first], grams[at[first]], whole


def starting(h: Hasher, s: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, the last included."""
    n = len(s) - k
    return (s[k:] - s[:n]) * h.ipw[:n]


def heads(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16 bytes from each place as two numbers that order like the bytes."""
    x = np.ascontiguousarray(d[at[:, None] + np.arange(16)]).view(">u8").astype(np.uint64)
    return (x ^ U(1 << 63)).view(np.int64)


def indexer(least: int):
    def run(batches):
        h = Hasher(43)
        with np.errstate(over="ignore"):
            for b in batches:
                data, off = column_bytes(b.column("text"))
                out, size = [], 0
                for i, p, d, _ in segments(data, off, least):
                    first, count, at, k, c = runs_of(h, d, least)
                    x = heads(d, at)
                    out.append((np.full(len(first), i), x[:, 0], x[:, 1], k.view(np.int64), c.view(np.int64), first + p, count, at - first))
                    size += len(first)
                    if size > SENT:
                        yield entries(b, out)
                        out, size = [], 0
                if out:
                    yield entries(b, out)

    def entries(b, out):
        row, b0, b1, k, c, p, n, lead = (np.concatenate(x) for x in zip(*out, strict=True))
        row = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(b0), pa.array(b1), pa.array(k), pa.array(c), b.column("k1").take(row), b.column("k2").take(row), pa.array(p), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32))],
            names=["b0", "b1", "anchor", "whole", "k1", "k2", "pos", "n", "lead"],
        )

    return run


def shared(new: DataFrame, level: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """(anchor) of the suffixes of a level and of a new batch that are neighbours, by a merge-scan of both."""

    def run(batches):
        held = None  # the last group so far: (anchor, in the batch, in the level), and whether it's the first
        for b in batches:
            a, n = b.column("anchor").to_numpy(), b.column("new").to_numpy(zero_copy_only=False)
            if not len(a):
                continue
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            x, y = np.maximum.reduceat(n, first), np.maximum.reduceat(~n, first)
            anchor, edge = a[first], np.zeros(len(first), bool)
            if held is None:
                edge[0] = True
            elif held[0] == anchor[0]:
                x[0], y[0], edge[0] = x[0] | held[1], y[0] | held[2], held[3]
            else:
                yield some([held])
            keep = (x & y | edge)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(v[:-1][keep]) for v in (anchor, x, y)], names=["anchor", "x", "y"])
            held = (anchor[-1], x[-1], y[-1], edge[-1])
        if held is not None:
            yield some([(*held[:3], True)])

    def some(rows):
        rows = [r for r in rows if r[1] and r[2] or r[3]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([bool(r[i]) for r in rows], pa.bool_()) for i in (1, 2))], names=["anchor", "x", "y"])

    salt = F.xxhash64(*PLACE).bitwiseAND(F.lit(255)).alias("salt")
    narrow = lambda d, new_: d.select("b0", "b1", "anchor", salt, F.lit(new_).alias("new"))
    order = ("b0", "b1", "anchor", "salt")
    both = narrow(new, True).unionByName(narrow(level, False)).repartitionByRange(*order).sortWithinPartitions(*order)
    met = both.select("anchor", "new").mapInArrow(run, "anchor long, x boolean, y boolean")
    return staged(met.groupBy("anchor").agg(F.max("x").alias("x"), F.max("y").alias("y")).where("x and y").select("anchor"), label, folder=folder)


SAME, KIND = ("b0", "b1", "anchor"), "whole"


class Family:
    """The levels, each (size in batches, suffix array), largest first, and the anchors met by scans of a batch
    against a level that it didn't merge with.  With a folder all this lasts, texts included: opening it again goes
    on where the last finished add ended; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = MIN_BYTES):
        if least < ANCHOR + BLOCK:
            raise ValueError(f"least must be {ANCHOR + BLOCK} or more")
        self.spark, self.folder, self.least = spark, folder, least
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.version, path = newest(spark, folder, "manifest-") if folder else (0, None)
        for r in sorted(spark.read.parquet(path).collect(), key=lambda r: r.nth) if path else []:  # one row a level or batch
            if r.least != least:
                raise ValueError(f"the family in {folder} is for windows of {r.least} bytes")
            df = spark.read.parquet(r.path)
            df.staged_path = r.path
            if r.kind == "level":
                self.levels.append((r.size, df))
            else:
                (self.met if r.kind == "met" else self.texts).append(df)

    def merge(self, batch: DataFrame) -> list[DataFrame]:
        """Sort a batch of suffixes; scan it against levels of other sizes, merge it with those of equal size.  The
        levels it replaces, which the caller drops."""
        size, old = 1, []
        while self.levels and self.levels[-1][0] == size:
            old.append(self.levels.pop()[1])
            size *= 2
        self.met += [shared(batch, level, f"sa-met{n}", self.folder) for n, level in self.levels]
        array = reduce(DataFrame.unionByName, [batch, *(x.drop(*FLAGS) for x in old)])
        self.levels.append((size, scan(array, ORDER, SAME, KIND, PLACE, f"sa-level{size}", True, self.folder)))
        return old

    def candidates(self, anchors: DataFrame | None = None) -> DataFrame:
        """Suffixes, with flags again and differs, that have a neighbour of the same beginning in any level; with
        anchors(anchor), only those that begin so."""
        if len(self.levels) == 1 and anchors is None:
            return settled(self.levels[0][1], SAME, KIND, PLACE)
        rows = []
        met = reduce(DataFrame.unionByName, self.met).distinct() if self.met else None
        for _, level in self.levels:
            if anchors is not None:
                level = level.join(anchors, "anchor", "left_semi")
            rows.append(level.where("again or differs or edge"))
            if met is not None:
                rows.append(level.join(met, "anchor", "left_semi"))
        every = reduce(DataFrame.unionByName, rows).drop(*FLAGS).select(*ORDER, "n", "lead")
        return settled(scan(every, ORDER, SAME, KIND, PLACE, "sa-across"), SAME, KIND, PLACE)

    def add(self, texts: DataFrame) -> DataFrame:
        """Add a batch texts(text) to the folder; the spans (k1, k2, a, b), maximal, of the bytes of its texts that
        repeat within it or in texts added before.  Equal texts of a batch count once; one added before repeats whole."""
        if not self.folder:
            raise ValueError("a family that lasts needs a folder")
        kept = texts.select(*text_key("text"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= self.least)
        kept = staged(kept.groupBy("k1", "k2").agg(F.first("text").alias("text")), "texts", folder=self.folder)
        batch = staged(kept.mapInArrow(indexer(self.least), SUFFIX), "sa-batch")
        self.texts.append(kept)
        old = self.merge(batch)
        self.save()
        for level in old:
            drop_staged(level)
        before = reduce(DataFrame.unionByName, self.texts[:-1]).select("k1", "k2") if len(self.texts) > 1 else kept.select("k1", "k2").where("1 = 0")
        again = kept.join(before, ["k1", "k2"], "left_semi").select("k1", "k2", F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b"))
        found = resolved(self.candidates(batch.select("anchor").distinct()), reduce(DataFrame.unionByName, self.texts), self.least)
        return merged(found.join(kept.select("k1", "k2"), ["k1", "k2"], "left_semi").unionByName(again)).select("k1", "k2", F.explode("spans").alias("s")).select("k1", "k2", "s.a", "s.b")

    def save(self) -> None:
        """A new manifest; until it is whole, the one before holds."""
        self.version += 1
        rows = [("level", n, df.staged_path) for n, df in self.levels] + [("met", 0, df.staged_path) for df in self.met] + [("texts", 0, df.staged_path) for df in self.texts]
        rows = [(i, *r, self.least) for i, r in enumerate(rows)]
        self.spark.createDataFrame(rows, "nth int, kind string, size int, path string, least int").coalesce(1).write.parquet(f"{self.folder.rstrip('/')}/manifest-{self.version}")


def text_key(text: str) -> list:
    """120 bits of a text's SHA-256 as two numbers."""
    sha = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    return [F.conv(F.substring(sha, at, 15), 16, 10).cast("long").alias(k) for k, at in (("k1", 1), ("k2", 16))]


def few(batches):
    """The batches in slices of FEW rows: what is unfolded from a slice doesn't grow with a task's texts."""
    for b in batches:
        yield from (b.slice(at, FEW) for at in range(0, b.num_rows, FEW))


def unfolded(col, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(where each row begins, and the end; the named fields) of a column of lists of structs, as numbers."""
    flat = col.flatten()
    begin = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    return begin, [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def pieces(t: np.ndarray, h: Hasher, pos: np.ndarray, least: int):
    """(which of the runs at pos, first byte, prefix hashes) for pieces of a text, CHUNK starts at a time."""
    part = pos // CHUNK
    order = np.argsort(part, kind="stable")
    for k in np.unique(part):
        a = int(k) * CHUNK
        yield order[part[order] == k], a, h.prefix(t[a : a + CHUNK + 2 * least])


def cut_blocks(least: int):
    """Blocks of windows of the wanted runs.  Window x of a run has its anchor lead - x bytes in; a block holds
    the windows of one BLOCK of such offsets, so equal windows fall into equal blocks.  Hashed are the bytes all
    windows of a block have in common, wherever its run is cut, and all the block's bytes."""

    def run(batches):
        h = Hasher(43)
        with np.errstate(over="ignore"):
            for b in few(batches):
                begin, runs = unfolded(b.column("runs"), ("pos", "n", "lead", "anchor"))
                data, off = column_bytes(b.column("text"))
                out, size = [], 0
                for i in range(len(b)):
                    pos, n, lead, anchor = (x[begin[i] : begin[i + 1]] for x in runs)
                    for own, base, s in pieces(data[off[i] : off[i + 1]], h, pos, least):
                        high, count = lead[own] // BLOCK, lead[own] // BLOCK - (lead[own] - n[own] + 1) // BLOCK + 1
                        r = np.repeat(own, count)
                        block = np.repeat(high, count) - (np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count))
                        x = np.maximum(0, lead[r] - block * BLOCK - BLOCK + 1)
                        m = np.minimum(n[r] - 1, lead[r] - block * BLOCK) - x + 1
                        at = pos[r] - base
                        tag = block.astype(np.uint64) * U(2)
                        last = len(s) - 1
                        core = mix(h.spans(s, np.minimum(at + lead[r] - block * BLOCK, last), np.clip(at + lead[r] - block * BLOCK - BLOCK + 1 + least, 0, last)) + tag + U(1))
                        full = mix(h.spans(s, at + x, at + x + m + least - 1) + tag + (m.astype(np.uint64) << U(20)))
                        out.append((np.full(len(r), i), anchor[r], core.view(np.int64), full.view(np.int64), pos[r] + x, m))
                        size += len(r)
                        if size > SENT:
                            yield entries(b, out)
                            out, size = [], 0
                if out:
                    yield entries(b, out)

    def entries(b, out):
        row, k, core, full, place, m = (np.concatenate(x) for x in zip(*out, strict=True))
        row = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(k), pa.array(core), pa.array(full), b.column("k1").take(row), b.column("k2").take(row), pa.array(place), pa.array(m.astype(np.int32))],
            names=["anchor", "core", "full", *PLACE, "m"],
        )

    return run


def each_window(least: int):
    def run(batches):
        h = Hasher(43)
        with np.errstate(over="ignore"):
            for b in few(batches):
                begin, runs = unfolded(b.column("runs"), ("pos", "m", "anchor"))
                data, off = column_bytes(b.column("text"))
                out, size = [], 0
                for i in range(len(b)):
                    pos, m, anchor = (x[begin[i] : begin[i + 1]] for x in runs)
                    for own, base, s in pieces(data[off[i] : off[i + 1]], h, pos, least):
                        r = np.repeat(own, m[own])
                        p = pos[r] + np.arange(len(r)) - np.repeat(np.cumsum(m[own]) - m[own], m[own])
                        hashes = mix(h.spans(s, p - base, p - base + least)).view(np.int64)
                        out.append((np.full(len(r), i), anchor[r], hashes, p))
                        size += len(r)
                        if size > SENT:
                            yield entries(b, out)
                            out, size = [], 0
                if out:
                    yield entries(b, out)

    def entries(b, out):
        row, k, w, place = (np.concatenate(x) for x in zip(*out, strict=True))
        row = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(w), b.column("k1").take(row), b.column("k2").take(row), pa.array(place)], names=["anchor", "hash", *PLACE])

    return run


def resolved(cand: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(k1, k2, a, b): byte ranges of the windows of candidates that repeat, not merged; texts(k1, k2, text) may repeat."""
    cand = staged(cand, "sa-candidates")
    span = lambda d, n: d.where("again").select("k1", "k2", F.col("pos").alias("a"), (F.col("pos") + n + (least - 1)).cast("long").alias("b"))
    spans = [span(cand, F.col("n"))]
    want = cand.where("differs").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "n", "lead", "anchor")).alias("runs"))
    own = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))  # copies are combined before the shuffle
    source = staged(own.join(want, ["k1", "k2"]).select("k1", "k2", "runs", "text"), "sa-open-texts")
    made = staged(source.mapInArrow(cut_blocks(least), "anchor long, core long, full long, k1 long, k2 long, pos long, m int"), "sa-blocks")
    blocks = staged(settled(scan(made, ("anchor", "core", "full", *PLACE), ("anchor", "core"), "full", PLACE, "sa-block-scan"), ("anchor", "core"), "full", PLACE), "sa-open-blocks")
    drop_staged(made)
    spans.append(span(blocks, F.col("m")))
    ask = blocks.where("differs").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "m", "anchor")).alias("runs"))
    made = staged(source.select("k1", "k2", "text").join(ask, ["k1", "k2"]).mapInArrow(each_window(least), "anchor long, hash long, k1 long, k2 long, pos long"), "sa-windows")
    spans.append(span(settled(scan(made, ("anchor", "hash", *PLACE), ("anchor",), "hash", PLACE, "sa-window-scan"), ("anchor",), "hash", PLACE), F.lit(1)))
    found = staged(reduce(DataFrame.unionByName, spans), "sa-spans")
    drop_staged(made)
    return found


def find_repeats(texts: DataFrame, least: int = MIN_BYTES, batches: int = BATCHES) -> DataFrame:
    """(k1, k2, a, b): byte ranges of repeated windows in texts(k1, k2, text), not merged; the key is a hash of the
    text, and rows of one key count once.  The texts are dealt into batches, added one by one."""
    rows = texts.where(F.octet_length("text") >= least)
    made = rows.mapInArrow(indexer(least), SUFFIX).withColumn("batch", F.pmod("k1", F.lit(batches)).cast("int"))
    made = staged(made, "sa-batches", "batch")
    family = Family(texts.sparkSession, None, least)
    for i in range(batches):
        for old in family.merge(made.where(F.col("batch") == i).drop("batch")):
            drop_staged(old)
    drop_staged(made)
    found = resolved(family.candidates(), rows, least)
    for _, level in family.levels:
        drop_staged(level)
    return found


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words between ASCII white space."""
    inside = np.concatenate([[False], ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_windows(words: int, least: int):
    """Windows of so many whole words that have under least bytes, which windows of least bytes miss."""

    def run(batches):
        for b in few(batches):
            keys = zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True)
            data, off = column_bytes(b.column("text"))
            rows: list[tuple] = []
            for i, key in enumerate(keys):
                text = data[off[i] : off[i + 1]]
                begin, end = word_bounds(text)
                n = max(0, len(begin) - words + 1)
                begin, end = begin[:n], end[words - 1 :]
                for at in np.flatnonzero(end - begin < least):
                    x, y = int(begin[at]), int(end[at])
                    rows.append((*struct.unpack("<qq", hashlib.blake2b(text[x:y].tobytes(), digest_size=16).digest()), *key, x, y))
                    if len(rows) >= SENT:
                        yield entries(rows)
                        rows = []
            if rows:
                yield entries(rows)

    def entries(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 6)], names=["h1", "h2", *PLACE, "b"]
        )

    return run


def find_short_repeats(texts: DataFrame, words: int, least: int) -> DataFrame:
    """(k1, k2, a, b) of the repeated windows of so many words that have under least bytes."""
    made = staged(texts.mapInArrow(word_windows(words, least), "h1 long, h2 long, k1 long, k2 long, pos long, b long"), "sa-word-windows")
    found = settled(scan(made, ("h1", "h2", *PLACE), ("h1",), "h2", PLACE, "sa-word-scan"), ("h1",), "h2", PLACE)
    return found.where("again").select("k1", "k2", F.col("pos").alias("a"), "b")


def merged(spans: DataFrame) -> DataFrame:
    """(k1, k2, spans): the maximal spans of each text, sorted; merged within stretches of a text first."""

    def join(batches):
        for b in few(batches):
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), merged_spans(b.column("spans"))], names=["k1", "k2", "spans"])

    schema = "k1 long, k2 long, spans array<struct<a long, b long>>"
    each = F.collect_set(F.struct("a", "b")).alias("spans")
    near = spans.groupBy("k1", "k2", F.floor(F.col("a") / REACH).alias("stretch")).agg(each).select("k1", "k2", "spans").mapInArrow(join, schema)
    return near.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(join, schema)


def merged_spans(col):
    """Each row's list of spans (a, b), sorted, those that meet or overlap as one; of fewer than 2^23 rows, below 2^40."""
    begin, (a, b) = unfolded(col, ("a", "b"))
    row = np.repeat(np.arange(len(col)), np.diff(begin)) << 40
    order = np.argsort(row + a, kind="stable")
    a, row = a[order], row[order]
    reach = np.maximum.accumulate(row + b[order])
    new = np.ones(len(a), bool)
    new[1:] = row[1:] + a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a))[: len(first)] - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first] >> 40, minlength=len(col)))])
    spans = pa.StructArray.from_arrays([pa.array(a[first]), pa.array(reach[last] & ((1 << 40) - 1))], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans)


def cutter(least: int, keep_text: bool, words: int | None = None):
    def whole(data: bytes) -> bool:
        return len(data) >= least or (words is not None and len(word_bounds(np.frombuffer(data, np.uint8))[0]) >= words)

    def run(batches):
        for b in few(batches):  # few texts are held as strings
            yield cut_texts(b)

    def cut_texts(b):
        rows = []
        for text, spans, copies in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("copies").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            n = len(data)
            cut = [(0, n)] if copies and whole(data) else [(s["a"], s["b"]) for s in spans or []]
            at, kept, digest = 0, [], hashlib.sha256()
            for a, e in [*cut, (n, n)]:
                kept.append(data[at:a])
                digest.update(kept[-1])
                at = e
            # a character half removed goes as a whole
            text = b"".join(kept).decode("utf-8", "ignore") if keep_text else None
            rows.append((n, sum(e - a for a, e in cut), len(cut), digest.hexdigest(), text, [{"a": a, "b": e} for a, e in cut]))
        n, removed, count, sha, text, spans = (list(x) for x in zip(*rows, strict=True)) if rows else ([],) * 6
        return pa.RecordBatch.from_arrays(
            [*b.columns[:-3], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()),
             pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
            names=[*b.schema.names[:-3], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"],
        )

    return run


def remove_repeats(docs: DataFrame, least: int = MIN_BYTES, batches: int = BATCHES, keep_text: bool = True, words: int | None = None) -> DataFrame:
    """The columns of docs but text, with n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans (in place of
    columns of those names): every byte of a least-byte string that also starts elsewhere goes.  With words, every
    byte of a repeated passage of so many words goes too, however few bytes it has."""
    made = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<a long, b long>>")
    rest = [c for c in docs.columns if c != "text" and c not in made.names]
    base = docs.select((F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *text_key("text"))
    texts = base.select("k1", "k2", "text")
    copies = base.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k1", "k2", F.lit(True).alias("copies"))
    spans = find_repeats(texts, least, batches)
    if words is not None:
        spans = spans.unionByName(find_short_repeats(texts, words, least))
    about = staged(merged(spans).join(copies, ["k1", "k2"], "full_outer"), "sa-about")
    rows = base.join(about, ["k1", "k2"], "left").select("row", "text", "spans", F.coalesce("copies", F.lit(False)).alias("copies"))
    cut = rows.mapInArrow(cutter(least, keep_text, words), T.StructType([rows.schema["row"], *made.fields]))
    return cut.select(*(f"row.{c}" for c in rest), *made.names)
