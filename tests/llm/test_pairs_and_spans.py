"""Near-duplicates, fingerprints and repeats against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from gaugeline.llm import editprint, minhash, suffix
from gaugeline.llm.graph import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, texts, percent):
    sets = [(d, shingles(t)) for d, t in texts if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    want = sorted((d, len(x), find(d), find(d) == d) for d, x in sets)
    got = minhash.near_duplicates(docs, percent).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 1, None, True)]


def test_near_duplicates_that_no_star_links(spark, monkeypatch):
    """Families in which only some pairs reach the threshold, compared in tiny blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    rng = random.Random(17)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for k in range(9):
            w = base[:]
            for at in rng.sample(range(120), rng.randint(1, 4)):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    for _ in rows:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 80).collect()}
    assert got == label and 6 < len(set(label.values())) < len(rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_repeats(raw, least):
    """For each text a mask of the bytes in strings that also start elsewhere."""
    seen = Counter(t[p : p + least] for t in raw for p in range(len(t) - least + 1))
    hits = []
    for t in raw:
        hit = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if seen[t[p : p + least]] > 1:
                hit[p : p + least] = b"\1" * least
        hits.append(bytes(hit))
    return hits


def test_repeats(docs, texts):
    least = 400
    raw = [(t or "").encode() for _, t in texts]
    want = []
    for (d, _), t, hit in zip(texts, raw, brute_repeats(raw, least), strict=True):
        spans = sum(1 for i in range(len(t)) if hit[i] and not (i and hit[i - 1]))
        want.append((str(d), len(t), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    got = suffix.remove_repeats(docs, least).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert "key" in got[0].asDict() and sum(w[2] for w in want) > 0


def test_repeats_over_many_partitions_and_clashing_columns(spark, docs):
    want = sorted(map(str, suffix.remove_repeats(docs.select("doc_id", "text"), 96, 4).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    clash = docs.select("doc_id", "text", *(docs.n_chars.alias(c) for c in ("k1", "row", "copies", "spans", "n_bytes", "pos", "anchor")))
    try:
        got = suffix.remove_repeats(clash, 96, 3)
        assert got.columns.count("spans") == 1 and {"k1", "row", "copies", "pos", "anchor"} <= set(got.columns)
        got = sorted(map(str, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_a_family_in_a_folder_takes_batches_in_several_runs(spark, tmp_path):
    rng = random.Random(21)
    prose = lambda n: "".join(rng.choice("abcdefgh ijklé") for _ in range(n))
    common = [prose(900) for _ in range(3)]
    batches = []
    for i in range(5):
        rows = [prose(rng.randint(0, 300)) + (common[rng.randrange(3)][rng.randint(0, 300) :] if rng.random() < 0.6 else "") + prose(rng.randint(0, 300)) for _ in range(12)]
        batches.append(rows + ([batches[i - 1][3]] if i else []) + ["", prose(10)])
    folder, before, met = f"file://{tmp_path}/family", [], 0
    for i, rows in enumerate(batches):
        family = suffix.Family(spark, folder, 200)  # opened anew each time
        assert [n for n, _ in family.levels] == [1 << k for k in range(3, -1, -1) if i >> k & 1]
        got = defaultdict(set)
        ids = {r.k1: r.text for r in spark.createDataFrame([(t,) for t in rows], "text string").select(*suffix.text_key("text"), "text").collect()}
        for r in family.add(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)).collect():
            got[ids[r.k1]].add((r.a, r.b))
        new = sorted(set(rows))
        raw = [t.encode() for t in [*new, *before]]
        for t, hit in zip(new, brute_repeats(raw, 200), strict=False):
            edges = [k for k in range(len(hit) + 1) if (hit[k - 1] if k else 0) != (hit[k] if k < len(hit) else 0)]
            assert got.pop(t, set()) == set(zip(edges[::2], edges[1::2], strict=True))
            met += len(edges)
        assert not got
        before += [t for t in rows if t not in before]
    assert met > 20
    family = suffix.Family(spark, folder, 200)
    assert [n for n, _ in family.levels] == [4, 1]
    with pytest.raises(ValueError):
        suffix.Family(spark, folder, 300)
    # a level is in the order of the suffixes' bytes, as far as the 16 that its rows hold
    texts = {(r.k1, r.k2): r.text.encode() for b in family.texts for r in b.collect()}
    for r in family.levels[0][1].collect():
        own = texts[r.k1, r.k2][r.pos + r.lead :][:16]
        assert [int.from_bytes(own[:8]) - 2**63, int.from_bytes(own[8:]) - 2**63] == [r.b0, r.b1]


def test_links_are_absorbed(spark):
    from gaugeline.llm.graph import absorb

    comp = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9)], "id long, component long")
    links = spark.createDataFrame([(2, 6), (7, 9), (8, 10), (1, 2)], "a long, b long")
    assert {r.id: r.component for r in absorb(comp, links, "t").collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 9: 7, 7: 7, 8: 8, 10: 8}
    assert {r.id: r.component for r in absorb(comp, links.where("1 = 0"), "t").collect()} == {1: 1, 2: 1, 5: 5, 6: 5, 9: 9}


def test_few_batches_and_one_batch_agree(docs):
    rows = lambda n: sorted(map(str, suffix.remove_repeats(docs, 96, n).drop("spans").collect()))
    assert rows(1) == rows(3)


def test_edit_fingerprints(docs, texts):
    order = sorted(((d, t or "") for d, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 4
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k] if k else t).encode()).hexdigest()))
    got = editprint.fingerprint_edits(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.doc_id != 904:
            prints[dict(texts)[r.doc_id] or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    alone = {r.doc_id: r.fingerprint for r in editprint.fingerprint(docs).collect()}
    assert all(alone[r.doc_id] == r.fingerprint for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 300 and r.doc_id < 60]
    assert all(r.near_edited > 0.5 > r.near_next for r in long)


def test_walk_in_segments_equals_the_walk_step_by_step():
    import numpy as np

    walk = editprint.Walk()
    rng = np.random.default_rng(2)
    x, off = rng.integers(0, editprint.CLASSES, 60_000), np.array([0, 0, 10, 30_000, 60_000])
    want = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        t = np.int64(0)
        for c in x[a:b]:
            want.append(walk.stay[c * editprint.PERIOD + t % editprint.PERIOD])
            t += want[-1]
    assert editprint.stays(x, off, walk).tolist() == want


def test_stays_run_to_the_next_bit_that_moves():
    """Every stay is one longer than that of the phase after it, unless the walk moves on at once."""
    stay = editprint.Walk().stay.reshape(editprint.CLASSES, editprint.PERIOD).astype(int)
    after = stay[:, [*range(1, editprint.PERIOD), 0]]
    assert stay.min() == 1 and ((stay == 1) | (stay == after + 1)).all()
    assert 1.9 < stay.mean() < 2.1


def test_few_words_replaced_in_a_long_text_leave_it_near():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(2, 10))) for _ in range(800)]
    texts = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(3000)]
        other = list(text)
        for i in rng.sample(range(3000), 6):
            other[i] = rng.choice(words)
        texts += [" ".join(text), " ".join(other)]
    walk = editprint.Walk()
    prints = editprint.fingerprints(texts, walk)
    near = [editprint.likeness(a, b, walk) for a, b in zip(prints[::2], prints[1::2], strict=True)]
    unlike = [editprint.likeness(a, b, walk) for a, b in zip(prints[::2], prints[3::2], strict=False)]
    assert sum(x >= 0.8 for x in near) > 0.65 * len(near)
    assert max(unlike) < sorted(near)[len(near) // 10]


def test_shifted_text_stays_near(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20_000))
    walk = editprint.Walk()
    a, b, c = editprint.fingerprints([text, "in" + text, text[::-1]], walk)
    assert editprint.likeness(a, b, walk) > 0.6 > 0.3 > editprint.likeness(a, c, walk)
    d = spark.createDataFrame([(1, text), (2, text), (3, text[::-1])], "doc_id long, text string")
    assert [(r.a, r.b, r.likeness) for r in editprint.similar_pairs(editprint.fingerprint(d)).collect()] == [(1, 2, 1.0)]


def test_similar_classes_equal_brute_force(spark):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefghij klmnop ") for _ in range(n))
    rows, edit = [], "an inserted piece of text"
    for size in (300, 2040, 5000):  # 2040 + 25 crosses a level border
        for _ in range(4):
            t = prose(size)
            rows += [t, t[: size // 60] + edit + t[size // 60 :], t[: size // 2] + edit + t[size // 2 :], t + edit, t]
    # a chain: the ends resemble the middle, which need not be the smallest id
    t = prose(3000)
    rows += ["#" * 330 + t[330:], t[:-330] + "#" * 330, t]
    docs = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(rows)] + [(900, ""), (901, None)]
    prints = [r.fingerprint for r in editprint.fingerprint(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    walk, parent = editprint.Walk(), list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    levels = set()
    for i in range(len(docs)):
        for j in range(i):
            if editprint.likeness(prints[i], prints[j], walk) >= 0.8:
                levels.add(prints[i].split(":")[0] != prints[j].split(":")[0])
                parent[root(i)] = root(j)
    assert levels == {True, False}
    want, pairs = defaultdict(list), defaultdict(set)
    for i, (d, _) in enumerate(docs):
        want[root(i)].append(str(d))
        pairs[root(i)].add(prints[i])
    table = spark.createDataFrame([(d, p) for (d, _), p in zip(docs, prints, strict=True)], "doc_id long, fingerprint string").repartition(3)
    got = defaultdict(list)
    for r in editprint.similar_classes(table).collect():
        got[(r.class_id, r.n_docs, r.n_links)].append(str(r.doc_id))
    told = sorted((sorted(members), n_docs) for (_, n_docs, _), members in got.items())
    assert told == sorted((sorted(members), len(members)) for members in want.values())
    least = sorted(len(p) - 1 for p in pairs.values())
    assert all(n >= k for n, k in zip(sorted(n for _, _, n in got), least, strict=True))


@pytest.mark.parametrize("block", [2000, 3])
def test_blocks_find_links_that_join_all_there_are(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(editprint, "BLOCK", block)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefghij klmnop ") for _ in range(n))
    texts = [prose(5), prose(40)]
    for size in (12, 90, 1000, 2040, 2070):
        t = prose(size)
        texts += [t, *(t[:k] + prose(rng.randint(1, 9)) + t[k:] for k in rng.sample(range(size), 6))]
    walk = editprint.Walk()
    prints = sorted(set(editprint.fingerprints(texts, walk)))
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fingerprint string").repartition(3).cache()
    rows = nodes.mapInArrow(editprint.banded(*editprint.banding(len(prints), 0.8)), "bucket long, entry long").select("bucket", "entry", F.shiftright("entry", 1).alias("node"))
    rows = rows.withColumns({"rank": F.lit(0), "component": F.col("node")})
    got = {(r.a, r.b): r.likeness for r in editprint.left_open(rows, nodes, 0.8).collect()}
    every = {(i, j): editprint.likeness(prints[i], prints[j], walk) for j in range(len(prints)) for i in range(j)}
    want = {k: v for k, v in every.items() if v >= 0.8}

    def joined(links):
        label = list(range(len(prints)))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    assert len(want) > 20 and got.keys() <= want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and joined(got) == joined(want)
    # a component is not compared within itself
    assert not editprint.left_open(rows.withColumn("component", F.lit(1)), nodes, 0.8).count()


def test_recall_of_bands_against_brute_force(spark, sf):
    """Bands alone, over real texts: at least 0.9 of the pairs of likeness 0.8 share one."""
    walk = editprint.Walk()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = sorted({r.fingerprint for r in editprint.fingerprint(docs).collect()})
    near = [(i, j) for j in range(len(prints)) for i in range(j) if abs(int(prints[i].split(":")[0]) - int(prints[j].split(":")[0])) < 2 and editprint.likeness(prints[i], prints[j], walk) >= 0.8]
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fingerprint string")
    buckets = defaultdict(set)
    for r in nodes.mapInArrow(editprint.banded(*editprint.banding(len(prints), 0.8)), "bucket long, entry long").collect():
        buckets[r.entry >> 1].add(r.bucket)
    assert len(near) > 5 and sum(bool(buckets[i] & buckets[j]) for i, j in near) >= 0.9 * len(near)


def test_empty_tables(none):
    assert minhash.near_duplicates(none).count() == 0
    assert suffix.remove_repeats(none).count() == 0
    assert editprint.fingerprint_edits(none).count() == 0
