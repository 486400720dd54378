"""Word-end BPE against its library, the prefix trie and hard negatives against brute force."""

import binascii
import hashlib
import math
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeline.llm import hardneg, running, trie, wordbpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Wörter'S  don't\tI'LL 12x34", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "ΟΔΟΣ Σ", "é é 가 가", "x\x1cy\x85z　w", "!?" * 200, "ab" * 4000, "thethe" * 700]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_word_bpe_equals_the_library(spark, docs, none, texts, library):
    rows = [(d, t) for d, t in texts] + [(2000 + i, t) for i, t in enumerate(ODD)]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((str(d), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids))
    df = docs.select("doc_id", "text", F.lit("x").alias("ids")).unionByName(spark.createDataFrame([(2000 + i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string"))
    out = wordbpe.encode(df, WORDS, keep_ids=True).cache()
    assert sorted((str(r.doc_id), *r[1:]) for r in out.collect()) == sorted(want)
    back = wordbpe.decode(out, WORDS).collect()
    assert sorted(r.text for r in back) == sorted(library.decode(w[4], skip_special_tokens=False) for w in want)
    assert wordbpe.encode(none, WORDS).count() == 0


def test_groups_in_a_pattern_split_short_and_long_texts_alike(spark):
    from gaugeline.llm import bpe

    ranks, t = public_tokenizers.path("byte_bpe_50k.tiktoken"), "one two  three " * 4
    df = spark.createDataFrame([(1, t), (2, t + "x" * (1 << 20))], "doc_id long, text string")
    grouped = public_tokenizers.PATTERN.replace(r"\s+(?!\S)", r"(\s+)(?!\S)")
    assert grouped != public_tokenizers.PATTERN
    rows = lambda p: sorted(tuple(r) for r in bpe.encode(df, ranks, p).collect())
    assert rows(grouped) == rows(public_tokenizers.PATTERN)


def test_similar_classes_take_extra_columns(spark, docs):
    from gaugeline.llm import editprint

    prints = editprint.fingerprint(docs.select("doc_id", "text").where("doc_id < 40"))
    assert editprint.similar_classes(prints.withColumn("f", F.lit("x")).withColumn("node", F.lit(1))).count() == prints.count()


def test_word_bpe_random_strings(library):
    rng, own = random.Random(3), wordbpe.Encoder(wordbpe.read_tokenizer(WORDS))
    letters = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x300, 0x330)] + ["'re", "<|endoftext|>", " ", " ", "\n", "Σ", "İ", "日本", "😀"]
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        got = b"".join(p for p, _ in own.blocks(t))
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_scan_and_heap_agree():
    rng, spec = random.Random(4), wordbpe.read_tokenizer(WORDS)
    for n in [1, 2, 3, 127, 128, 129, 400] * 8:
        parts = [spec["inner"][ord(rng.choice("aeint"))] for _ in range(n)]
        assert wordbpe.merge_short(list(parts), spec["rank"], spec["made"]) == wordbpe.merge_long(list(parts), spec["rank"], spec["made"])


def test_blocks_of_a_long_text(monkeypatch, library):
    monkeypatch.setattr(wordbpe, "TEXT_BLOCK", 10)
    own, t = wordbpe.Encoder(wordbpe.read_tokenizer(WORDS)), "some words  and\nothers " * 30
    packed, said = map(b"".join, zip(*own.blocks(t), strict=True))
    ids = library.encode(t, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids and said[1:].decode() == library.decode(ids, skip_special_tokens=False)


def test_other_tokenizer_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        wordbpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def n_words(t):
    return sum(1 for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w)


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = binascii.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, saved, leaves = {}, {}, {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * (n_words(p[-1][1]) if p else 0)
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
    ends = {p: ",".join(str(c) for c in sorted(m) if made[c] == p) for p, m in members.items()}
    return sorted(
        (min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()
    )


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_against_brute_force(spark):
    rng = random.Random(6)
    say = ["yes", "no no", "", None, "a  b\tc", "Ünder 日本"]
    rows = []
    for c in rng.sample(range(140), 100):
        for turn in range(rng.randint(1, 7)):
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", None]), rng.choice(say[: 2 + turn])))
    rows += [(7000 + c, t, "user", "same") for c in range(30) for t in range(3)]  # many that end at one node
    rows += [(9000, t, "user", f"turn {t}") for t in range(300)] + [(9020, t, "user", f"turn {t}") for t in range(299)]  # long ones that part late
    rows += [(None, 0, "user", "lost"), (rows[0][0], *rows[0][1:])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, said string, place long").repartition(5)
    assert trie_rows(trie.conversation_trie(df)) == brute_trie(rows)
    assert trie.conversation_trie(df.where("1 = 0")).count() == 0
    assert trie_rows(trie.conversation_trie(df.where("conv_id = 9000"))) == brute_trie([r for r in rows if r[0] == 9000])


def test_ends_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 20)
    found = spark.createDataFrame([(1, 2, 3, c) for c in range(500)] + [(1, 2, 4, 5)], "depth long, hi long, lo long, conv_id long").repartition(7)
    got = {r.lo: r.ends_sha256 for r in trie.ends(found).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), 4: hashlib.sha256(b"5").hexdigest()}


def test_running_sums_of_one_key_in_many_partitions(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.randint(-5, 9)) for k in (1, 2, 2000) for i in range(1500 if k == 2 else 40)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = running.running(spark.createDataFrame(rows, "k long, i long, v long").repartition(9), "k", [F.col("i").asc()], ("v",))
    have = {(r.k, r.i): r.v_run for r in got.collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want, up = {}, {}
    for k, i, v in sorted(rows):
        up[k] = up.get(k, 0) + v
        want[k, i] = up[k]
    assert have == want


def brute_negatives(rows, every):
    best = {}
    for v, e, label in rows:
        if v is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        best[v] = min(best.get(v, (math.inf,)), (label, e))
    ints = {v: (label, [math.floor(256 * x) if abs(x) < 1e30 else int(x) * 256 for x in e]) for v, (label, e) in best.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(ints[a][1], ints[b][1], strict=False))
    out = []
    for a in sorted(ints):
        if a % every:
            continue
        near = sorted((-dot(a, b), b) for b in ints if b != a and ints[b][0] == ints[a][0])[:5]
        far = sorted((-dot(a, b), b) for b in ints if ints[b][0] != ints[a][0])
        for s, p in near:
            fits = [(-t, n) for t, n in far if 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, p, i, n, max(-(2**63), min(2**63 - 1, -s)), max(-(2**63), min(2**63 - 1, t))) for i, (t, n) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("kind", ["plain", "odd"])
def test_negatives_against_brute_force(spark, kind, monkeypatch):
    rng = random.Random(11)
    # a small batch, so that a partition's best carry over, and small tiles
    for name, value in (("ROWS", 64), ("ANCHORS", 8), ("BLOCK_BYTES", 4096)):
        monkeypatch.setattr(hardneg, name, value)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(4)]
    rows = [(v, [round(c + rng.gauss(0, 0.12), 2) for c in centres[v % 4]], rng.randrange(4) if v % 3 else v % 4) for v in range(400)]
    if kind == "odd":
        rows += [(400, None, 1), (401, [0.1, None], 1), (402, [math.nan] * 12, 2), (403, [math.inf] * 12, 2), (404, [0.2] * 5, 2), (405, [], 1), (None, [0.1] * 12, 1), (407, [0.1] * 12, None)]
        rows += [(410, [1e20, -3e22] + [0.5] * 10, 1), (420, [2e21] * 12, 1), (421, [1e21] * 12, 3), (3, rows[3][1], rows[3][2]), (5, [9.0] * 12, 0), *[(430 + i, [0.25] * 12, i % 3) for i in range(12)]]
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "vec_id long, embedding array<double>, label int, score double, g string").repartition(5)
    got = hardneg.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_negatives(rows, 10))
    assert hardneg.mine(df.where("1 = 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_drop_rows_before_the_last_plane(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(-100, 100, (3000, 64))
    rows[:50] = rows[0] + rng.integers(-3, 4, (50, 64))
    looked = []
    kept_at = hardneg.Sliced.added_to
    monkeypatch.setattr(hardneg.Sliced, "added_to", lambda self, j, i, r: looked.append((j, len(i))) or kept_at(self, j, i, r))
    sliced = hardneg.Sliced(rows[:1], rows)
    i, r, s = hardneg.kept(sliced, slice(0, 1), np.ones((1, 3000), bool), np.array([0]), [-(1 << 2200)], None, 5)
    exact = rows @ rows[0]
    assert set(np.argsort(-exact)[:5]) <= set(r.tolist()) and (exact[r] == s).all()
    assert looked and looked[-1][1] < 300


def test_rows_whose_hashes_clash_stay_apart(spark, monkeypatch):
    import corpus_pipeline

    class Clashing:
        """pyspark.sql.functions with one first hash for all rows."""

        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *columns):
            return F.lit(7).cast("long") if len(columns) == 10 else F.xxhash64(*columns)

    monkeypatch.setattr(corpus_pipeline, "F", Clashing())
    docs = spark.createDataFrame([(i // 2, f"text {i // 2}", "en", "s", 6) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.identified(docs).collect()
    assert len(rows) == 8 and len({r.row for r in rows}) == 4 and len({(r.row, r.text) for r in rows}) == 4
