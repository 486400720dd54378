"""Encoding, rules, classifiers, mixing, archives and chats."""

import base64
import hashlib
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gaugeline.llm import bpe, chat, mixing, quality, queries, rules, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(RANKS).splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(docs, texts, library):
    want = []
    for d, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True), RANKS)
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(t or "" for _, t in texts)


@pytest.mark.parametrize("piece", ["a" * 9000, "=-" * 6000, " " * 5000, "thethethererest" * 800])
def test_long_pieces(piece, library):
    ids = bpe.Transducer(*bpe.compiled(bpe.read_ranks(RANKS))).encode(piece.encode())
    assert ids == library._encode_single_piece(piece)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_rules(docs, texts):
    want = []
    for d, t in texts:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        at = defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
        fails = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((str(d), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), fails))
    led = rules.apply_policy(rules.ledger(docs)).cache()
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = led.collect()
    assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    few = {r.rule: (r.n_failed, r.n_only) for r in rules.ablations(led).collect()}
    names = list(rules.rule_columns())
    for n in rules.POLICIES[2]:
        bit = 1 << names.index(n)
        mask = rules.bits(rules.POLICIES[2])
        assert few[n] == (sum(bool(r.failed & bit) for r in got), sum(r.failed & mask == bit for r in got))
    assert rules.apply_policy(led.drop("base_failed", "kept", "policy"), 1).where("kept = base_failed").count() == 0


def test_junk_is_dropped_and_prose_kept(spark, sf):
    kept = rules.apply_policy(rules.ledger(spark.read.parquet(f"{sf}/documents.parquet"))).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in kept.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 10 * n.get((0, True), 0) and n[1, True] > 20 * n[1, False]


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("name", "label", "least"), [("op5_weak_toxicity", "toxic", 0.85), ("op6_subword_quality", "quality", 0.9)])
def test_held_out(spark, sf, name, label, least):
    got = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([(r.score, r[label]) for r in got]) > least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_edges(spark, docs, none, module):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    labels = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, label int"))
    model = module.fit(docs, labels)
    got = module.score(docs.select("doc_id", "text"), model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert module.score(none.select("doc_id", "text"), module.fit(none, labels)).count() == 0


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(docs, none):
    got = mixing.mix(docs, key=True).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert len(got) == docs.count() and all(r.source_size == size[r.source] for r in got)
    want = water(size)
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] for s in want)
    biggest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= biggest for s in want)
    again = mixing.mix(docs.repartition(5), key=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0


def test_rates_are_tilted_by_each_documents_words(spark):
    import math

    sizes = {"sa": [(1, 7), (10, 300), (40, 120), (900, 3)], "sb": [(3, 5), (50, 50), (700, 9)], "s": [(20, 4)], "sc": [(5, 2)], "sd": [(0, 9)]}
    part = {"sa": 1.7, "sb": 0.4, "s": 1.2, "sc": 2.0, "sd": 0.0}
    cells = spark.createDataFrame([(g, s, n) for g, c in sizes.items() for s, n in c], "g string, size long, n long")
    total = {g: sum(s * n for s, n in c) for g, c in sizes.items()}
    docs = {g: sum(n for _, n in c) for g, c in sizes.items()}
    goals = spark.createDataFrame([(g, part[g] * total[g], total[g], docs[g]) for g in sizes], "g string, target double, source_size long, docs long")
    got = {r.g: r.lam for r in mixing.balance(cells, goals).collect()}
    assert set(got) == {"sa", "sb", "s"}  # the others are at their cap or have no words
    for g, lam in got.items():
        rate = lambda s, x, g=g: min(2, math.exp(min(500, x * s * docs[g] / total[g])))
        lo, hi = -300.0, 300.0
        for _ in range(200):  # the same dual by bisection
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * s * rate(s, mid) for s, n in sizes[g]) < part[g] * total[g] else (lo, mid)
        assert abs(lam - lo) < 1e-8
        assert len(sizes[g]) == 1 or len({rate(s, lam) for s, _ in sizes[g]}) > 1
    plan = mixing.planned(cells, goals).collect()
    for g in sizes:
        took = sum(r["size"] * (r.n * r.base + r.extra) for r in plan if r.g == g)
        assert abs(took - part[g] * total[g]) <= max(s for s, _ in sizes[g]) / 2 and all(0 <= r.extra <= r.n for r in plan)


def test_mixing_of_ties_and_many_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 8)
    rows = [(i // 2, "a b c", "s") for i in range(300)] + [(None, "a b c", "s"), (1000, "x " * 400, "s"), (1001, "y", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s in "st":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 3
    again = mixing.mix(df.coalesce(1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_stop_at_the_cap(spark):
    rows = [("a", 1000), ("b", 10), ("c", 500), ("", 30), (None, 0), ("é", 5)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    want = water(dict(rows))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_archives(spark, tmp_path, monkeypatch):
    body = ["<p>same</p>", "ü" * 700_000, "", None, "<p>same</p>", "own", "<p>same</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", h) for i, h in enumerate(body)] + [(None, None, "own"), (6, "u", "<p>same</p>")], "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    best = {h: max((p for p, x in rows if x == h and p is not None), default=None) for _, h in rows}
    want = [(str(p), len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if best[h] == p else "revisit", None if best[h] == p else best[h]) for p, h in rows]
    assert sorted(map(str, ((str(r[0]), *r[1:]) for r in got))) == sorted(map(str, want))
    clash = pages.selectExpr("*", "1 as sha1", "'x' as body", "2 as size", "'b' as best", "0 as id", "'d' as digest")
    assert sorted(map(str, warc.round_trip(clash).collect())) == sorted(map(str, got))
    monkeypatch.setattr(warc, "REVISITS", 0)  # too many to broadcast
    assert sorted(map(str, warc.round_trip(pages).collect())) == sorted(map(str, got))
    large = {(r.page_id, r.record_type) for r in warc.round_trip(pages, min_bytes=5).collect()}
    assert {(2, "response"), (3, "response"), (0, "revisit"), (5, "response")} <= large and (None, "response") in large
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", chunk=100_000)
    chunks = warc.read_archives(manifest, chunk=100_000).where("page_id = 1").orderBy("chunk_no").collect()
    assert b"".join(r.chunk for r in chunks).decode() == body[1] and max(len(r.chunk) for r in chunks) <= 100_000 and len(chunks) > 13
    assert warc.round_trip(pages.where("1 = 0")).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "a</s>[b]"), (1, 1, "assistant", "\\b\\\\o"), (1, 1, "assistant", "\\b\\\\o"), (2, None, None, None), (2, 5, "a]s", "x"), (None, 1, "assistant", ""), (3, 2, "assistant", "é😀<s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("mask")).alias("m")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[c].t] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].m == [r[3] or "" for r in own if r[2] == "assistant"]
    assert chat.format_conversations(df.where("1 = 0")).count() == 0


def test_branches_are_ranked(spark):
    nodes = spark.createDataFrame(
        [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", "thanks", 0.0), ("t", 5, 2, "user", "hm", 1.0), ("u", 1, None, "user", "alone", 0.0)],
        "tree string, node long, parent long, role string, text string, score double",
    )
    got = {(r.tree, r.branch): [t.text for t in r.t] for r in chat.format_branches(chat.best_branches(nodes, 2)).select("tree", "branch", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert got == {("t", 1): ["q", "good", "thanks"], ("t", 2): ["q", "bad", "hm"], ("u", 1): ["alone"]}


def test_random_trees_against_brute_force(spark):
    import random

    rng = random.Random(51)
    rows = []
    for tree in range(9):
        deep = tree % 3 == 0
        for node in range(1, 2 + 12 * tree):
            parent = None if node == 1 else (node - 1 if deep and rng.random() < 0.8 else rng.randint(1, node - 1))
            rows.append((f"t{tree}", node, parent, rng.choice(["user", "assistant"]), rng.choice(["", "a</s>", f"x{node}"]), float(rng.randint(0, 3))))
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").repartition(3)
    got = {(r.tree, r.branch): [tuple(t) for t in r.t] for r in chat.format_branches(chat.best_branches(nodes, 3)).select("tree", "branch", chat.parse(F.col("formatted")).alias("t")).collect()}
    want = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        leaves = set(own) - {r[2] for r in own.values()}

        def way(n):
            return [*(way(own[n][2]) if own[n][2] else []), own[n]]

        ranked = sorted(leaves, key=lambda n: (-sum(r[5] for r in way(n)), n))
        want |= {(tree, i + 1): [(r[3], r[4]) for r in way(n)] for i, n in enumerate(ranked[:3])}
    assert got == want and max(map(len, want.values())) > 16
