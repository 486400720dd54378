"""Texts longer than a chunk, and pipeline stages on nulls, empty tables, ties and clashing columns."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeline.llm import bpe, bytehash, editprint, minhash, mixing, rules, suffix
from gaugeline.llm.common import staged

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def long(spark):
    """Two near copies and a text that shares a passage over the first one's chunk border."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    words = [rng.choice(vocabulary) for _ in range(240_000)]
    text = " ".join(words)
    border = text.encode()[bytehash.CHUNK - 700 : bytehash.CHUNK + 700].decode("utf-8", "ignore")
    near = words[:]
    for i in range(0, len(near), 9000):
        near[i] = "changed"
    rows = [(1, text), (2, " ".join(near)), (3, "own words before " + border + " own words after"), (4, None)]
    assert len(text.encode()) > bytehash.CHUNK + 100_000
    return dict(rows), spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_long_near_copies_are_linked(long):
    texts, df = long
    got = {r.doc_id: r for r in minhash.near_duplicates(df, 85).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    w = texts[1].split()
    assert got[1].n_shingles == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def test_long_repeats_are_cut_over_chunk_borders(long):
    texts, df = long
    df = df.where("doc_id in (1, 3)")
    got = {r.doc_id: r for r in suffix.remove_repeats(df, 400).collect()}
    start = texts[1].encode().index(texts[3].encode()[100:600]) - 100
    a, b = texts[1].encode(), texts[3].encode()
    lo, hi = 100, 600
    while a[start + lo - 1] == b[lo - 1]:
        lo -= 1
    while hi < len(b) and a[start + hi] == b[hi]:
        hi += 1
    assert got[3].n_removed == got[1].n_removed == hi - lo and got[1].n_spans == 1
    assert got[1].kept_sha256 == hashlib.sha256(a[: start + lo] + a[start + hi :]).hexdigest()


def test_long_texts_keep_their_measures(long):
    texts, df = long
    led = {r.doc_id: r for r in rules.ledger(df).collect()}
    w = texts[1].split(" ")
    assert (led[1].n_words, led[1].word_chars, led[4].n_words) == (len(w), sum(map(len, w)), 0)
    size = {r.doc_id: r["size"] for r in mixing.mix(df).collect()}
    assert size[1] == len(w) and size[4] == 0
    got = {r.doc_id: r for r in editprint.fingerprint_edits(df).collect()}
    walk = editprint.Walk()
    assert got[1].fingerprint == editprint.fingerprints([texts[1]], walk)[0]
    assert got[1].near_edited > 0.6 and got[2].near_next < 0.2
    cut = len(texts[1]) // 4
    assert got[1].edited_sha256 == hashlib.sha256((texts[1][: len(texts[1]) - cut] + texts[2][:cut]).encode()).hexdigest()


def test_long_texts_are_encoded_whole(long):
    texts, df = long
    got = {r.doc_id: r for r in bpe.encode(df.where("doc_id in (1, 4)"), RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(texts[1].encode()).hexdigest() and got[4].ids == []
    assert got[1].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(got[1].ids)}I", *got[1].ids)).hexdigest()


def test_empty_tables_of_encoding_and_rules(none):
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert rules.apply_policy(rules.ledger(none)).count() == 0 and rules.ablations(rules.ledger(none)).where("n_failed > 0").count() == 0


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_pipeline_stages_on_edges(spark, sf, stage):
    prose = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(i, prose(f"w{i}x"), "en", "s", 300) for i in range(8)] + [(None, None, None, None, None), (None, prose("n"), None, None, None), (20, "", "en", "t", 0), (21, "one", None, "t", 3), (21, "one", None, "t", 3)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("score", "row", "key", "copies", "g", "size", "u", "tie", "component_id", "spans", "kept_text", "k1", "n_removed", "label")))
    one = staged(stage(spark, docs, "/root/testdata/sf0.001"), "test-edge")
    other = staged(stage(spark, clash, "/root/testdata/sf0.001"), "test-edge")
    assert one.columns == other.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert one.where("doc_id < 8").select("doc_id").distinct().count() >= 1
    assert stage(spark, docs.where("1 = 0"), "/root/testdata/sf0.001").count() == 0


def test_what_each_stage_keeps_is_what_its_operator_decides(spark):
    """The stages one after another against plain Python, on texts for which each decision is plain."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    rows = [(i, prose(80), "en", ["a", "b"][i % 2], 0) for i in range(12)]
    rows += [(20, rows[3][1], "en", "a", 0), (21, rows[4][1] + " end", "en", "b", 0)]  # an exact and a near copy
    rows += [(i, f"{prose(30)}\n{passage}\n{prose(30)}", "en", "a", 0) for i in (30, 31, 32)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    kept = staged(corpus_pipeline.drop_near_duplicates(spark, docs, ""), "test-kept")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), 30, 31, 32]
    cut = staged(corpus_pipeline.cut_repeats(spark, kept, ""), "test-cut")
    got = {r.doc_id: r for r in cut.collect()}
    plain = {r[0]: r[1] for r in rows}
    assert set(got) == {*range(12), 30, 31, 32}
    for d, r in got.items():
        want = plain[d] if d < 12 else plain[d].replace(f"\n{passage}\n", "")
        assert r.text == want and r.n_chars == (0 if d < 12 else len(want))
    taken = corpus_pipeline.mix_sources(spark, cut, "").collect()
    mixed = {(r.doc_id, r.source): r.copies for r in mixing.mix(cut).collect()}
    count = {k: sum((r.doc_id, r.source) == k for r in taken) for k in mixed}
    assert count == mixed and all(r.text == got[r.doc_id].text for r in taken)
