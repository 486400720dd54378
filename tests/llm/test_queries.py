"""Oracles of the operators' queries, and the pipeline stage by stage."""

import random

import pytest
from oracle import differences

import corpus_pipeline
from gaugeline.llm import queries, suffix

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf, name):
    assert not differences(queries.queries()[name](spark, sf), ORACLES[name], sf)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = queries.chat.staged(stage(spark, docs, sf), "test-stage")
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.where("quality = 1 and toxic = 0").count()
    assert sizes[0] > 0.7 * good and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[4]
    assert docs.where("n_tokens <> size(ids)").count() == 0


def test_near_dedup_of_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(100))
    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (None, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (None, text("d") + " more"), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = queries.chat.staged(corpus_pipeline.drop_near_duplicates(spark, docs, ""), "test-kept")
    want = [(1, text("a")), (None, text("b")), (2, text("c")), (3, text("d")), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    # no copy is left that the next stage would remove whole
    left = corpus_pipeline.cut_repeats(spark, kept, "").collect()
    assert sorted(((r.doc_id, r.text) for r in left if r.text), key=str) == sorted(want[:4], key=str)


def test_passages_of_short_words_are_cut(spark):
    passage = " ".join("aé"[i * i % 7 % 2] + "bcdfgh"[i % 5] for i in range(51))
    assert len(passage.encode()) < corpus_pipeline.PASSAGE
    phrase = " ".join(passage.split()[1:])
    texts = [f"one {passage} uno", f"two\n{passage}\tdue", f"three {phrase} tre", f"four {phrase} quattro", f"five {phrase}x cinque"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {0: "one  uno", 1: "two\n\tdue"} | {i: texts[i] for i in (2, 3, 4)}


def test_planted_passages_of_400_bytes_are_cut_and_clean_texts_left(spark, tmp_path):
    """Passages of over 50 words: op4 cuts those of 400 bytes, as its contract says, and leaves the shorter ones, which
    go with words=51.  n_bytes is the input's length: it differs from n_chars by the letters, not by what was cut."""
    rng = random.Random(8)
    prose = lambda n, size, letters: " ".join("".join(rng.choice(letters) for _ in range(size)) for _ in range(n))
    texts = []
    for letters in ("abcdefghij", "abcdéüñßhi"):
        long, short = prose(70, 7, letters), prose(55, 4, letters)
        assert len(long.encode()) >= 400 > len(short.encode()) + 2
        # the line feeds at a passage's ends repeat with it, the letters next to them don't
        texts += [(k, prose(40, 7, letters) + f"{i}\n", p, f"\n{i}" + prose(40, 7, letters)) for k, p, n in (("long", long, 4), ("short", short, 3), ("none", "", 2)) for i in range(n)]
    rows = [(i, a + p + b, "en", "s", len(a + p + b)) for i, (_, a, p, b) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = queries.table(spark, str(tmp_path), "documents")
    got = {r.doc_id: r for r in queries.queries()["op4_suffix_repeats"](spark, str(tmp_path)).collect()}
    words = {r.doc_id: r.kept_text for r in suffix.remove_repeats(docs.select("doc_id", "text"), 400, words=51).collect()}
    for i, text, _, _, chars in rows:
        kind, a, p, b = texts[i]
        r, cut = got[i], kind == "long"
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(text.encode()), cut * (len(p.encode()) + 2), cut)
        assert r.text == (a[:-1] + b[1:] if cut else text)
        assert (r.n_bytes == chars) == (i < len(rows) / 2)
        assert (p not in words[i]) if p else words[i] == text
