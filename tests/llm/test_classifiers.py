"""The classifiers' parts against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import quality, toxicity
from gaugeline.llm.bytehash import Hasher


def test_features_are_words_repeats_and_character_ngrams():
    texts = ["añb ñ ñ 日本語 x", "", "ab", "x x x\nx", "😀😀é"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    with np.errstate(over="ignore"):
        words, again, *grams = quality.features(Hasher(), np.frombuffer(b"".join(raw), np.uint8), off)
    name = {}
    for i, t in enumerate(texts):
        w = t.split()
        f, first = words
        assert len({(x, b) for x, b in zip(w, f[first[i] : first[i + 1]], strict=True)}) == len(set(w))
        f, first = again
        assert f[first[i] : first[i + 1]].tolist() == [quality.AGAIN] * sum(a == b for a, b in zip(w, w[1:], strict=False))
        for n, (f, first) in zip(quality.NGRAMS, grams, strict=True):
            mine = [t[k : k + n] for k in range(len(t) - n + 1)]
            for g, b in zip(mine, f[first[i] : first[i + 1]].tolist(), strict=True):
                assert name.setdefault(g, b) == b
    assert len(set(name.values())) == len(name)


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    parts = [(np.array([0, 1, 2, 1]), np.array([0, 3, 3, 4])), (np.array([4, 4]), np.array([0, 0, 0, 2]))]
    y, weight = np.array([1, 0, 1]), np.array([0.7, 1.6, 0.7])
    params = [rng.normal(size=(5, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)]

    def loss(params):
        z = quality.hidden_of(parts, params[0], 3)[0] @ params[1] + params[2]
        return sum(weight[i] * (math.log(np.exp(z[i]).sum()) - z[i, y[i]]) for i in range(3)) / 3

    for k, g in enumerate(quality.gradients(parts, y, weight, *params)):
        for at in np.ndindex(g.shape):
            up, down = ([p.copy() for p in params] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[at]) < 1e-7


def test_calibration_is_the_best_scale_and_shift():
    rng = np.random.default_rng(4)
    z = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-3 * z - 1))).astype(int)
    w = np.where(y == 1, 0.5, 2.0)
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (200 - y.sum() + 2))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * z + b)))
        return -(w * (goal * np.log(p) + (1 - goal) * np.log(1 - p))).sum()

    a, b = quality.calibrated(z, y, w)
    assert a > 1 and all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert quality.calibrated(z, np.ones(200, int), w) == (1.0, 0.0)


def votes_of(n, seed):
    """Class 1 speaks one of two vocabularies; voters 1 and 4 copy 0 and 3 mostly; now and then a vote is wrong."""
    rng = random.Random(seed)
    rows, truth = [], []
    for i in range(n):
        v, y = [0] * 6, int(i % 6 == 0)
        if y:
            base = rng.choice((0, 3))
            v[base] = int(rng.random() < 0.7)
            v[base + 1] = v[base] if rng.random() < 0.95 else 1 - v[base]
            v[base + 2] = int(rng.random() < 0.6)
        elif rng.random() < 0.01:
            v[rng.randrange(6)] = 1
        rows.append(v)
        truth.append(y)
    return np.array(rows, float), np.array(truth)


def test_likelihood_equals_the_product_of_rates():
    rng = np.random.default_rng(5)
    votes = (rng.random((7, 4)) < 0.5).astype(float)
    parent = np.array([-1, 0, 1, -1])
    given, alone = rng.uniform(0.1, 0.9, (2, 4)), rng.uniform(0.1, 0.9, (2, 4))
    got = toxicity.likelihood(votes, parent, given, alone)
    for i, v in enumerate(votes):
        for c in range(2):
            want = 1.0
            for j in range(4):
                p = given[c, j] if parent[j] < 0 or v[parent[j]] else alone[c, j]
                if parent[j] < 0:
                    p = alone[c, j]
                want *= p if v[j] else 1 - p
            assert abs(math.exp(got[i, c]) - want) < 1e-9


def test_forest_joins_the_voters_that_depend_on_each_other():
    votes, truth = votes_of(3000, 6)
    parent = toxicity.forest(votes, [truth.astype(float), 1.0 - truth])
    links = {frozenset((j, int(p))) for j, p in enumerate(parent) if p >= 0}
    assert {frozenset((0, 1)), frozenset((3, 4))} <= links and len(links) < 6

    def information(a, b):
        total = 0.0
        for c in (0, 1):
            rows = votes[truth == c]
            for x in (0, 1):
                for z in (0, 1):
                    both = ((rows[:, a] == x) & (rows[:, b] == z)).sum()
                    if both:
                        total += both * math.log(both * len(rows) / ((rows[:, a] == x).sum() * (rows[:, b] == z).sum()))
        return total

    # no link left out would join two trees, or is stronger than the weakest on the way it would close
    tree = defaultdict(set)
    for link in links:
        a, b = link
        tree[a].add(b)
        tree[b].add(a)

    def way(a, b, seen):
        if a == b:
            return []
        for x in tree[a] - seen:
            if (rest := way(x, b, seen | {a})) is not None:
                return [(a, x), *rest]

    for a in range(6):
        for b in range(a):
            path = way(a, b, set())
            own = information(a, b)
            assert 2 * own <= toxicity.SIGNIFICANT if path is None else all(information(*x) >= own - 1e-6 for x in path)


def test_label_model_finds_the_classes_without_labels():
    votes, truth = votes_of(6000, 7)
    post = toxicity.label_model(votes, np.full(6, 0.05), 0.1)
    fired = votes.any(1)
    assert (post[~fired] < 0.3).all() and abs(post.mean() - truth.mean()) < 0.05
    right = ((post > 0.5) == (truth == 1))[fired].mean()
    assert right > 0.93 and post[votes.sum(1) > 1].min() > 0.9


def test_mined_voters():
    rng = random.Random(8)
    y = np.array([i % 3 == 0 for i in range(300)], int)
    y[290:] = -1
    pairs = sorted({(i, rng.randrange(40) + (40 if y[i] == 1 and rng.random() < 0.8 else 0)) for i in range(300) for _ in range(4)})
    doc, f = (np.array(x) for x in zip(*pairs, strict=True))
    voters, wrong = toxicity.mine(doc, f, y, [3, 3, 10**6])
    assert voters[0] == 3 and len(set(voters)) == len(voters)
    reached = {i for i, b in pairs if b == 3}
    for b, share in zip(voters, wrong, strict=True):
        hit = {i for i, x in pairs if x == b}
        t, n = sum(y[i] == 1 for i in hit), sum(y[i] >= 0 for i in hit)
        assert abs(share - (n - t + 0.5) / (n + 1)) < 1e-12
        if b != 3:
            assert t >= toxicity.SUPPORT and t >= toxicity.PRECISION * n and sum(y[i] == 1 for i in hit - reached) >= toxicity.NEW
        reached |= hit


@pytest.mark.parametrize("module", [quality, toxicity])
def test_extra_columns_stay_and_score_is_replaced(docs, module):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = module.fit(docs, labels)
    clash = docs.withColumns({"score": F.lit("old"), "row": F.lit(7), "label": F.lit(None).cast("int")})
    got = module.score(clash, model)
    assert sorted(got.columns) == sorted(clash.columns) and dict(got.dtypes)["score"] == "double"
    same = module.score(docs.select("doc_id", "text"), model)
    key = lambda r: (str(r.doc_id), r.text or "", r.score)
    assert sorted(map(key, got.collect())) == sorted(map(key, same.collect()))


@pytest.mark.parametrize("module", [quality, toxicity])
def test_texts_beyond_a_chunk_are_scored_whole(spark, module, monkeypatch):
    from gaugeline.llm import bytehash

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(40)) + (" idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = module.fit(df, df.select("doc_id", "label"))
    long = " ".join(word() for _ in range(2 * bytehash.CHUNK // 6)) + " idiot"
    long = spark.createDataFrame([(1, long), (2, long[:-6]), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in module.score(long, model).collect()}
    assert len(got) == 3 and all(0 <= s <= 1 for s in got.values())
    if module is toxicity:
        assert got[1] > got[2]  # the last word counts
