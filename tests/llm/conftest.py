import random

import pytest

EDGE = [(None, "null id text"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one two three"), (904, "one two three"), (905, "Ärger naïve 😀 日本語 " * 3)]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose with copies, near copies, shared passages, a long text, edge cases."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(5, 160))) for i in range(60)]
    base, passage = prose(150), prose(110)
    for i in range(60, 100):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, prose(20) + "\n" + passage + "\n" + prose(rng.randint(0, 40))) for i in range(100, 115)]
    rows += [(115, base), (116, base.upper()), (117, prose(6000)), (118, "ab " * 900), (119, "x" * 1500), (120, passage[:399]), (121, passage[-400:])]
    return rows + EDGE


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(d, t, "en", ["s1", "s2", None][i % 3], len(t or ""), f"extra{i}") for i, (d, t) in enumerate(texts)]
    # columns whose names clash with the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")
