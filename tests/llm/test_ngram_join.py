import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlog.llm import ngram_join as nj


def plain(rows, width=5, percent=75):
    """By brute force: every pair of rows."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    n = len(rows)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    low = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low[find(i)], d)
    return sorted((d if d is not None else -1, len(sets[i]), low[find(i)] if d is not None else -1, links[i]) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    passage = [word() for _ in range(60)]
    rows, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and bases:
            t = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                k = rng.randrange(len(t))
                t[k : k + 1] = [word()] if len(t) < 2 else rng.choice([[], [word()], [t[k], word()]])
        else:
            t = [word() for _ in range(rng.choice([1, 3, 4, 5, 6, 30, 80, 200]))]
            if kind > 0.8:
                t += passage
            bases.append(t)
        rows.append((i, " ".join(t) if rng.random() < 0.9 else "\t".join(t).upper()))
    return rows


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.n_links) for r in df.collect())


@pytest.mark.parametrize("percent", [75, 60])
def test_equals_brute_force(spark, percent):
    rows = corpus(percent, 350)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A\tB"), (1005, "é b"), (1006, "É b"), (None, "a b"), (1003, "a b"), (1003, "c d e f g h")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, k1 string, n int, chunk int").repartition(5)
    assert got(nj.ngram_join(df, percent=percent)) == plain(rows, percent=percent)


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        t = list(base)
        t[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(nj.ngram_join(df)) == plain(rows)


def test_empty(spark):
    assert nj.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.1, 0.4])
def test_derived_answers_equal_counted_ones(spread):
    rng = np.random.default_rng(0)
    core = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core[rng.random(100) >= spread * rng.random()], rng.integers(100, 400, rng.integers(1, 2 + int(60 * spread))).astype(np.uint64)])) for _ in range(60)]
    common = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array([len(x) for x in sets])
    for percent in (60, 75, 90):
        want = 100 * common >= percent * (size[:, None] + size[None] - common)
        assert (nj.links_within(sets, None, percent) == want).all()
        assert (nj.links_within(sets[:11], sets[11:], percent) == want[:11, 11:]).all()
        assert (nj.links_within(sets[:3], None, percent) == want[:3, :3]).all() and (nj.links_within(sets[:1], sets[1:3], percent) == want[:1, 1:3]).all()


def test_a_chain_of_documents(spark):
    """Each of 200 documents links with its neighbours alone."""
    words = [f"w{i}" for i in range(200 * 8 + 100)]
    rows = [(1000 - i, " ".join(words[8 * i : 8 * i + 90])) for i in range(200)]
    out = got(nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == plain(rows) and {r[2] for r in out} == {801} and {r[3] for r in out} == {1, 2}


def test_packed_lists_round_trip():
    at = np.sort(np.random.default_rng(0).integers(0, 1 << 32, 1000).astype(np.uint32))
    owner = np.arange(1000, dtype=np.uint16)
    a, b = nj._unpack(nj._pack(at, owner))
    assert (a == at).all() and (b == owner).all()


def test_columns(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert nj.ngram_join(df).select(F.col("doc_id"), "n_shingles", "component_id", "n_links").dtypes == [(c, "bigint") for c in ("doc_id", "n_shingles", "component_id", "n_links")]
    more = df.withColumn("n_words", F.lit(7))
    assert [tuple(r) for r in nj.ngram_join(more, carry=["n_words"]).select("doc_id", F.lit(1)).collect()] == [(1, 1)]
    assert nj.ngram_join(df.withColumn("x", F.lit(7)), carry=["x"]).first().x == 7
