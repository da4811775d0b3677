import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlog.llm import packed
from factlog.llm import pitman_yor as py
from factlog.llm.common import fold
from factlog.llm.ngram_join import WordHashes


def corpus():
    rng = random.Random(0)
    common = ["the", "of", "and", "to"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(1, 40)):
            words.append(rng.choice(common) if rng.random() < 0.4 else "w" + str(int(rng.paretovariate(0.8)) % 400))
            if words[-1] == "the":
                words.append("cat")
        rows.append((i, " ".join(words), "x", 1))
    return rows + [(900, None, "x", 1), (901, "", "x", 1), (901, "", "x", 1), (None, "The CAT\tsat É", "x", 1), (7, "never-seen words zzz", "x", 1)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, row int").repartition(3)
    return rows, py.lm_scores(df, fold(2, 7)).collect()


def test_base_equals_brute_force(scored):
    rows, out = scored
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, x, *_ in rows if not held(i) for t in py.tokens(x or ""))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, held(i), len(t := py.tokens(x or "")), sum(c[k] > 0 for k in t), n, round(sum(np.log10((c[k] + 1) / (n + v + 1)) for k in t), 6)) for i, x, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want


def test_model_beats_the_base(scored):
    rows, out = scored
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert len({r.score for r in out if r.n_tokens == 1}) == 1


def exact_tables(c, p, a, d):
    """The distribution of a dish's tables, over all seatings of its customers."""
    f = np.array([0.0, 1.0])
    for i in range(1, c):
        t = np.arange(len(f) + 1)
        stay, fresh = np.append(f, 0) * (i - d * t), np.append(0, f) * p * (a + d * (t - 1))
        f = (stay + fresh) / (stay + fresh).sum()
    return f


@pytest.mark.parametrize(("c", "p", "a"), [(2, 0.3, 2.0), (5, 0.1, 20.0), (12, 0.02, 300.0), (40, 0.05, 30.0), (300, 0.001, 2000.0), (3000, 0.01, 500.0)])
def test_seating_follows_the_exact_distribution(c, p, a):
    n, d = 10_000, 0.6
    t = py.seat(np.full(n, c), np.full(n, p), np.full(n, a), d, np.random.default_rng(0))
    want = exact_tables(c, p, a, d)
    mean = want @ np.arange(len(want))
    assert abs(t.mean() - mean) < 0.03 * mean
    if c <= 5:
        assert np.abs(np.bincount(t.astype(int), minlength=len(want)) / n - want).max() < 0.02


def test_seating_keeps_to_the_customers():
    t = py.seat(np.array([1, 5, 100000]), np.full(3, 0.01), np.full(3, 1.0), 0.5, np.random.default_rng(0))
    assert t[0] == 1 and 1 <= t[1] <= 5 and 1 <= t[2] < 1000


def test_empty_and_all_held_out(spark):
    df = spark.createDataFrame(corpus()[:5], "doc_id long, text string, word string, row int")
    assert py.lm_scores(df.where(F.lit(False)), fold(2, 7)).count() == 0
    out = py.lm_scores(df, F.lit(True)).collect()
    assert len(out) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in out)


def test_rare_contexts_and_words_are_learned(spark):
    """300 pairs of words that only occur together."""
    rows = [*((100 + i, f"x{i % 300} y{i % 300}") for i in range(1500)), (1, "x299 y299"), (2, "x299 y298")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.score for r in py.lm_scores(df, F.col("doc_id") < 10).where("held_out").collect()}
    assert out[1] > out[2] + 1


def test_scores_equal_brute_force_and_every_context_sums_to_one(spark, monkeypatch):
    """The learned tables are taken out of the packed rows, and every text is scored from dictionaries."""
    monkeypatch.setattr(py, "CHUNK_DOCS", 40)
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, row int").repartition(3).withColumn("held_out", fold(2, 7))
    chunks = py.written(py.chunks_of(df))
    links, state, words, figures = py.learn(chunks, 64, 1, 2)
    hashes = WordHashes()
    n = Counter()
    for i, text, *_ in rows:
        t = [py.END, *py.tokens(text or "")]
        n.update(zip(t, t[1:], strict=False) if not held(i) else ())
    cut = lambda w: hashes[w] >> 24
    seats = {}
    for r in state.collect():
        u, w, c, _, t = py.expand(r.x, *py._STATE)
        seats |= {(a, b): (c_, t_) for a, b, c_, t_ in zip(u.tolist(), w.tolist(), c.tolist(), t.tolist(), strict=True)}
    assert {k: c for k, (c, _) in seats.items()} == {(cut(a), cut(b)): c for (a, b), c in n.items() if c > 1}
    tables = {(a, b): seats[cut(a), cut(b)][1] / 2 if c > 1 else 1 for (a, b), c in n.items()}
    p, (weight, scale, floor) = {}, figures["last"]
    for r in words.collect():
        h, _, _, _, share, sums = py.expand(r.x, *py._WORD)
        p |= dict(zip(h.tolist(), (sums + weight * (share * scale + floor)).tolist(), strict=True))
    assert abs(sum(p.values()) + figures["floor"] - 1) < 1e-9
    total, t_of = Counter(), Counter()
    for (a, b), c in n.items():
        total[a] += c
        t_of[a] += tables[a, b]

    def prob(a, b):
        back = (1 + figures["d"] * t_of[a]) / (1 + total[a])
        own = (n[a, b] - figures["d"] * tables[a, b]) / (1 + total[a]) if (a, b) in n else 0
        return own + back * p.get(hashes[b], figures["floor"]), back

    vocabulary = {b for _, b in n}
    for a in total:
        assert abs(sum(prob(a, b)[0] for b in vocabulary) + prob(a, b"?")[1] * figures["floor"] - 1) < 1e-9
    got = py.scores_of(chunks, py.answered(links, state, words, chunks, 64, figures), 64, figures).collect()
    want = []
    for i, text, *_ in rows:
        t = [py.END, *py.tokens(text or "")]
        want.append((i if i is not None else -1, round(sum(np.log10(prob(a, b)[0]) for a, b in zip(t, t[1:], strict=False)), 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 6)) for r in got) == sorted(want)


def test_packed_columns_round_trip():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    for n in (0, 1, 1000):
        a, b, c = packed.expand(packed.squeeze(keys[:n], np.arange(n, dtype=np.int32), np.ones(n)), np.uint64, np.int32, np.float64)
        assert (a == keys[:n]).all() and (b == np.arange(n)).all() and (c == 1).all()
