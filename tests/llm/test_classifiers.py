import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlog.llm import language_id as li
from factlog.llm import quality as q
from factlog.llm.common import fold, table

SF = "/root/testdata/sf0.01"
ODD = [(None, None), (1, ""), (1, ""), (2, "123 !?"), (3, "x" * 60000), (4, "Ünï ß 漢字")]


def test_held_out_languages(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r for r in li.language_id(docs, fold(2, 4)).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in out]) > 0.98
    assert np.mean([r.accepted for r in out]) > 0.99 and all(0 <= r.score <= 1 for r in out)


def test_a_foreign_text_is_rejected(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(99999, "ծննդյան օրվա առթիվ շնորհավորում եմ ձեզ բոլորիդ " * 5, None)], "doc_id long, text string, lang string")
    (r,) = li.language_id(docs.union(more), fold(2, 4)).where("doc_id = 99999").collect()
    assert not r.accepted and r.lang_pred != "und"


def test_probabilities_sum_to_one():
    texts = ["the cat sat", "the dog ran to the cat", "thé"]
    codes, n = np.unique(li.grams(texts)[0], return_counts=True)
    model = li.Model(codes, n)
    context = int(li.grams(["the "])[0][2]) & (1 << 48) - 1
    every = np.array([(context << 16 | c) & (1 << 64) - 1 for c in range(1 << 16)], np.uint64)
    assert abs(np.exp2(model.log2(every)).sum() - 1) < 1e-6


def plain_bits(training, text):
    """Interpolated Kneser-Ney from its definition, over tuples of code points."""
    pad = lambda x: [1, 1, 1, *map(ord, x.lower())]
    counts = Counter(tuple(p[i - 3 : i + 1]) for p in map(pad, training) for i in range(3, len(p)))
    levels = []
    for _ in range(4):
        ones, twos = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        d = min(0.95, max(0.1, ones / max(1, ones + 2 * twos))) if ones else 0.5
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        levels.append((counts, d, total, kinds))
        counts = Counter(g[1:] for g in counts)
    bits, p = 0.0, pad(text)
    for i in range(3, len(p)):
        prob = 1 / 65536
        for k, (counts, d, total, kinds) in enumerate(reversed(levels), 1):
            g = tuple(p[i - k + 1 : i + 1])
            if total[g[:-1]]:
                prob = max(counts[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * prob
        bits -= math.log2(prob)
    return bits / max(len(text), 1)


LEARNED = [(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat", "en"), ("a dog ran to the cat", "en"), ("der hund lief zur katze", "de"), ("die katze saß da", "de"), ("le chat est là", "fr"), ("", "fr"), (None, "en"), ("the the the the the", "en"), ("nobody", None)])]
ASKED = [(100, "the katze", None), (101, "là-bas le chien", None), (102, "xyz", None), (103, "12 34", None), (104, None, None), (105, "the katze", None), (None, "hund und katze", None), (106, "ß", None)]


@pytest.mark.parametrize("room", [li.ROOM, 0])
def test_predictions_equal_brute_force_however_models_are_held(spark, room):
    docs = spark.createDataFrame(LEARNED + ASKED, "doc_id long, text string, lang string").repartition(3)
    out = li.language_id(docs, F.coalesce(F.col("doc_id") >= 100, F.lit(True)), room=room).collect()
    assert len(out) == len(LEARNED + ASKED)
    names = ["de", "en", "fr"]
    training = {g: [t for _, t, x in LEARNED if x == g and t is not None] for g in names}
    want = []
    for i, t, _ in LEARNED + ASKED:
        bits = [plain_bits(training[g], t or "") for g in names]
        und = not any(map(str.isalpha, t or ""))
        want.append((i if i is not None else -1, "und" if und else names[int(np.argmin(bits))], round(min(bits), 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.lang_pred, round(r.bits, 6)) for r in out) == sorted(want)


def test_both_ways_accept_the_same(spark):
    docs = table(spark, SF, "documents").where("doc_id < 300")
    a, b = (sorted(tuple(r) for r in li.language_id(docs, fold(2, 4), room=room).withColumn("bits", F.round("bits", 6)).withColumn("score", F.round("score", 6)).collect()) for room in (li.ROOM, 0))
    assert a == b
    kept = [sorted(r.doc_id for r in li.keep_known(docs, fold(2, 4), room=room).collect()) for room in (li.ROOM, 0)]
    assert kept[0] == kept[1] == [r[0] for r in a if r[5]]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in ODD], "doc_id long, text string, lang string, bits int")
    out = li.language_id(docs, F.lit(False)).collect()
    assert len(out) == len(ODD)
    assert sorted(r.lang_pred for r in out) == ["en", "en", "und", "und", "und", "und"]
    assert {r.lang_pred for r in li.language_id(docs, F.lit(True)).collect()} == {"und"}
    assert li.language_id(docs.where("false"), F.lit(False)).count() == 0


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    out = [r for r in q.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels"), fold(1, 3)).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([labels[r.doc_id] == r.predicted for r in out]) > 0.95


def test_odd_rows_have_scores(spark):
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in ODD], "doc_id long, text string, y string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, None)], "doc_id long, quality int")
    out = q.quality_scores(docs, labels, F.lit(False)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = q.quality_scores(docs.drop("n_chars"), labels.where("false"), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    assert q.quality_scores(docs.where("false"), labels, F.lit(False)).count() == 0


def test_scores_equal_brute_force(spark):
    """The trained machine's score of every text, from plain counts and every pair of inputs."""
    docs, labels = table(spark, SF, "documents").where("doc_id < 120"), table(spark, SF, "labels")
    machine = q.train(docs.where(~fold(1, 3)), labels)
    got = {r.doc_id: r.score for r in q.quality_scores(docs, labels, fold(1, 3)).collect()}
    for r in docs.collect():
        words = Counter(zlib.crc32(w) % q.DIM for w in r.text.encode().lower().split())
        length = math.sqrt(sum(math.log1p(n) ** 2 for n in words.values()))
        inputs = [(k, math.log1p(n) / length) for k, n in words.items()]
        offsets, at, x = q.features([r.text], [r.n_chars], q.Words())
        inputs += [(int(i), float(v)) for i, v in zip(at, x, strict=True) if i >= q.DIM]
        raw = machine.bias + sum(machine.w[i] * v for i, v in inputs)
        vs = np.array([machine.v[i] * v for i, v in inputs])
        raw += np.triu(vs @ vs.T, 1).sum()
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-3)


def test_pairs_by_the_identity():
    m = q.Machine()
    m.w[:] = np.random.default_rng(0).normal(size=m.w.shape)
    offsets, at, x = q.features(["a b b c", "d"], [None, 1], q.Words())
    raw, _ = m.raw(offsets, at, x)
    for k in range(2):
        i, v = at[offsets[k] : offsets[k + 1]], x[offsets[k] : offsets[k + 1]]
        want = m.bias + m.w[i] @ v + sum(m.v[i[a]] @ m.v[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert raw[k] == pytest.approx(want, abs=1e-3)
