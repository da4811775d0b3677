import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from factlog.llm import spotsigs

TEXTS = ["The cat of the house is in a red big barn, and it was old.", "", None, "xyz", "Der Hund und die Katze — das Haus für 3 Leute", "the the the", "plain words only", "The cat of the house is in a red big barn, and it was old.", "ab", "a b c d e f g h i the last", "the cat. " * 3000, "é漢🎉 of x"]


def plain(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain, anchors = [], 0
            for x in words[i + 1 :]:
                if x in spotsigs.ANCHORS:
                    anchors += 1
                    if anchors == spotsigs.REACH:
                        break
                else:
                    chain.append(x)
                    if len(chain) == spotsigs.CHAIN:
                        break
            if chain:
                out.add((w, *chain))
    return out or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("copies", [1, 40])
def test_equals_brute_force(spark, copies):
    rows = [(10 * i + c * 1000, t, "x", [1]) for c in range(copies) for i, t in enumerate(TEXTS)] + [(None, "the first of nothing", "x", [1]), (30, "xyz", "x", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, own string, other array<int>").repartition(4)
    got = spotsigs.spot_fingerprints(df).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i if i is not None else -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(plain(t), plain(edited)), 9), round(jaccard(plain(t), plain(after)), 9)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    by = {}
    for r in got:
        text = next((t or "") for i, t, *_ in rows if i == r.doc_id)
        assert by.setdefault(text, r.fingerprint) == r.fingerprint


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "the cat sat on a mat")], "doc_id long, text string")
    (r,) = spotsigs.spot_fingerprints(df).collect()
    assert r.near_next == 1.0
    assert spotsigs.spot_fingerprints(df.where(F.lit(False))).count() == 0


def near_corpus():
    rng = random.Random(5)
    anchors = ["the", "of", "and", "is"]
    word = lambda: rng.choice(anchors) if rng.random() < 0.4 else "w" + str(rng.randrange(400))
    common = " ".join(word() for _ in range(40))
    rows, bases = [], []
    for i in range(260):
        if bases and rng.random() < 0.6:
            t = rng.choice(bases[:4] if rng.random() < 0.5 else bases).split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rng.choice([4, 20, 60, 90]))] + (common.split() if rng.random() < 0.3 else [])
            bases.append(" ".join(t))
        rows.append((i, " ".join(t)))
    return rows + [(500, None), (501, ""), (501, "the quick fox"), (None, rows[0][1]), (502, rows[0][1]), (503, "only words")]


@pytest.mark.parametrize("rounds", [1, 3])
def test_near_documents_equal_brute_force(spark, rounds):
    rows = near_corpus()
    sets = [plain(t or "") for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if None not in (rows[i][0], rows[j][0]) and (jaccard(sets[i], sets[j]) >= 0.75) and not same_id:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            want[d] = min(want.get(d, 1 << 60), low[find(i)])
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, own string").repartition(3)
    got = spotsigs.near_documents(df, rounds=rounds).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.near_id if r.near_id is not None else -1) for r in got) == sorted((d if d is not None else -1, want.get(d, -1)) for d, _ in rows)
    assert len(set(want.values())) < len(want) - 50
    assert spotsigs.near_documents(df.where("false")).count() == 0


def test_near_documents_are_found_without_python(spark):
    df = spark.createDataFrame(near_corpus()[:40], "doc_id long, text string")
    plan = spotsigs.near_documents(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(i, f"the cat {i} sat on a mat") for i in range(300)], "doc_id long, text string")
    plan = spotsigs.spot_fingerprints(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
