import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factlog.llm import host_rules as hr

SPACE = re.compile("[\x20\x09-\x0d]+")


def plain(text):
    words = [w for w in SPACE.split(text) if w]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \t\n\x0b\x1c#é😀", max_size=60), max_size=8))
def test_measures_equal_plain_counts(texts):
    assert np.array(hr.measure(texts)).T.tolist() == [plain(t) for t in texts]


def test_measures_across_groups_of_texts(monkeypatch):
    texts = ["a b c a b c", "a b c", "b c a b", "", "x " * 40, "a b c d a b c"] * 3
    want = [plain(t) for t in texts]
    for size in (1, 10, 1 << 21):
        monkeypatch.setattr(hr, "GROUP_CHARS", size)
        assert np.array(hr.measure(texts)).T.tolist() == want


GOOD = " ".join(f"word{i}" for i in range(60))
SHOUT = GOOD + " ###### ######" * 2
LINES = GOOD + "\n" + "\n".join(["one line"] * 8)


def corpus():
    rows = [(i, GOOD, f"h{i % 40}") for i in range(4000)]
    rows += [(10_000 + i, LINES if i % 5 else GOOD, "copied") for i in range(500)]  # four fifths of a host repeat their lines
    rows += [(20_000 + i, SHOUT, "tiny") for i in range(2)]  # too few documents to judge their host
    rows += [(30_000, SHOUT, None), (30_001, "short", None), (30_002, None, "h1"), (30_003, "", "h1"), (None, GOOD, "h2"), (5, GOOD, "h5"), (30_004, "x" * 200_000 + " y" * 60, "h3")]
    return rows


def test_hosts_are_judged_and_clean_documents_kept(spark):
    df = spark.createDataFrame([(*r, "z", 1) for r in corpus()], "doc_id long, text string, source string, n string, rule int").repartition(7)
    out = hr.host_rules(df).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in corpus())
    for r in out:
        if r.doc_id is not None and 10_000 <= r.doc_id < 20_000:
            assert r.host_rules == ["dup_lines"] and not r.kept and not r.base_failed
        else:
            assert r.host_rules is None and r.kept == (r.doc_id not in (30_001, 30_002, 30_003, 30_004) and not r.base_failed)
    assert hr.host_rules(df.where("false")).count() == 0
    assert hr.host_rules(df.where("source = 'copied'")).where("NOT kept").count() == 0  # a single host has nothing to be measured against


def test_rates_follow_the_prior(spark):
    rows = spark.createDataFrame([(f"h{h}", 10 if i < f else 100) for h, (n, f) in enumerate([(100, 2), (100, 4), (1, 1), (400, 300)]) for i in range(n)], "source string, n_words long")
    rows = rows.selectExpr("source", "n_words", "n_words * 5 AS word_chars", "0L AS n_symbols", "0L AS n_dup_lines", "0L AS n_repeat_words", "1L AS n_lines")
    got = {r.source: r for r in hr.host_rates(rows).where("rule = 'few_words'").collect()}
    n, f = np.array([100, 100, 1, 400]), np.array([2, 4, 1, 300])
    m, total = f.sum() / n.sum(), n.sum()
    between = ((f * f / n).sum() - f.sum() * m) / (m * (1 - m)) - 3
    share = min(1 / 11, max(0.01, between / (total - (n * n).sum() / total - 3)))
    for h in range(4):
        r = got[f"h{h}"]
        assert (r.n, r.failed) == (n[h], f[h]) and r.prior_rate == pytest.approx(m) and r.rate == pytest.approx((f[h] + (1 / share - 1) * m) / (n[h] + 1 / share - 1))
