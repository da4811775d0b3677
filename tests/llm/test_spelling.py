import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factlog.llm import spelling as sp


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(docs):
    """(word, form, root, n, n_near, form_n) by comparing every two words."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(sp.UPPER, sp.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = defaultdict(set)
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1:
                near[a].add(b)
    form = {}
    for w, k in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 10 * k:
            form[w] = best
    out = set()
    for w, k in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, k, len(near[w]), words[form[w]] if w in form else None))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


DOCS = [
    (1, "anything " * 500 + "Anythinç anythinç " * 10 + "nythinç " * 2 + "anythingg anythingg"),
    (2, "aaaaaaa aaaaaaaa aaaaaaaaa " * 4 + "abababab ababababa babababa " * 3),
    (3, "Étésunion étésunion Étésunion étésunion ×÷×÷×÷× ×÷×÷×÷× word1234567words"),
    (3, "anything"), (3, "anything"), (None, "anything anythinh anythinh"), (None, None), (4, ""), (5, "short words only, a b c"), (6, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999),
    *((i, "several different somewhat lengthy wordings hereabouts") for i in range(10, 120)),
]


def test_equals_brute_force_on_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in DOCS], "doc_id long, text string, word string, run string").repartition(5)
    want = plain(DOCS)
    assert rows(sp.spelling_variants(df)) == want
    chains = {w: r for w, f, r, *_ in want if f and r != f}
    assert chains and sp.spelling_variants(df.where("false")).count() == 0 and sp.spelling_variants(df.where("text IS NULL")).count() == 0
    with pytest.raises(ValueError):
        sp.spelling_variants(df, least=3)


@settings(max_examples=8, deadline=None)
@given(st.sets(st.text("abc", min_size=4, max_size=12), min_size=2, max_size=60))
def test_every_near_pair_is_met_once(spark, words):
    pairs = [(r.a, r.b) for r in sp.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    want = {(a, b) for a in words for b in words if (len(a), a) < (len(b), b) and edits(a, b) == 1}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
