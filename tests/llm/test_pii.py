import hashlib
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlog.llm import pii
from factlog.llm.pii_examples import examples

FIELD = pii.train(examples())
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    """The contract's patterns as they are written."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate(d[::-1])) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 13 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                out.append((k, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from(list("aZ09@@..%+- ()1425\n,é")), max_size=80))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("a1@ \n.")), max_size=60))
def test_windows_hold_every_signal_once(text):
    spans = [w for run in pii.windows(text) for w in run]
    assert spans == sorted(set(spans))
    want = {m.span() for m in re.finditer(r"\S+", text) if re.search(r"[0-9@]", m[0])}
    assert want <= set(spans) and all(not re.search(r"\s", text[a:b]) for a, b in spans)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    field = pii.Field({})
    field.t = rng.normal(size=field.t.shape)
    e = rng.normal(size=(3, 3, len(pii.TAGS)))
    field.scores = lambda s: (e, np.array([3, 2, 1]))
    t, n = field.t + pii.allowed(), len(pii.TAGS)
    for i, (size, got) in enumerate(zip((3, 2, 1), field.decode([["x"] * 3] * 3), strict=True)):
        best = max(np.ndindex(*[n] * size), key=lambda p: t[-1, p[0]] + sum(e[i, j, x] for j, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert got == list(best)


def test_field_adds_and_leaves_alone():
    texts = ["of +1 (578) 555-6437 4918187128635271 eredth", "write to ana (at) example (dot) org soon", "the 12 of 1999 and 3.5 more", "nothing here at all"]
    base = [pii.base_spans(t) for t in texts]
    got = [[(pii.KINDS[k], t[a:b]) for k, a, b in s] for t, s in zip(texts, pii.added_spans(texts, base, FIELD), strict=True)]
    assert got[0] == [("phone", "+1 (578) 555-6437"), ("card", "4918187128635271")]
    assert got[1] == [("email", "ana (at) example (dot) org")]
    assert got[2] == [] and got[3] == []


def test_spelled_out_addresses_are_found():
    text = "we met at home. questions to lea at example dot org please, or at noon"
    (found,) = pii.added_spans([text], [pii.base_spans(text)], FIELD)
    assert [text[a:b] for _, a, b in found] == ["lea at example dot org"]


def test_long_runs_are_decoded_as_a_whole_would_be(monkeypatch):
    rng = np.random.default_rng(2)
    some = ["call +1 (632) 555-4827 or", "card 4539 1488 0343 6467 was", "host 10.20.30.40 in", "12 of 1999", "4 8 15 16 23 42", "3.5 2021-03-04"]
    text = " ".join(some[i] for i in rng.integers(0, len(some), 400))
    base = [pii.base_spans(text)]
    cut = pii.added_spans([text], base, FIELD)
    monkeypatch.setattr(pii, "RUN", 1 << 20)
    assert max(map(len, pii.windows(text))) > 1000 and cut == pii.added_spans([text], base, FIELD) and cut[0]


def test_many_number_words_take_little_memory():
    text = " ".join(map(str, range(200_000)))
    tracemalloc.start()
    base = [pii.base_spans(x) for x in (text, "nothing 1")]
    pii.added_spans([text, "nothing 1"], base, FIELD)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def test_query_form(spark):
    rows = [(1, "a@b.co and +1 (632) 555-4827", "x"), (1, "a@b.co and +1 (632) 555-4827", "x"), (None, None, "y"), (2, "", "z"), (3, "9" * 30000 + " 1.2.3.4", "spans"), (4, "4111 1111 1111 1111", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.find_pii(docs, FIELD, redacted=True).collect()
    assert len(out) == 6
    for r in out:
        text = next((t or "") for i, t, _ in rows if i == r.doc_id)
        want = plain(text) if len(text) < 1000 else [(1, 30001, 30008)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in range(4))
        assert set(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(","))
    assert {r.clean for r in out if r.doc_id == 1} == {"[email] and [phone]"}
    assert pii.find_pii(docs.where(F.lit(False)), FIELD).count() == 0


@pytest.mark.parametrize("spans", [[(0, 0, 4), (3, 2, 6)], [(3, 2, 6), (0, 0, 4)]])
def test_overlaps_are_redacted_once(spans):
    assert pii.redact("abcdefgh", spans) == "[email]gh"
