"""The registered queries on odd rows, on empty tables, and against their SQL."""

import hashlib
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
import oracle  # noqa: E402

from factlog.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Columns that operators make themselves, which a table may have too.
CLASHES = "quality y at want spans held_out score predicted n_shingles component_id n_links n_words n k1 k2 chunk bucket idx cid copies grams own other edited edited_sha256 next_text near_id h bits accepted lang_pred ids_sha256 n_tokens n_bytes n_known base_score kind place of x a b row shard cluster bin piece start position room size u w c p".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
ODD = [
    (None, None, None, None, None),
    (1, "", "en", "s", 0),
    (1, "", "en", "s", 0),
    (2, "the same few words again here", "en", "s", 29),
    (3, "the same few words again here", "en", None, 29),
    (4, "x" * 100_000, "en", "s", 100_000),
    (5, "a " * 20_000 + "b@c.de +1 (632) 555-4827", "de", "s", 3),
    (6, "  \t é", "fr", "s", 4),
]
TEXT = {i: t or "" for i, t, *_ in ODD}


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(request.param))
    rows = ODD if request.param == "odd" else []
    spark.createDataFrame([(*r, *["x"] * len(CLASHES)) for r in rows], DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (4, 0, 0)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, [1.0, 2.0], 1), (2, None, 1)][: len(rows)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, len(rows)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


#: What the odd rows give: for every row, checked by its id.
WANT = {
    "op1_embedding_dedup": lambda r: (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True),
    "op2_token_counts": lambda r: r.n_bytes == len(TEXT[r.doc_id].encode()) and (r.n_tokens == 0) == (not TEXT[r.doc_id]) and r.over_limit == (r.n_tokens > 512),
    "op3_pii": lambda r: (r.n_email, r.n_ip, r.n_card, r.n_phone) == ((1, 0, 0, 1) if r.doc_id == 5 else (0, 0, 0, 0)) and r.spans == ("email:40000:40006,phone:40007:40024" if r.doc_id == 5 else ""),
    "op4_packing": lambda r: r.start + r.n_words <= len(TEXT[r.doc_id].split()) and r.room >= 0,
    "op5_quality": lambda r: 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5),
    "op6_ngram_join": lambda r: (r.n_shingles, r.component_id, r.n_links) == {None: (0, None, 0), 1: (0, 1, 0), 2: (2, 2, 1), 3: (2, 2, 1), 4: (1, 4, 0), 5: (5, 5, 0), 6: (1, 6, 0)}[r.doc_id],
    "op7_spotsigs": lambda r: r.n_chars == len(TEXT[r.doc_id]) and 0 <= r.near_edited <= 1,
    "op8_language_id": lambda r: (r.lang_pred == "und") == (r.doc_id in (None, 1)) and 0 <= r.score <= 1,
    "op9_bpe": lambda r: r.decoded_sha256 == sha(TEXT[r.doc_id]) and (r.n_tokens > 0 or r.ids_sha256 == sha("")),
    "op10_pitman_yor": lambda r: r.n_tokens == len(TEXT[r.doc_id].split()) + 1 and r.score < 0 and r.base_score < 0,
    "op13_host_rules": lambda r: r.n_words == len(TEXT[r.doc_id].split()) and r.base_failed == (r.doc_id != 5 or r.n_repeat_words > 1000) and not r.kept,
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, tables, name):
    d, n = tables
    rows = queries.QUERIES[name](spark, d).collect()
    if name in ("op11_whitening", "op12_spelling"):
        # one vector has no variance; no text has a word of seven letters twice (the long runs are of one document each)
        assert not [r for r in rows if name == "op11_whitening" or len(r.word) < 7 or r.n < 2]
        return
    key = "vec_id" if name.startswith("op1_") else "doc_id"
    if name == "op4_packing":
        words = Counter()
        for r in rows:
            words[r.doc_id] += r.n_words
        assert words == Counter({i: len(t.split()) for i, t in TEXT.items()} if n else {})
        assert len({(r.bin, r.position) for r in rows}) == len(rows) and (not n or len({r.bin for r in rows if r.doc_id in (2, 3)}) == 2)
    else:
        ids = [1, 2] if key == "vec_id" else [i for i, *_ in ODD]
        assert Counter(r[key] for r in rows) == Counter(ids if n else [])
    assert not [r for r in rows if not WANT[name](r)]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    got, want = oracle.compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF, oracle.connect(SF))
    assert got == want
