import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlog.llm import bpe, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "  a", "don't 'rest ''s 's's !'s I'll 'LL we've\n\n  x \t\ty  ", "a" * 5000, "é ñ ß 漢字 🎉🎉 ١٢٣ x y z\x1cq", "<|endoftext|> a<|endoftext|><|endoftext|>b", "The same.", "The same.", "x\r\n \r\n'", "　 　a"]

TOKENISER = Tokenizer.from_file(JSON)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
CACHE = bpe.PieceCache(bpe.read_ranks(RANKS), 10_000)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i // 2 if i else None, t, "x", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, ids int")


def test_counts_equal_the_library(docs):
    rows = token_counts.token_counts(docs, JSON, limit=5, table_size=16, cache_size=3).collect()
    want = sorted((len((t or "").encode()), len(TOKENISER.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS)
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in rows)


def test_counts_of_pieces(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.token_counts(docs, path).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(model.encode(t or "")) for t in TEXTS)


def test_round_trip(docs):
    rows = bpe.bpe_round_trip(docs, RANKS, cache_size=3, ids=True).collect()
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    ids = [ENCODING.encode_ordinary(t or "") for t in TEXTS]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted((len(i), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for i, t in zip(ids, TEXTS, strict=True))


def test_decode(docs):
    out = bpe.bpe_decode(bpe.bpe_round_trip(docs, RANKS, ids=True), RANKS)
    assert sorted(r.text for r in out.collect()) == sorted(t or "" for t in TEXTS)


def test_empty(spark, docs):
    none = docs.where(F.lit(False))
    assert token_counts.token_counts(none, JSON).count() == 0 and bpe.bpe_round_trip(none, RANKS).count() == 0


ALPHABET = st.one_of(st.sampled_from(list("  '''strevmdlLSaz19.!\n\t\r \x1c é漢🎉")), st.characters(codec="utf-8"))


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_boundaries_equal_the_pattern(text):
    (at,) = bpe.boundaries([text])
    got = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
    assert got == regex.findall(token_counts.SPLIT, text)
    assert [int(x) for p in got for x in CACHE[p][1].split(",")] == ENCODING.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_split_counts_equal_the_library(text):
    count = token_counts.library(JSON)
    pieces = regex.findall(token_counts.SPLIT, text)
    assert (sum(count(pieces)) if pieces else 0) == count([text])[0]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab the"), min_size=49, max_size=300))
def test_long_pieces(text):
    assert [i for p in regex.findall(token_counts.SPLIT, text) for i in bpe.merge(p.encode(), CACHE.ranks)] == ENCODING.encode_ordinary(text)
    assert len(bpe.merge((text.replace(" ", "x")).encode(), CACHE.ranks)) == len(ENCODING.encode_ordinary(text.replace(" ", "x")))


def test_scan_replays_the_automaton():
    kinds = np.random.default_rng(0).integers(0, 12, 5000).astype(np.uint8)
    now, want = bpe.S_START, []
    for k in kinds:
        now = bpe.NEXT[k, now]
        want.append(now)
    assert bpe.states(kinds).tolist() == want
