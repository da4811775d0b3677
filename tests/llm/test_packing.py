from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factlog.llm import packing, queries


def plain(sizes, sources, clusters, capacity, per_source):
    bins = []
    out = []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n and b["room"] > 0 and c not in b["clusters"] and b["sources"][s] < per_source]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
        bins[i]["room"] -= n
        bins[i]["clusters"].add(c)
        bins[i]["sources"][s] += 1
        out.append((i, bins[i]["room"]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 2), st.integers(0, 4)), max_size=40), st.integers(1, 3))
def test_equals_plain_best_fit(pieces, per_source):
    columns = [list(x) for x in zip(*pieces, strict=True)] or [[], [], []]
    assert packing.pack(*columns, 10, per_source) == plain(*columns, 10, per_source)


def test_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i if i % 9 else None, " ".join(f"w{i % 30}_{k}" for k in range(rng.integers(1, 30))), ["a", "a", "b", None][i % 4], "x") for i in range(200)]
    rows += [(500, None, "a", "x"), (501, "", "a", "x"), (501, "", "a", "x"), (502, "z " * 95, "a", "x"), (503, "z " * 40, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string")
    out = packing.best_fit(docs, capacity=20, per_source=2, shard_rows=50).collect()
    words = Counter()
    bins = defaultdict(list)
    for r in out:
        words[r.doc_id] += r.n_words
        bins[r.bin].append(r)
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len((t or "").split())
    assert words == want
    for b in bins.values():
        assert sum(r.n_words for r in b) + b[0].room == 20 and len({r.room for r in b}) == 1
        assert sorted(r.position for r in b) == list(range(len(b)))
    assert sorted(r.piece for r in out if r.doc_id == 502) == [0, 1, 2, 3, 4]
    assert sum(r.n_words == 0 for r in out) == 3
    source = {i: s for i, _, s, _ in rows if i is not None}
    for b in bins.values():
        assert max(Counter(source[r.doc_id] for r in b if r.doc_id is not None).values(), default=0) <= 2
    assert packing.best_fit(docs.where(F.lit(False))).count() == 0


def test_copies_never_share_a_bin(spark):
    docs = spark.createDataFrame([(i, "The  same text" if i % 2 else "the same TEXT", "s") for i in range(50)], "doc_id long, text string, source string")
    out = packing.best_fit(docs, capacity=100).collect()
    assert len({r.bin for r in out}) == 50


def test_repeated_rows_are_dealt_over_the_shards(spark):
    docs = spark.createDataFrame([(None, "", "s")] * 600, "doc_id long, text string, source string")
    out = packing.best_fit(docs, shard_rows=50).collect()
    shards = Counter(r.bin.split(":")[0] for r in out)
    assert len(out) == 600 and len({r.bin for r in out}) == 600 and len(shards) == 12 and max(shards.values()) < 120


def test_empty_documents_column_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, "q", 5)], "doc_id long, text string, source string, n int, shard string, h int")
    assert [(r.doc_id, r.n_words) for r in packing.best_fit(docs).collect()] == [(1, 2)]


def test_query_keeps_near_copies_apart(spark, tmp_path):
    words = [f"w{k}" for k in range(100)]
    rows = [(i if i else None, " ".join([*words[: 20 + i], f"only{i}", *words[20 + i :]]), f"s{i}") for i in range(8)]
    rows += [(8, " ".join(words).upper(), "s8"), (1, "another text of the same id", "s9")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op4_packing(spark, str(tmp_path)).collect()
    assert len(out) == 10 and len({r.bin for r in out if r.n_words > 10}) == 9
    assert next(r.bin for r in out if r.n_words == 6) in {r.bin for r in out if r.n_words > 10}
