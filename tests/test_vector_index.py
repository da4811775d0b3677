"""The index's rows against all pairs of numpy and against the blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factlog.operators import recall
from factlog.operators import vector_index as vi


def test_twenty_thousand_queries_on_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    n, d, k = 40_000, 16, 5
    x = (rng.normal(size=(200, d))[rng.integers(0, 200, n)] + 0.15 * rng.normal(size=(n, d))).astype(np.float64)
    ids = np.array([f"entry:{i:05d}" for i in range(n)])
    pdf = pd.DataFrame({"id": ids, "embedding": x.tolist()})
    spark.createDataFrame(pdf, "id string, embedding array<double>").write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    q = v.where(F.xxhash64("id") % 2 == 0).select(F.col("id").alias("query_id"), "embedding")
    index = vi.build(v)
    assert index.count() == n
    found, share = vi.search(index, q, k)
    assert share < 1 / 3
    got = found.toPandas().sort_values(["query_id", "rank"])
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    place = {i: j for j, i in enumerate(ids)}
    asked = got.query_id.unique()
    assert 19_000 < len(asked) == q.count() and (got.groupby("query_id").size() == k).all()
    want = []
    for lo in range(0, len(asked), 1000):
        sims = np.round(u[[place[i] for i in asked[lo : lo + 1000]]] @ u.T, 12)
        who, at = np.nonzero(sims >= np.partition(sims, -k, axis=1)[:, -k][:, None])
        order = np.lexsort((at, -sims[who, at], who))
        want.append(at[order][np.arange(len(who)) - np.searchsorted(who[order], who[order]) < k])
    assert (ids[np.concatenate(want)] == got.id.to_numpy()).all()


@pytest.mark.parametrize("floor", [None, 0.1])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_odd_vectors_and_ties_equal_the_blocks(spark, tmp_path, floor, exclude_self):
    rng = np.random.default_rng(0)
    rows = [(f"v{i}", rng.normal(size=4).round(1).tolist()) for i in range(300)] + [(f"same{i}", [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [("z", [0.0] * 4), ("z2", [0.0] * 4), ("w", [1.0, 2.0]), ("n", None), ("e", []), ("h", [1.0, None, 0.0, 0.0]), ("i", [1.0, float("inf"), 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(list(dict(rows[::3] + rows[-7:-1]).items()), "query_id string, embedding array<double>")
    vi.save(vi.build(v, block_rows=16, cells=9), str(tmp_path / "index"))
    index = vi.load(spark, str(tmp_path / "index"))
    found, share = vi.search(index, q, 4, floor, exclude_self, most_share=1.0)
    good = v.where("id NOT IN ('h', 'i')")
    want = recall.nearest(q.where("query_id NOT IN ('h', 'i')"), good, 4, floor, exclude_self)
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.sim, 9)) for r in df.collect())
    assert key(found) == key(want) and 0 < share <= 1


def test_without_pruning_the_blocks_answer(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(f"v{i}", rng.normal(size=48).tolist()) for i in range(600)], "id string, embedding array<double>")
    q = v.limit(50).select(F.col("id").alias("query_id"), "embedding")
    assert vi.search(vi.build(v), q, 3)[0] is None
    key = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    assert key(vi.nearest(q, v, 3)) == key(recall.nearest(q, v, 3))
    assert vi.nearest(q.where("false"), v, 3).count() == 0 and vi.nearest(q, v.where("false"), 3).count() == 0


def test_visits_are_sent_some_at_a_time():
    import pyarrow as pa

    u = np.eye(4)
    batch = pa.RecordBatch.from_pydict({"query_id": ["a", "b", "c", "d"]})
    blocks = {4: (np.arange(9_000),)}
    sent = list(vi._visits(batch, np.arange(4), np.ones((4, 9_000), bool), u, np.zeros(4), blocks))
    assert max(b.num_rows for b in sent) <= vi.VISITS and sum(b.num_rows for b in sent) == 36_000
