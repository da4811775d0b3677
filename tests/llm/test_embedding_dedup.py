import numpy as np
from pyspark.sql import functions as F

from factlog.llm import embedding_dedup as ed
from factlog.llm.common import share_of

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, copies int"


def plain(rows, threshold):
    ok = [(i, np.asarray(v, float), g) if i is not None and g is not None and ed._raw(v, np.float64) else None for i, v, g, *_ in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                x, y = ok[a][1], ok[b][1]
                link[a, b] = link[b, a] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    return link


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(len(base))] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.15, 0.25, 3.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)), "x", 1))
    return rows


def check(spark, rows, threshold=0.93, **more):
    link = plain(rows, threshold)
    out = ed.embedding_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, **more).collect()
    assert len(out) == len(rows)
    return link, out


def test_recall_and_no_false_link(spark):
    rows = vectors(1, 600)
    link, out = check(spark, rows)
    want, got = link.sum(axis=1), {r.vec_id: r.n_links for r in out}
    assert all(got[i] <= w for i, w in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_full_traversal_is_exact(spark):
    rows = vectors(2, 300) + [(1000, None, 1, "x", 1), (1001, [0.0] * 16, 1, "x", 1), (1002, [float("nan")] + [1.0] * 15, 1, "x", 1), (1003, [1.0, None], 1, "x", 1), (1004, [1.0] * 16, None, "x", 1), (None, [1.0] * 16, 1, "x", 1), (1005, [1.0] * 3, 1, "x", 1), (1006, [2.0] * 3, 1, "x", 1), (1006, [2.0] * 3, 1, "x", 1), (1007, [], 1, "x", 1)]
    link, out = check(spark, rows, recall=1.0, cell_rows=4)
    reach = np.eye(len(rows), dtype=bool) | link
    for _ in range(9):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    ids = [r[0] for r in rows]
    low = [min((ids[j] for j in np.flatnonzero(reach[i]) if ids[j] is not None), default=None) for i in range(len(rows))]
    want = sorted((i if i is not None else -1, int(link[k].sum()), low[k] if i is not None else -1) for k, i in enumerate(ids))
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in out)
    assert got == want


def test_double_columns_keep_their_digits(spark):
    """Two pairs on either side of the threshold by less than a float can tell, and components beyond a float's range."""
    edge = lambda c: [c, float(np.sqrt(1 - c * c)), 0.0]
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, edge(0.93 + 1e-12), 1), (3, [1.0, 0.0, 0.0], 2), (4, edge(0.93 - 1e-12), 2), (5, [1e300, 0.0, 0.0], 3), (6, [1e299, 1e298, 0.0], 3)]
    out = ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1.0).collect()
    assert {r.vec_id: r.n_links for r in out} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1}


def test_codebooks_grow_with_the_rows():
    assert ed.codes_for(100, 32) == 2 and ed.codes_for(32 * 64**2, 32) == 64 and ed.codes_for(32 * 1000**2, 32) == 1000


def test_samples_of_any_share(spark):
    df = spark.range(20_000).withColumn("x", F.lit("a"))
    assert abs(df.where(share_of(0.1, "id", "x")).count() - 2000) < 200
    assert df.where(share_of(1.0, "id")).count() == 20_000 and df.where(share_of(1e-15, "id")).count() == 0


def test_large_cell_is_cut(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * 0.01], 1, "x", 1) for i in range(1400)]
    out = ed.embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(1399, 0)}


def test_traversal_order():
    rng = np.random.default_rng(4)
    grid = ed.Grid(rng.normal(size=(5, 4)), rng.normal(size=(6, 4)))
    x = rng.normal(size=(50, 8))
    sums = (ed.distances(x[:, :4], grid.first)[:, :, None] + ed.distances(x[:, 4:], grid.second)[:, None]).reshape(50, -1)
    assert (grid.traverse(x, 7) == sums.argsort(axis=1)[:, :7]).all()


def test_empty(spark):
    assert ed.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ed.embedding_dedup(spark.createDataFrame([(1, None, 1, "x", 1)], SCHEMA)).select(F.col("kept")).collect()[0].kept
