"""Walks of some queries at a time: the rows of all at once, and no table of all scores."""

import random
from pathlib import Path

from factlog.operators import graph
from factlog.session import PREFIX, discard, shared_dir


def test_walks_from_the_left_equal_those_of_all_queries_at_once(spark, monkeypatch):
    """r13_recall."""
    monkeypatch.setattr(graph, "LEAST", 3)
    monkeypatch.setattr(graph, "BLOCK", 3)
    monkeypatch.setattr(graph, "TARGETS", 20)
    rng = random.Random(4)
    pairs = {(f"e{rng.randrange(25)}", f"c{rng.randrange(60)}") for _ in range(200)} | {("e90", "c90")}
    m = spark.createDataFrame([*pairs, *list(pairs)[:9]], "src string, dst string")
    seeds = spark.createDataFrame([(f"q{i}", f"e{rng.randrange(25)}") for i in range(4) for _ in range(2)] + [("q9", "e90"), ("q10", "e-alone")], "query_id string, id string")
    for rounds in (5,):
        want = {(r.query_id, r.id): r.score for r in graph.pagerank_between(m, seeds, 0.85, rounds).collect() if r.id.startswith("e")}
        got, tables, last = {}, 0, None
        for table in graph.pagerank_left(m, seeds, 0.85, rounds):
            if last is not None:
                discard(last)  # as recall does: nothing later reads it
            rows = table.collect()
            assert len({r.query_id for r in rows}) <= 3
            got |= {(r.query_id, r.id): r.score for r in rows}
            tables, last = tables + 1, table
        assert tables == 2 and got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_a_walk_leaves_its_scores_alone(spark):
    """g3_pagerank."""
    here = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: {p.name for p in here.glob(f"{PREFIX}*")}
    m = spark.createDataFrame([("e1", "c1"), ("e1", "c2"), ("e2", "c2"), ("e3", "c3")], "src string, dst string")
    seeds = spark.createDataFrame([("q", "e1"), ("r", "e2")], "query_id string, id string")
    before = held()
    out = graph.pagerank_between(m, seeds, 0.85, 6)
    assert len(held() - before) == 4  # the scores of either side, the queries, and their numbers
    got = {(r.query_id, r.id): r.score for r in out.collect()}
    want = {(r.query_id, r.id): r.score for r in graph.pagerank(graph.semantic_graph(m), seeds, 0.85, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
