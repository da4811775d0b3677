"""What larger tables need: work on small files is spread, and wide steps are made once."""

import random

from pyspark.sql import functions as F

from factlog.functions import hooks
from factlog.operators import graph, recall, state
from factlog.plans import views
from factlog.session import spread, written

SF = "/root/testdata/sf0.001"


def test_small_files_are_worked_on_by_all_cores(spark):
    n = spark.sparkContext.defaultParallelism
    assert views.table(spark, SF, "part").rdd.getNumPartitions() < n == spread(views.table(spark, SF, "part")).rdd.getNumPartitions()
    assert views.facts(spark, SF).rdd.getNumPartitions() >= n and views.entries(spark, SF).rdd.getNumPartitions() >= n


def test_comentions_send_lists_and_join_no_pairs(spark):
    rng = random.Random(2)
    rows = {(f"e{rng.randrange(20)}", f"c{rng.randrange(12)}") for _ in range(90)}
    want: dict = {}
    for c in {c for _, c in rows}:
        held = sorted(e for e, x in rows if x == c)
        if 2 <= len(held) <= 6:
            for i, a in enumerate(held):
                for b in held[i + 1 :]:
                    want[a, b] = want.get((a, b), 0) + 1
    got = graph.comentions(spark.createDataFrame([*rows, *list(rows)[:9]], "src string, dst string"), 2, 6)
    assert {(r.a, r.b): r.weight for r in got.collect()} == want
    assert "later" in got._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_a_walk_shuffle_no_edges(spark):
    edges = written(spark.range(2000).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst"))
    seen = graph.traverse(graph.both_ways(edges.union(edges)), spark.createDataFrame([("n5",)], "id string"), 2)
    assert {(r.id, r.depth) for r in seen.collect()} == {("n5", 0), ("n4", 1), ("n6", 1), ("n3", 2), ("n7", 2)}
    typed = edges.where("src = 'n5' OR dst = 'n5'").withColumn("rel", F.lit("r"))
    assert graph.reach(typed.union(typed), spark.createDataFrame([("n5",)], "id string"), 1).count() == 2


def test_seeds_lags_and_frames(spark):
    wanted = spark.createDataFrame([("q", "c1"), ("q", "c1"), ("q", "c2")], "query_id string, dst string")
    m = spark.createDataFrame([("e1", "c1"), ("e1", "c1"), ("e1", "c2"), ("e2", "c2"), ("e3", "c9")], "src string, dst string")
    assert {tuple(r) for r in recall.resolve_seeds(wanted, m).collect()} == {("q", "e1", 2), ("q", "e2", 1)}
    facts = spark.createDataFrame([("1", "entry:a"), ("2", "entry:b"), ("2", "entry:b")], "tx string, e string")
    marks = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "target string, tx string")
    found = state.statistics(facts, marks, spark.createDataFrame([("f",)], "file string"))
    assert {tuple(r) for r in found.collect()} == {("entries", "2"), ("log_tx", "2"), ("quarantined", "1"), ("lag:x", "2"), ("lag:y", "0"), ("lag:z", "0")}
    told = hooks.summarize(spark.createDataFrame([("c", "1", "alpha beta"), ("c", "2", "beta")], "community string, id string, body string"))
    assert told.first()["summary"] == "beta alpha"
