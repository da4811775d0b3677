"""Streamed digests and typed subgraphs."""

import hashlib
import random

from pyspark.sql import functions as F

from factlog.functions.values import membership_hash
from factlog.operators import graph, promote


def test_streamed_digests_equal_those_of_a_list(spark):
    rng = random.Random(2)
    rows = [(lv, c, f"entry:{rng.randint(0, 500)}é") for lv in (0, 1) for c in range(30) for _ in range(rng.randint(1, 40))] + [(0, 99, None), (0, 1, "")]
    m = spark.createDataFrame(rows, "level int, community long, id string").repartition(5)
    want = {(r.level, r.community): r.hash for r in m.where("id IS NOT NULL").groupBy("level", "community").agg(membership_hash(F.collect_list("id")).alias("hash")).collect()}
    assert {(r.level, r.community): r.hash for r in graph.fingerprints(m).collect()} == want
    names = m.select(F.concat(F.lit("c"), "community").alias("community"), "id").where("community <> 'c99'")
    assert promote.community_hashes(names).count() == 30 and graph.fingerprints(m.where("false")).count() == 0


def test_a_community_of_many_batches(spark):
    n = 60_000
    m = spark.range(n).select(F.lit(0).alias("level"), F.when(F.col("id") < n - 1, "big").otherwise("small").alias("community"), F.format_string("entry:%08d", "id").alias("id"))
    got = {r.community: r.hash for r in graph.fingerprints(m).collect()}
    assert got == {"big": hashlib.sha256("".join(f"\0entry:{i:08d}" for i in range(n - 1)).encode()).hexdigest(), "small": hashlib.sha256(f"\0entry:{n - 1:08d}".encode()).hexdigest()}


def test_reach_gives_each_typed_edge_once(spark):
    rng = random.Random(5)
    edges = {(f"n{rng.randrange(30)}", rng.choice("XY"), f"n{rng.randrange(30)}") for _ in range(60)}
    e = spark.createDataFrame(sorted(edges) * 2, "src string, rel string, dst string")
    for direction in ("undirected", "natural"):
        for depth in (0, 1, 3):
            near, frontier = {"n0": 0}, {"n0"}
            for k in range(1, depth):
                frontier = {b for s, _, t in edges for a, b in ([(s, t)] if direction == "natural" else [(s, t), (t, s)]) if a in frontier} - set(near)
                near |= {x: k for x in frontier}
            ends = lambda s, t: [near[x] for x in ([s] if direction == "natural" else [s, t]) if x in near]  # noqa: E731, B023
            want = {(s, r, t, min(ends(s, t)) + 1) for s, r, t in edges if ends(s, t) and depth > 0}
            start = spark.createDataFrame([("n0",)], "id string")
            found = graph.reach(e, start, depth, direction).collect()
            assert len(found) == len(want) and {tuple(r) for r in found} == want, (direction, depth)
