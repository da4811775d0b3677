"""Graph operators: co-mention graph, personalized PageRank, communities and their cohesion, traversal and paths."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.operators.components import connected_components
from factlog.session import cut, discard, partitions, written


def semantic_graph(edges: DataFrame, direction: str = "undirected") -> DataFrame:
    """G1: all relationships as `(src, dst)`, in their own direction or both ways."""
    e = edges.select("src", "dst")
    return (e if direction == "natural" else e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end, repeats included: for walks, to which they make no difference."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def comentions(mentions: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """`(a, b, weight)`, a < b: entries that share concepts of degree least..most, and how many. The cap on the degree is
    the operator's definition; it bounds the pairs of a concept."""
    m = written(mentions.select("src", "dst").distinct())
    kept = m.groupBy("dst").agg(F.count("*").alias("d")).where(F.col("d").between(least, most))
    kept = written(kept)
    members = m.join(kept.select("dst"), "dst").groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("all"))  # `most` at most
    # an entry is sent once with the later ones of a concept; its pairs are made and counted where it arrives
    rows = members.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.slice("all", F.col("i") + 2, most).alias("later")).where(F.size("later") > 0)
    pairs = kept.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0))).first()[0]
    width = max(partitions(m.sparkSession), min(int(pairs // 2_000_000), 20_000))
    return rows.repartition(width, "a").select("a", F.explode("later").alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))


BLOCK = 128  # queries whose scores stand side by side in one matrix
CELL = 250_000  # edges that a group of a round holds


def _numbered(edges: DataFrame, seeds: DataFrame, parts: int) -> DataFrame:
    """`(id, part, local)`: the nodes, those of seeds alone included, dealt into parts by a hash and counted inside each."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(seeds.select("id")).distinct().repartition(parts, "id")
    number = F.monotonically_increasing_id()  # of a partition: its number, then 33 bits of a count
    return written(ids.withColumn("n", number)).select("id", F.shiftright("n", 33).cast("int").alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).cast("int").alias("local"))


def _cells(edges: DataFrame, nodes: DataFrame, damping: float) -> tuple[DataFrame, list[int]]:
    """The edges `(part, salt, src, dst, w)`, packed and sorted by their target, and over how many salts the edges of each part are dealt: a part's scores go
    to all of its salts, so a hub's edges are many groups."""
    degree = edges.groupBy("src").agg(F.count("*").alias("n"))
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("part").alias(end + "_part"), F.col("local").alias(end + "_local"))
    e = edges.join(degree, "src").join(at("src"), "src").join(at("dst"), "dst")
    e = written(e.select(F.col("src_part").alias("part"), F.col("src_local").alias("src"), (F.shiftleft(F.col("dst_part").cast("long"), 32) + F.col("dst_local")).alias("dst"), (F.lit(damping) / F.col("n")).alias("w")))
    load = {r["part"]: r["n"] for r in e.groupBy("part").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n")).collect()}  # a row for CELL edges or less
    salts = [load.get(i, 1) for i in range(max(load, default=0) + 1)]
    dealt = e.withColumn("salt", F.pmod(F.xxhash64("dst"), F.element_at(F.lit(salts), F.col("part") + 1)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, salt, src, dst, w = (batch.column(c).to_numpy() for c in ("part", "salt", "src", "dst", "w"))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (salt[1:] != salt[:-1])) + 1
            for x, y in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if y > x:
                    yield pa.RecordBatch.from_pydict({"part": part[x : x + 1], "salt": salt[x : x + 1], "src": [src[x:y].tobytes()], "dst": [dst[x:y].tobytes()], "w": [w[x:y].tobytes()]})

    packed = dealt.repartition("part", "salt").sortWithinPartitions("part", "salt", "dst").mapInArrow(pack, "part int, salt int, src binary, dst binary, w binary")
    return written(packed), salts


def _sent(targets: np.ndarray, x: np.ndarray, salts: list[int]) -> pa.Table:
    """Rows `(part, salt, ids, x)` that take sums to the parts of their nodes. targets: sorted, part and number."""
    rows = []
    part = targets >> 32
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
        if b > a:
            ids, raw, p = (targets[a:b] & 0xFFFFFFFF).astype(np.int32).tobytes(), x[a:b].tobytes(), int(part[a])
            rows += [(p, salt, ids, raw) for salt in range(salts[p] if p < len(salts) else 1)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({"part": pa.array(columns[0], pa.int32()), "salt": pa.array(columns[1], pa.int32()), "ids": pa.array(columns[2], pa.binary()), "x": pa.array(columns[3], pa.binary())})


def _scores(sums: pa.Table, slots: int, nodes: int = 0) -> np.ndarray:
    """The scores of a part's nodes, from what was sent to it."""
    ids, xs = sums.column("ids").to_pylist(), sums.column("x").to_pylist()
    ids = [np.frombuffer(i, np.int32) for i in ids]
    out = np.zeros((max(nodes, *(int(i.max()) + 1 for i in ids), 0) if ids else nodes, slots))
    for i, x in zip(ids, xs, strict=True):
        out[i] += np.frombuffer(x).reshape(-1, slots)  # a row names a node once
    return out


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 5) -> DataFrame:
    """`(query_id, id, score)` of all queries' seeds `(query_id, id)` at once: s = (1 - d) [seed] + d * sum(s_u / outdegree_u).

    Nodes are dealt into parts, and a round is one shuffle: the edges of each part stay where they are, the sums of the last round come to them, and what
    leaves a part is summed by target before it is sent. Scores of BLOCK queries are a row of a matrix, so an edge is read once a round for all
    of them. A part with many edges is dealt over several groups, which all get its scores. Tables are written every few rounds.
    Nodes that no seed reaches have no row.
    """
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst"))
    parts = max(partitions(spark), -(-edges.count() // CELL))
    nodes = _numbered(edges, seeds, parts)
    cells, salts = _cells(edges, nodes, damping)
    cells = cells.repartition(max(partitions(spark), min(sum(salts), 20_000)), "part", "salt").persist()
    out = spark.createDataFrame([], seeds.select("query_id", "id").schema.add("score", "double"))
    for mine, slots in _blocks(seeds):
        s = _walk(cells, salts, nodes, seeds.join(mine, "query_id").select("id", "slot").distinct(), slots, damping, rounds, every)
        found = s.join(mine, "slot").join(nodes, ["part", "local"]).select("query_id", "id", "score")
        out = out.union(written(found))
    cells.unpersist()
    return out


def _blocks(seeds: DataFrame, size: int = BLOCK) -> Iterator[tuple[DataFrame, int]]:
    """The queries of the seeds as blocks `(query_id, slot)` of `size` at most, and how many slots a block has."""
    queries = written(seeds.select("query_id").distinct())
    n = queries.count()
    queries = written(queries.repartition(1 + n // 100_000).withColumn("number", F.monotonically_increasing_id()))
    # queries in the order of their numbers, `size` at a time; numbers of a partition follow each other
    queries = queries.select("query_id", F.floor(F.pmod("number", F.lit(1 << 33)) / size).alias("low"), F.shiftright("number", 33).alias("high"), F.pmod(F.pmod("number", F.lit(1 << 33)), F.lit(size)).cast("int").alias("slot"))
    for high, low in sorted((r["high"], r["low"]) for r in queries.select("high", "low").distinct().collect()):  # a row for `size` queries
        yield queries.where((F.col("high") == high) & (F.col("low") == low)).select("query_id", "slot"), min(size, n)


def _walk(cells: DataFrame, salts: list[int], nodes: DataFrame, seeds: DataFrame, slots: int, damping: float, rounds: int, every: int) -> DataFrame:
    """`(part, local, slot, score)` after the rounds from seeds `(id, slot)`."""
    kind = "part int, salt int, ids binary, x binary"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column("part").to_numpy().astype(np.int64) << 32 | batch.column("local").to_numpy()
            order = np.argsort(where, kind="stable")
            some, first = np.unique(where[order], return_index=True)
            x = np.zeros((len(some), slots))
            x[np.searchsorted(some, where), batch.column("slot").to_numpy()] = 1 - damping
            yield from _sent(some, x, salts).to_batches()

    start = written(seeds.join(nodes, "id").select("part", "local", "slot").mapInArrow(begin, kind))

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _sent(np.zeros(0, np.int64), np.zeros((0, slots)), salts)
        src, dst, w = (np.frombuffer(b"".join(left.column(c).to_pylist()), t) for c, t in (("src", np.int32), ("dst", np.int64), ("w", np.float64)))
        scores = _scores(right, slots, int(src.max()) + 1)
        live = scores.any(axis=1)[src]
        src, dst, w = src[live], dst[live], w[live]
        order = np.argsort(dst, kind="stable")
        src, dst, w = src[order], dst[order], w[order]
        runs = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
        x = np.zeros((len(runs), slots))
        ends = np.append(runs[1:], len(dst))
        a = 0
        while a < len(runs):  # as many targets as make some 4 million numbers, at least one
            b = max(a + 1, int(np.searchsorted(ends, runs[a] + 4_000_000 // slots)))
            at = slice(runs[a], ends[b - 1])
            x[a:b] = np.add.reduceat(scores[src[at]] * w[at, None], runs[a:b] - runs[a])
            a = b
        return _sent(dst[runs], x, salts)

    s = start
    for k in range(rounds):
        moved = cells.groupBy("part", "salt").cogroup(s.groupBy("part", "salt")).applyInArrow(step, kind)
        s = moved.union(start)
        if k % every == every - 1 or k == rounds - 1:
            s = written(s)

    def end(held: pa.Table) -> pa.Table:
        scores = _scores(held, slots)
        local, slot = np.nonzero(scores > 0)
        return pa.table({"part": pa.array(np.full(len(local), held.column("part")[0].as_py(), np.int32)), "local": pa.array(local.astype(np.int32)), "slot": pa.array(slot.astype(np.int32)), "score": pa.array(scores[local, slot])})

    return s.where("salt = 0").groupBy("part").applyInArrow(end, "part int, local int, slot int, score double")


def _dealt(ids: DataFrame, parts: int) -> DataFrame:
    """`(id, part, local)` and the other columns of `ids`: the nodes dealt into parts by a hash and counted inside each."""
    at = F.monotonically_increasing_id()  # of a partition: its number, then 33 bits of a count
    rest = [c for c in ids.columns if c != "id"]
    return written(ids.repartition(parts, "id").withColumn("at", at)).select("id", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).cast("int").alias("local"), *rest)


def _runs(schema: str, key: list[str], packed: list[str]):
    """A function on batches that are sorted by the key: each run of a key becomes one row, the other columns as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in key + packed}
            n = batch.num_rows
            turns = np.zeros(max(n - 1, 0), bool)
            for c in key:
                turns |= columns[c][1:] != columns[c][:-1]
            cuts = np.flatnonzero(turns) + 1
            spans = [(x, y) for x, y in zip([0, *cuts], [*cuts, n], strict=True) if y > x]
            yield pa.RecordBatch.from_pydict({**{c: pa.array([columns[c][x] for x, _ in spans], pa.int32()) for c in key}, **{c: pa.array([columns[c][x:y].tobytes() for x, y in spans], pa.binary()) for c in packed}})

    return lambda df: df.mapInArrow(run, schema)


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _weighed(target: np.ndarray, source: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct targets, ascending, and for each the sum of w * x[source]."""
    order = np.argsort(target, kind="stable")
    target, source, w = target[order], source[order], w[order]
    runs = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    ends, out, a = np.append(runs[1:], len(target)), np.zeros((len(runs), x.shape[1])), 0
    while a < len(runs):  # as many targets as make some 4 million numbers, at least one
        b = max(a + 1, int(np.searchsorted(ends, runs[a] + 4_000_000 // x.shape[1])))
        at = slice(runs[a], ends[b - 1])
        out[a:b] = np.add.reduceat(x[source[at]] * w[at, None], runs[a:b] - runs[a])
        a = b
    return target[runs], out


def _added(target: np.ndarray, source: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """For every target below n the sum of x[source], a column at a time."""
    out = np.empty((n, x.shape[1]))
    for i in range(x.shape[1]):
        out[:, i] = np.bincount(target, np.ascontiguousarray(x[:, i])[source], n)
    return out


PAIRS = 500_000  # pairs that a part of the left side holds
FEWEST = 2  # queries that a walk of `pagerank_between` takes at least


def pagerank_between(pairs: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 1) -> DataFrame:
    """`pagerank` of the undirected graph of pairs `(src, dst)`, from seeds among the src: the same rows with a part of the bytes moved.

    If no node stands on both sides, a round changes one side only: the scores of the right from those of the left, or the other way. All pairs of a left
    node are in its part, so its score is made and used in one task and never sent. What moves is, once for two rounds, a sum for each right
    node and part that has it, and that node's score back. A walk takes as many queries as move twice as many numbers as there are pairs, FEWEST at least, and tables go once they are read. Where a node stands on both sides, a seed stands on the right, or one part would hold too much, `pagerank` does it.
    """
    spark = pairs.sparkSession
    pairs = written(pairs.select("src", "dst").distinct())
    total = pairs.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PAIRS))
    left = pairs.select(F.col("src").alias("id"), F.lit(1).alias("one")).union(seeds.select("id", F.lit(0))).groupBy("id").agg(F.sum("one").alias("n"))
    left = _dealt(left, parts)
    right = _dealt(pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), parts)
    load = left.groupBy("part").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if load > 8 * PAIRS or not left.join(right, "id", "left_semi").isEmpty():
        return pagerank(semantic_graph(pairs), seeds, damping, rounds)
    e = pairs.join(left.select(F.col("id").alias("src"), "part", "local", (damping / F.nullif("n", F.lit(0))).alias("w")), "src")
    e = e.join(right.select(F.col("id").alias("dst"), (F.shiftleft(F.col("part").cast("long"), 32) + F.col("local")).alias("to"), (damping / F.col("n")).alias("back")), "dst")
    e = written(e.select("part", "local", "to", "w", "back"))
    discard(pairs)
    width = max(partitions(spark), parts)
    cells = _runs("part int, local binary, to binary, w binary, back binary", ["part"], ["local", "to", "w", "back"])(e.repartition(parts, "part").sortWithinPartitions("part", "to"))
    cells_file = written(cells)
    cells = cells_file.repartition(width, "part").persist()
    homes = e.select(F.shiftright("to", 32).cast("int").alias("part"), F.col("part").alias("reader"), F.col("to").bitwiseAND((1 << 32) - 1).cast("int").alias("ids")).distinct()
    homes = _runs("part int, reader int, ids binary", ["part", "reader"], ["ids"])(homes.repartition(parts, "part").sortWithinPartitions("part", "reader", "ids"))
    homes_file = written(homes)
    discard(e)
    entries = homes_file.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 4
    homes = homes_file.repartition(width, "part").persist()
    out = spark.createDataFrame([], seeds.select("query_id", "id").schema.add("score", "double"))
    for mine, slots in _blocks(seeds, max(FEWEST, min(BLOCK, 2 * total // max(entries, 1)))):
        some = written(seeds.join(mine, "query_id").join(left, "id").select("part", "local", "slot").distinct())
        a, b, used = _swing(cells, homes, some, slots, damping, rounds, every)
        for scores, nodes in ((a, left), (b, right)):
            out = out.union(written(scores.join(mine, "slot").join(nodes.select("part", "local", "id"), ["part", "local"]).select("query_id", "id", "score")))
        discard(some, *used)
    cells.unpersist()
    homes.unpersist()
    discard(cells_file, homes_file, left, right)
    return out


def _swing(cells: DataFrame, homes: DataFrame, seeds: DataFrame, slots: int, damping: float, rounds: int, every: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """`(part, local, slot, score)` of both sides after the rounds from seeds `(part, local, slot)` of the left; and the tables that they read."""
    sums, found = "part int, ids binary, x binary", "part int, local int, slot int, score double"
    begin = seeds.select("part", F.col("local").alias("ids"), "slot")
    none = F.lit(None).cast("binary")
    start = _runs("part int, ids binary, slot binary", ["part"], ["ids", "slot"])(begin.sortWithinPartitions("part")).select("part", "ids", "slot", none.alias("x"))

    def scored(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, ...]:
        """The left scores of a part, and its pairs."""
        local, to, w, back = (_joined(left, c, k) for c, k in (("local", np.int32), ("to", np.int64), ("w", float), ("back", float)))
        said = np.array(right.column("x").is_null()) if right.num_rows else np.zeros(0, bool)
        seeded, told = right.filter(pa.array(said)), right.filter(pa.array(~said))
        ids, slot = _joined(seeded, "ids", np.int32), _joined(seeded, "slot", np.int32)
        a = np.zeros((max([0, *(int(x.max()) + 1 for x in (local, ids) if len(x))]), slots))
        keys, x = _joined(told, "ids", np.int64), _joined(told, "x", float).reshape(-1, slots)
        if len(keys):
            order = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys, to, sorter=order), len(keys) - 1)
            hit = keys[order[at]] == to
            some, total = _weighed(local[hit], order[at[hit]], back[hit], x)
            a[some] = total
        a[ids, slot] += 1 - damping
        return a, local, to, w

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        a, local, to, w = scored(left, right)
        live = a.any(axis=1)[local] if len(local) else np.zeros(0, bool)
        some, x = _weighed(to[live], local[live], w[live], a if len(a) else np.zeros((1, slots)))
        home = some >> 32
        cuts = np.flatnonzero(home[1:] != home[:-1]) + 1
        spans = [(p, q) for p, q in zip([0, *cuts], [*cuts, len(some)], strict=True) if q > p]
        return pa.table({"part": pa.array([int(home[p]) for p, _ in spans], pa.int32()), "ids": pa.array([(some[p:q] & 0xFFFFFFFF).astype(np.int32).tobytes() for p, q in spans], pa.binary()), "x": pa.array([x[p:q].tobytes() for p, q in spans], pa.binary())})

    def summed(held: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, x = _joined(held, "ids", np.int32), _joined(held, "x", float).reshape(-1, slots)
        return _weighed(ids, np.arange(len(ids)), np.ones(len(ids)), x)

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        some, x = summed(right)
        rows = []
        for part, reader, raw in zip(*(left.column(c).to_pylist() for c in ("part", "reader", "ids")), strict=True):
            want = np.frombuffer(raw, np.int32)
            at = np.minimum(np.searchsorted(some, want), max(len(some) - 1, 0))
            hit = some[at] == want if len(some) else np.zeros(len(want), bool)
            if hit.any():
                rows.append((reader, (want[hit] + (np.int64(part) << 32)).tobytes(), x[at[hit]].tobytes()))
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate((("part", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())))})

    def listed(part: int, local: np.ndarray, x: np.ndarray) -> pa.Table:
        at, slot = np.nonzero(x > 0)
        return pa.table({"part": pa.array(np.full(len(at), part, np.int32)), "local": pa.array(local[at].astype(np.int32)), "slot": pa.array(slot.astype(np.int32)), "score": pa.array(x[at, slot])})

    def end_left(left: pa.Table, right: pa.Table) -> pa.Table:
        a, *_ = scored(left, right)
        return listed((left if left.num_rows else right).column("part")[0].as_py(), np.arange(len(a)), a)

    def end_right(held: pa.Table) -> pa.Table:
        return listed(held.column("part")[0].as_py(), *summed(held))

    start = written(start)
    last, sent, partial, made = None, None, None, [start]
    heard = lambda told: start if told is None else start.union(told.select("part", "ids", none.alias("slot"), "x"))
    for k in range(1, rounds + 1, 2):
        partial = cells.groupBy("part").cogroup(heard(sent).groupBy("part")).applyInArrow(gather, sums)
        if k + 2 > rounds or (k // 2) % every == every - 1:
            partial = written(partial)
            made.append(partial)
            if len(made) > 3:  # the last two are read at the end
                discard(made.pop(1))
        last, sent = sent, homes.groupBy("part").cogroup(partial.groupBy("part")).applyInArrow(spread, sums)
    a = cells.groupBy("part").cogroup(heard(last if rounds % 2 else sent).groupBy("part")).applyInArrow(end_left, found)
    b = a.where("false") if partial is None else partial.groupBy("part").applyInArrow(end_right, found)
    return a, b, made


TARGETS = 2_000_000  # pairs that a part of the right side holds
LEAST = 16  # queries that a walk of `pagerank_left` takes at least


def pagerank_left(pairs: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20) -> Iterator[DataFrame]:
    """The rows of `pagerank_between` for the src alone, a table for some of the queries at a time: whoever reads one may `discard` it before the next, so disk holds no more than one.

    For few src with many dst each. All pairs of a dst are in its part, so its score is made and used in one task and never sent; what moves is, once for two rounds,
    a sum for each src and part that has it, and that src's score back. A walk takes as many queries as make these no more numbers than there are pairs (LEAST and BLOCK are the bounds).
    Nothing is yielded for src without a path from a seed; where a node stands on both sides, or a seed on the right, use `pagerank_between`.
    """
    spark = pairs.sparkSession
    pairs = written(pairs.select("src", "dst").distinct())
    total = pairs.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TARGETS))
    left = _dealt(pairs.select(F.col("src").alias("id")).union(seeds.select("id")).distinct(), parts)
    right = _dealt(pairs.select(F.col("dst").alias("id")).distinct(), parts)
    e = pairs.join(left.select(F.col("id").alias("src"), (F.shiftleft(F.col("part").cast("long"), 32) + F.col("local")).alias("u")), "src")
    e = e.join(right.select(F.col("id").alias("dst"), "part", F.col("local").alias("t")), "dst").select("part", "u", "t")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, u, t = (batch.column(c).to_numpy() for c in ("part", "u", "t"))
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for x, y in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if y > x:
                    some, n = np.unique(u[x:y], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"part": part[x : x + 1], "u": [some.tobytes()], "n": [n.astype(np.int32).tobytes()], "t": [t[x:y].tobytes()]})

    cells = written(e.repartition(parts, "part").sortWithinPartitions("part", "u").mapInArrow(pack, "part int, u binary, n binary, t binary"))
    discard(pairs, right)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, count in zip(*(batch.column(c).to_pylist() for c in ("part", "u", "n")), strict=True):
                u, n = np.frombuffer(raw, np.int64), np.frombuffer(count, np.int32)
                yield pa.RecordBatch.from_pydict({"part": pa.array((u >> 32).astype(np.int32)), "reader": pa.array(np.full(len(u), part, np.int32)), "ids": pa.array((u & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n)})

    homes = cells.mapInArrow(held, "part int, reader int, ids int, n int").groupBy("part", "reader", "ids").agg(F.sum("n").cast("int").alias("n"))
    homes = written(homes)
    entries = homes.count()
    packed = _runs("part int, reader int, ids binary, n binary", ["part", "reader"], ["ids", "n"])(homes.repartition(parts, "part").sortWithinPartitions("part", "reader", "ids"))
    packed = written(packed)
    discard(homes)
    width = max(partitions(spark), parts)
    kept = [df.repartition(width, "part").persist() for df in (cells, packed)]
    for mine, slots in _blocks(seeds, max(LEAST, min(BLOCK, total // max(entries, 1)))):
        some = written(seeds.join(mine, "query_id").join(left, "id").select("part", "local", "slot").distinct())
        scores = _sway(*kept, some, slots, damping, rounds // 2)
        yield written(scores.join(mine, "slot").join(left, ["part", "local"]).select("query_id", "id", "score"))
        discard(some)
    for df in kept:
        df.unpersist()
    discard(cells, packed, left)


def _sway(cells: DataFrame, homes: DataFrame, seeds: DataFrame, slots: int, damping: float, steps: int) -> DataFrame:
    """`(part, local, slot, score)` of the left side after twice so many rounds from seeds `(part, local, slot)`."""
    sums, none = "part int, ids binary, x binary", F.lit(None).cast("binary")
    start = _runs("part int, ids binary, slot binary", ["part"], ["ids", "slot"])(seeds.select("part", F.col("local").alias("ids"), "slot").sortWithinPartitions("part"))
    start = written(start.select("part", "ids", "slot", none.alias("x")))

    def scored(told: pa.Table, size: int = 0) -> np.ndarray:
        """The scores of a part's left nodes."""
        said = np.array(told.column("x").is_null()) if told.num_rows else np.zeros(0, bool)
        seeded, heard = told.filter(pa.array(said)), told.filter(pa.array(~said))
        ids, slot = _joined(seeded, "ids", np.int32), _joined(seeded, "slot", np.int32)
        a = np.zeros((max([size, *(int(x.max()) + 1 for x in (ids, _joined(heard, "ids", np.int32)) if len(x))]), slots))
        for raw, x in zip(heard.column("ids").to_pylist(), heard.column("x").to_pylist(), strict=True):
            a[np.frombuffer(raw, np.int32)] += np.frombuffer(x).reshape(-1, slots)  # a row names a node once
        a[ids, slot] += 1 - damping
        return a

    def spread(held: pa.Table, told: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, np.int32) for x in held.column("ids").to_pylist()]
        size = max((int(x.max()) + 1 for x in ids), default=0)
        degree = np.zeros(size)
        for x, n in zip(ids, held.column("n").to_pylist(), strict=True):
            degree[x] += np.frombuffer(n, np.int32)
        a = scored(told, size)[:size] * (damping / np.maximum(degree, 1))[:, None]
        live, rows = a.any(axis=1), []
        for part, reader, x in zip(held.column("part").to_pylist(), held.column("reader").to_pylist(), ids, strict=True):
            x = x[live[x]]
            if len(x):
                rows.append((reader, (x + (np.int64(part) << 32)).tobytes(), a[x].tobytes()))
        return pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate((("part", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())))})

    def step(held: pa.Table, told: pa.Table) -> pa.Table:
        u, n, t = (_joined(held, c, k) for c, k in (("u", np.int64), ("n", np.int32), ("t", np.int32)))
        keys, x = _joined(told, "ids", np.int64), _joined(told, "x", float).reshape(-1, slots)
        home = np.zeros(0, np.int64)
        if len(keys) and len(u):
            order = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys, u, sorter=order), len(keys) - 1)
            hit = np.repeat(keys[order[at]] == u, n)
            degree = np.bincount(t)
            r = _added(t[hit], np.repeat(order[at], n)[hit], x, len(degree)) * (damping / np.maximum(degree, 1))[:, None]
            u, place = np.unique(u, return_inverse=True)
            y = _added(np.repeat(place, n), t, r, len(u))
            live = y.any(axis=1)
            u, y = u[live], y[live]
            home = u >> 32
        cuts = np.flatnonzero(home[1:] != home[:-1]) + 1
        spans = [(p, q) for p, q in zip([0, *cuts], [*cuts, len(home)], strict=True) if q > p]
        return pa.table({"part": pa.array([int(home[p]) for p, _ in spans], pa.int32()), "ids": pa.array([(u[p:q] & 0xFFFFFFFF).astype(np.int32).tobytes() for p, q in spans], pa.binary()), "x": pa.array([y[p:q].tobytes() for p, q in spans], pa.binary())})

    def end(told: pa.Table) -> pa.Table:
        a = scored(told)
        local, slot = np.nonzero(a > 0)
        return pa.table({"part": pa.array(np.full(len(local), told.column("part")[0].as_py(), np.int32)), "local": pa.array(local.astype(np.int32)), "slot": pa.array(slot.astype(np.int32)), "score": pa.array(a[local, slot])})

    said, last = start, None
    for _ in range(steps):
        sent = homes.groupBy("part").cogroup(said.groupBy("part")).applyInArrow(spread, sums)
        now = written(cells.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(step, sums))
        if last is not None:
            discard(last)
        last, said = now, start.union(now.select("part", "ids", none.alias("slot"), "x"))
    return said.groupBy("part").applyInArrow(end, "part int, local int, slot int, score double")


def modularity(edges: DataFrame, members: DataFrame, gamma: float = 1.0) -> DataFrame:
    """The modularity of a partition `(id, community)` of an undirected weighted graph `(a, b, weight)`."""
    m = edges.join(members.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    total = edges.agg(F.sum("weight").alias("m"))
    inside = m.agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight"))), F.lit(0)).alias("inside"))
    ends = m.select(F.col("ca").alias("c"), "weight").union(m.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.crossJoin(inside).crossJoin(ends).select((F.col("inside") / F.col("m") - gamma * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def connected_parts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Split every community into its connected parts; a part's name is its smallest member."""
    m = members.select("id", "community")
    inside = edges.join(m.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("ca = cb")
    parts = connected_components(inside.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return m.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("community"))


def parse_resolutions(text: str) -> list[float]:
    """G14."""
    out = [float(x) for x in text.split(",") if x.strip()]
    if not out or any(x <= 0 for x in out):
        raise ValueError(f"bad resolutions {text!r}")
    return out


def resolutions(text="text"):
    """G14 for a column: `(values, error)`; blanks between commas don't count, every value must be a positive number."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    bad = (F.size(values) == 0) | F.exists(values, lambda x: x.isNull() | (x <= 0))
    return F.when(~bad, values), F.when(bad, "BAD_RESOLUTIONS")


def faults(edges: DataFrame, members: DataFrame, gammas: list[float]) -> DataFrame:
    """What a partition `(level, id, community)` of a graph must not have, by level: nodes without or with several communities (`strays`), and
    communities that are not connected (`broken`); and `gain`, its modularity at the level's gamma over that of single nodes."""
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    single = nodes.select("id", F.col("id").alias("community"))
    of = lambda end: members.select("level", F.col("id").alias(end), F.col("community").alias("c" + end))
    inside = edges.join(of("a"), "a").join(of("b"), ["level", "b"]).where("ca = cb")  # one run of the components for all levels
    parts = connected_components(inside.select(F.struct("level", F.col("a").alias("id")).alias("src"), F.struct("level", F.col("b").alias("id")).alias("dst")))
    parts = members.join(parts.select("id.level", "id.id", F.col("component.id").alias("part")), ["level", "id"], "left").withColumn("part", F.coalesce("part", "id"))
    parts = written(parts.groupBy("level", "community").agg(F.countDistinct("part").alias("parts")).groupBy("level").agg(F.count_if(F.col("parts") > 1).alias("broken")))
    out = None
    for level, gamma in enumerate(gammas):
        part = members.where(F.col("level") == level).select("id", "community")
        each = nodes.join(part.groupBy("id").agg(F.count("*").alias("n")), "id", "full").agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("strays"))
        apart = parts.where(F.col("level") == level).agg(F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))
        gain = modularity(edges, part, gamma).crossJoin(modularity(edges, single, gamma).withColumnRenamed("modularity", "least")).select((F.col("modularity") - F.col("least")).alias("gain"))
        row = each.crossJoin(apart).crossJoin(gain).select(F.lit(level).alias("level"), "*")
        out = row if out is None else out.union(row)
    return out


def group(members: DataFrame, top: int = 32) -> DataFrame:
    """`(level, community, size, top)`, members by id. The first `top` ids come from a rank, not from a collected group."""
    rank = F.row_number().over(Window.partitionBy("level", "community").orderBy("id"))
    first = members.withColumn("r", rank).where(F.col("r") <= top).groupBy("level", "community").agg(F.array_sort(F.collect_list("id")).alias("top"))
    return members.groupBy("level", "community").agg(F.count("*").alias("size")).join(first, ["level", "community"])


def persist(members: DataFrame, path: str) -> bool:
    """Write the hierarchy to a new folder under `path`, and only then let the pointer name it; a failed write leaves the old
    one in place, and so does an empty hierarchy. Returns whether the pointer moved."""
    if members.isEmpty():
        return False
    version = uuid.uuid4().hex
    members.write.parquet(f"{path}/{version}")
    members.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.parquet(f"{path}/pointer-{time.time_ns():020d}")
    return True


def persisted(spark: SparkSession, path: str) -> DataFrame:
    """The hierarchy that the newest pointer names."""
    pointers = spark.read.parquet(f"{path}/pointer-*").select("version", F.regexp_extract(F.input_file_name(), "pointer-([0-9]+)", 1).alias("at"))
    version = pointers.orderBy(F.desc("at")).first()["version"]
    return spark.read.parquet(f"{path}/{version}")


def cohesion(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """`(community, members, avg_cosine, mdl_ratio, vectors)`: the average pairwise cosine without any pair.

    With unit vectors, the sum over pairs is (|sum u|^2 - sum |u|^2) / 2, so a sum per dimension is enough.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    u = members.join(vectors, "id").withColumn("norm", norm)
    one = u.groupBy("community").agg(F.count("*").alias("n"), F.sum(F.when(F.col("norm") > 0, 1.0).otherwise(0.0)).alias("ones"))
    dims = u.where("norm > 0").select("community", "norm", F.posexplode("embedding").alias("d", "x")).groupBy("community", "d").agg(F.sum(F.col("x").cast("double") / F.col("norm")).alias("s"))
    sq = dims.groupBy("community").agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    size = members.groupBy("community").agg(F.count("*").alias("members"))
    df = size.join(one, "community", "left").join(sq, "community", "left")
    n = F.coalesce("n", F.lit(0))
    avg = F.when(n >= 2, F.least(F.greatest((F.coalesce("ss", F.lit(0.0)) - F.col("ones")) / (n * (n - 1)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    df = df.withColumn("avg_cosine", avg).withColumn("vectors", n)
    mdl = F.when(F.col("vectors") >= 2, F.greatest(F.lit(1.0), 1 + F.col("avg_cosine") * F.log(1.0 + F.col("members")))).otherwise(1.0)
    return df.select("community", "members", "avg_cosine", mdl.alias("mdl_ratio"), "vectors")


def listed(groups: DataFrame, level: int) -> DataFrame:
    """G10."""
    return groups.where((F.col("level") == level) & (F.col("size") >= 2)).orderBy("community")


def community_token(level="level", community="community"):
    """`L<level>:C<id>`."""
    return F.concat(F.lit("L"), F.col(level).cast("string"), F.lit(":C"), F.col(community).cast("string"))


def parse_token(token="token"):
    """(level, community id) of a token; null if it is none."""
    good = F.col(token).rlike(r"^L[0-9]+:C.+$")
    return F.when(good, F.regexp_extract(token, r"^L([0-9]+):C", 1).cast("int")), F.when(good, F.regexp_extract(token, r"^L[0-9]+:C(.+)$", 1))


def fingerprints(members: DataFrame) -> DataFrame:
    """G13 for every community `(level, community, hash)`: SHA-256 over its sorted ids, each after a NUL, repeats included.

    Ids are sorted by the cluster inside their community and fed to the digest one Arrow batch at a time: a task holds a digest's state and a batch, never a
    community's list. A digest can't be put together from parts, so a community is one task's stream; many communities are many tasks.
    """
    kind = members.schema["community"].dataType.simpleString()
    rows = members.select(F.col("level").cast("int").alias("level"), "community", F.col("id").cast("string").alias("id")).where("id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], types[0]), pa.array([digest.hexdigest()])], ["level", "community", "hash"])
        types: list = []
        for batch in batches:
            types[:] = [batch.schema.field("community").type]
            ids = batch.column("id").to_pylist()
            keys = list(zip(batch.column("level").to_pylist(), batch.column("community").to_pylist(), strict=True))
            at = 0
            for key, group in groupby(keys):
                n = sum(1 for _ in group)
                if key != now:
                    if now is not None:
                        yield row()
                    now, digest = key, hashlib.sha256()
                digest.update("".join(f"\0{x}" for x in ids[at : at + n]).encode())
                at += n
        if now is not None:
            yield row()

    return rows.repartition("level", "community").sortWithinPartitions("level", "community", "id").mapInArrow(run, f"level int, community {kind}, hash string")


def refresh(prior: DataFrame, now: DataFrame) -> DataFrame:
    """`(level, community, summary, stale)`: a community keeps its summary if its members are the same."""
    return now.join(prior.select("level", "community", F.col("hash").alias("old"), "summary"), ["level", "community"], "left").select("level", "community", F.when(F.col("hash") == F.col("old"), F.col("summary")).alias("summary"), (~F.coalesce(F.col("hash") == F.col("old"), F.lit(False))).alias("stale"))


def traverse(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """`(id, depth)`: nodes within `depth` steps of the starts, each at its least depth."""
    edges = written(edges.select("src", "dst"))  # made once, read in every step
    seen = written(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for k in range(1, depth + 1):  # what is written has a size, so a small frontier is broadcast and the edges are not shuffled
        frontier = written(frontier.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "undirected") -> DataFrame:
    """R15 with its edges: `(src, rel, dst, depth)`: the typed edges of which one end lies within depth - 1 steps of the starts, each once, in its own direction, at
    the step that first met it; both its ends are then within `depth` steps. edges: `(src, rel, dst)`."""
    typed = edges.select("src", "rel", "dst")
    seen = traverse(typed if direction == "natural" else both_ways(typed), starts, max(depth - 1, 0))
    at = lambda end: seen.select(F.col("id").alias(end), F.col("depth").alias(end + "_at"))
    met = typed.join(at("src"), "src", "left" if direction != "natural" else "inner")
    met = met.withColumn("dst_at", F.lit(None).cast("int")) if direction == "natural" else met.join(at("dst"), "dst", "left")
    first = F.least("src_at", "dst_at")  # nulls are skipped
    return met.select("src", "rel", "dst", (first + 1).alias("depth")).where((F.col("depth") <= depth) & F.col("depth").isNotNull()).distinct()


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 32) -> DataFrame:
    """`(step, id)` of a shortest path, empty if there is none; of several, each node's parent is the smallest."""
    spark = edges.sparkSession
    seen = cut(spark.createDataFrame([(start, None, 0)], "id string, parent string, depth int"))
    frontier, depth = seen, 0
    while depth < most and seen.where(F.col("id") == end).isEmpty() and not frontier.isEmpty():
        depth += 1
        found = frontier.select(F.col("id").alias("src")).join(edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
    seen = cut(seen)
    path = seen.where(F.col("id") == end).select("id", "parent", F.col("depth").alias("step"))
    last = path
    for _ in range(depth):
        last = last.select(F.col("parent").alias("id"), (F.col("step") - 1).alias("step")).join(seen.select("id", "parent"), "id").select("id", "parent", "step")
        path = path.union(last)
    return path.where("step >= 0").select("step", "id").orderBy("step")
