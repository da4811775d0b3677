"""Ranked retrieval for a table of queries: seeds, candidates, the layered relevance gate, ranking, and the other modes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.functions.values import col, concepts, cosine
from factlog.operators import activation, graph
from factlog.session import discard, partitions, written

QUERY_BLOCK = 4096  # queries that a task holds at a time


@dataclass(frozen=True)
class Gate:
    """The gate's settings. `floor` is the old name of `strict`: set alone, it gives one floor and no other stage."""

    hard: float = 0.0
    strict: float = 0.0
    alpha: float = 0.0
    composite: float = 0.0
    sim_weight: float = 0.0
    ppr_weight: float = 0.0
    baseline_n: int = 0
    floor: float = 0.0

    def filled(self) -> Gate:
        alone = self.floor > 0 and not any((self.hard, self.strict, self.alpha, self.composite, self.sim_weight, self.ppr_weight, self.baseline_n))
        strict = self.strict or self.floor
        if alone:
            return replace(self, strict=strict, hard=strict)
        out = replace(self, strict=strict, sim_weight=self.sim_weight or 0.7, ppr_weight=self.ppr_weight or 0.3)
        return replace(out, hard=out.hard or 0.40, alpha=out.alpha or 0.15, composite=out.composite or 0.45, baseline_n=out.baseline_n or 25) if strict > 0 else out


DEFAULT_GATE = Gate(hard=0.40, strict=0.55, alpha=0.15, composite=0.45, sim_weight=0.7, ppr_weight=0.3, baseline_n=25)


def concept_lines(text="text") -> Column:
    """Concepts from a generator's lines: trimmed, bullets and numbering stripped, blanks dropped."""
    clean = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:[-*•]+|[0-9]+[.)])\s*", "")))
    return F.filter(clean, lambda x: x != "")


def query_concepts(queries: DataFrame) -> DataFrame:
    """R1 with the default extractor: `(query_id, dst)`, the concept tokens of the query's text."""
    return queries.select("query_id", F.explode(concepts("text")).alias("token")).select("query_id", F.concat(F.lit("concept:"), "token").alias("dst"))


def resolve_seeds(wanted: DataFrame, mentions: DataFrame, k: int = 5) -> DataFrame:
    """R2: for every query the k entries that share most of its concepts; ties by id."""
    wanted = written(wanted.distinct())
    asked = mentions.select("src", "dst").join(wanted.select("dst").distinct(), "dst", "left_semi")
    # by entry from here on: the counts of an entry are made where its mentions are
    asked = written(asked).repartition(partitions(mentions.sparkSession), "src").distinct()
    shared = wanted.join(asked, "dst").groupBy("query_id", F.col("src").alias("id")).agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "id"))
    return shared.withColumn("r", rank).where(F.col("r") <= k).select("query_id", "id", "shared")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, exclude_self: bool = False) -> DataFrame:
    """`(query_id, id, sim, rank)`: the k vectors of greatest cosine, optionally at or over a floor; ties by id.

    Exact, by matrix products over Arrow batches; each task keeps k rows a query, and these are ranked once more. Queries are dealt into
    blocks of QUERY_BLOCK. One block is broadcast to the vectors where they are; more meet the vectors group by group: each block with each
    part of the vectors, so no task holds more than a block and a batch. Vectors of other widths than the query's don't count, null and empty ones have no neighbours, a zero vector has cosine 0.
    """
    spark = queries.sparkSession
    plain = F.col("embedding").cast("array<double>").alias("embedding")
    q = queries.where("embedding IS NOT NULL AND size(embedding) > 0").select("query_id", plain)
    v = vectors.where("embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)").select(F.col("id").cast("string").alias("id"), plain)
    q = written(q)
    n = q.count()
    out = f"query_id {q.schema['query_id'].dataType.simpleString()}, id string, sim double"
    more = {"k": k, "floor": floor, "exclude_self": exclude_self}
    if n <= QUERY_BLOCK:
        table = q.toArrow()  # at most QUERY_BLOCK rows
        held = spark.sparkContext.broadcast((table.column("query_id").to_pylist(), matrices([table.column("embedding").combine_chunks()])))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = QueryBlock(*held.value, **more)
            for batch in batches:
                block.add(batch.column("id").to_pylist(), matrices([batch.column("embedding")]))
            yield from block.rows()

        pairs = v.repartition(partitions(spark), "id").mapInArrow(scan, out)
    else:
        blocks = -(-n // QUERY_BLOCK)
        parts = max(1, -(-partitions(spark) // blocks))  # every part of the vectors costs a copy of the queries
        side = q.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", F.lit(None).cast("string").alias("id"), "embedding")
        rest = v.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), "id", "embedding")
        width = max(partitions(spark), min(blocks * parts, 20_000))
        both = side.union(rest).repartition(width, "block", "part").sortWithinPartitions("block", "part", "id")  # a group's queries stand first

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, ids, held, block = None, [], [], None
            for batch in batches:
                at, part = batch.column("block").to_numpy(), batch.column("part").to_numpy()
                is_query = np.array(batch.column("id").is_null())
                cuts = np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1]) | (is_query[1:] != is_query[:-1])) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
                    if lo == hi:
                        continue
                    if (at[lo], part[lo]) != now:
                        if block:
                            yield from block.rows()
                        now, ids, held, block = (at[lo], part[lo]), [], [], None
                    if is_query[lo]:
                        ids += batch.column("query_id").slice(lo, hi - lo).to_pylist()
                        held.append(batch.column("embedding").slice(lo, hi - lo))
                    elif ids:
                        block = block or QueryBlock(ids, matrices(held), **more)
                        block.add(batch.column("id").slice(lo, hi - lo).to_pylist(), matrices([batch.column("embedding").slice(lo, hi - lo)]))
            if block:
                yield from block.rows()

        pairs = both.mapInArrow(meet, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "sim", "rank")


def matrices(lists: list[pa.ListArray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For every width: the rows that have it, counted over all arrays, and their unit vectors; a zero vector stays."""
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists])  # a null entry is NaN
    starts = np.cumsum(sizes) - sizes
    out = {}
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        x = flat[starts[rows][:, None] + np.arange(width)]
        norm = np.sqrt((x * x).sum(axis=1))
        out[int(width)] = rows, x / np.where(norm > 0, norm, 1.0)[:, None]
    return out


class QueryBlock:
    """The best k vectors of a block of queries so far."""

    def __init__(self, ids: list, vectors: dict[int, tuple[np.ndarray, np.ndarray]], k: int, floor: float | None, exclude_self: bool):
        self.ids, self.k, self.floor, self.widths = ids, k, floor, vectors
        self.own = {str(x): i for i, x in enumerate(ids)} if exclude_self else {}
        self.place = {w: {int(i): j for j, i in enumerate(mine)} for w, (mine, _) in vectors.items()} if exclude_self else {}
        self.best, self.waiting = [(np.zeros(0, int), np.zeros(0), np.zeros(0, object))], 0

    def add(self, ids: list[str], vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        names = np.array([*ids, None], object)[:-1]
        for width, (rows, units) in vectors.items():
            if width not in self.widths:
                continue
            mine, q = self.widths[width]
            order = np.argsort(names[rows], kind="stable")
            rows, units = rows[order], units[order]
            for lo in range(0, len(rows), step := max(1, 2_000_000 // len(mine))):
                some = names[rows[lo : lo + step]]
                sims = np.round(q @ units[lo : lo + step].T, 12)  # equal vectors have equal cosines
                if self.own:
                    for j, x in enumerate(some):
                        i = self.place[width].get(self.own.get(x, -1))
                        if i is not None:
                            sims[i, j] = -np.inf
                low = np.partition(sims, -self.k, axis=1)[:, -self.k][:, None] if len(some) > self.k else -np.inf
                good = (sims >= low) & (sims > -np.inf) & (sims >= (-np.inf if self.floor is None else self.floor))
                who, at = np.nonzero(good)
                first = np.lexsort((at, -sims[who, at], who))
                who, at = who[first], at[first]
                keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
                who, at = who[keep], at[keep]
                self.best.append((mine[who], sims[who, at], some[at]))
                self.waiting += len(who)
                if self.waiting > 2_000_000:
                    self.shrink()

    def shrink(self) -> None:
        who, sim, ids = (np.concatenate([b[c] for b in self.best]) for c in range(3))
        _, number = np.unique(ids.astype(str), return_inverse=True) if len(ids) else (None, np.zeros(0, int))
        order = np.lexsort((number, -sim, who))
        who, sim, ids = who[order], sim[order], ids[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < self.k
        self.best, self.waiting = [(who[keep], sim[keep], ids[keep])], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.shrink()
        who, sim, ids = self.best[0]
        if len(ids):
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([self.ids[i] for i in who]), "id": pa.array(ids.tolist(), pa.string()), "sim": pa.array(sim)})


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def index_quantile(values: DataFrame, q: float, range_rows: int = 100_000) -> DataFrame:
    """Per query the value at index int(q * n) of the ascending order, without interpolation. `(query_id, value, n)`."""
    n = values.groupBy("query_id").agg(F.count("*").alias("n"))
    at = n.select("query_id", F.array(F.least(F.floor(q * F.col("n")), F.col("n") - 1)).alias("at"))
    return value_at(values, at, range_rows).select("query_id", "value", "n")


def value_at(values: DataFrame, wanted: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """`(query_id, value, n, at)`: per query the values at some indices of the ascending order (from 0), given as arrays `(query_id, at)`.

    Queries of up to `range_rows` rows are ranked whole. Where there are larger ones, values are first counted by ranges (whose bounds are
    approximate quantiles of the query), and only ranges that hold an index are ranked: the bounds decide who is ranked, no result.
    """
    n = values.groupBy("query_id").agg(F.count("*").alias("n"))
    most = n.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    df = values.select("query_id", "value").join(n.join(wanted.select("query_id", F.array_distinct("at").alias("at")), "query_id"), "query_id")
    if most > range_rows:
        points = min(512, int(2 * most // range_rows))
        bounds = values.groupBy("query_id").agg(F.array_distinct(F.percentile_approx("value", [i / points for i in range(1, points)], 20 * points)).alias("bounds"))
        df = df.join(bounds, "query_id").withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.col("value")))).drop("bounds")
        counts = df.groupBy("query_id", "range").agg(F.count("*").alias("rows"), F.first("at").alias("at"))
        before = F.sum("rows").over(Window.partitionBy("query_id").orderBy("range")) - F.col("rows")
        inside = F.filter("at", lambda a: (a >= F.col("before")) & (a < F.col("before") + F.col("rows")))
        holds = counts.withColumn("before", before).withColumn("here", F.transform(inside, lambda a: a - F.col("before"))).where(F.size("here") > 0).select("query_id", "range", "before", "here")
        df = df.drop("at").join(holds, ["query_id", "range"]).withColumnRenamed("here", "at")
    else:
        df = df.withColumn("range", F.lit(0)).withColumn("before", F.lit(0).cast("long"))
    # equal values are one row of the ranking
    each = df.groupBy("query_id", "range", "value").agg(F.count("*").alias("rows"), F.first("at").alias("at"), F.first("n").alias("n"), F.first("before").alias("before"))
    low = F.sum("rows").over(Window.partitionBy("query_id", "range").orderBy("value")) - F.col("rows")
    hit = F.filter("at", lambda a: (a >= F.col("low")) & (a < F.col("low") + F.col("rows")))
    return each.withColumn("low", low).withColumn("at", hit).where(F.size("at") > 0).select("query_id", "value", "n", F.explode("at").alias("i"), "before").select("query_id", "value", "n", (F.col("before") + F.col("i")).alias("at"))


def gate_stage(sim, ppr, p75, n, gate: Gate) -> Column:
    """The stage at which a candidate is dropped (hard, rescue, composite), or null. p75, n: of all the query's PPR rows."""
    g = gate.filled()
    sim, ppr = col(sim), col(ppr)
    rescued = F.when((F.lit(g.baseline_n) > 0) & (col(n) >= g.baseline_n), ppr > col(p75)).otherwise(sim >= g.hard - g.alpha * ppr)
    out = F.when(sim < g.hard, "hard").when((sim < g.strict) & ~F.coalesce(rescued, F.lit(False)), "rescue")
    return out.when(g.sim_weight * sim + g.ppr_weight * ppr < g.composite, "composite") if g.composite > 0 else out


def diagnostics(gated: DataFrame) -> DataFrame:
    """How many candidates of each query went at each stage."""
    return gated.where("drop_stage IS NOT NULL").groupBy("query_id", "drop_stage").agg(F.count("*").alias("n"))


def why(base, ppr, sim, imp, weights=(0.3, 0.3, 0.3, 0.1)) -> Column:
    """Four lines that say what each term gave."""
    return F.array(*[F.format_string(f"{name}=%.4f (w=%.2f, contrib=%.4f)", col(c), F.lit(w), F.lit(w) * col(c)) for name, c, w in zip(("base", "ppr", "sim", "imp"), (base, ppr, sim, imp), weights, strict=True)])


def candidates(ppr: DataFrame, states: DataFrame, vectors: DataFrame, queries: DataFrame, include_retracted: bool = False) -> DataFrame:
    """The ranked entries with their state and similarity; ids without a state are dropped, a missing vector gives 0."""
    df = ppr.where("id LIKE 'entry:%'").join(states.withColumnRenamed("e", "id"), "id").join(vectors.select("id", "embedding"), "id", "left")
    if not include_retracted and "retracted" in states.columns:
        df = df.where("NOT retracted")
    q = queries.select("query_id", F.col("embedding").alias("qv"))
    return df.join(q, "query_id").withColumn("sim", F.coalesce(cosine("qv", "embedding"), F.lit(0.0))).drop("qv", "embedding")


def recall(queries: DataFrame, mentions: DataFrame, states: DataFrame, vectors: DataFrame, now: Column, gate: Gate = DEFAULT_GATE, limit: int = 10, seeds: int = 5, damping: float = 0.85, rounds: int = 20, threshold: float = 0.0005, direction: str = "undirected", weights=(0.3, 0.3, 0.3, 0.1), trails: DataFrame | None = None, communities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`(results, diagnostics)` for all queries `(query_id, text, embedding)` in one job. Blank queries are rejected.

    states: activation state per entity `e`, with `importance` (or none). The facts of A8 come from `activation.reinforce` on the
    results; the caller appends them.
    """
    queries = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    mentions = written(mentions.select("src", "dst"))  # read for the seeds and for both directions of the graph
    start = written(resolve_seeds(query_concepts(queries), mentions, seeds).select("query_id", "id"))
    entry = F.col("id").like("entry:%")
    imp = F.coalesce("importance", F.lit(0.0)) if "importance" in states.columns else F.lit(0.0)
    states = written(states.withColumn("base", activation.current(now)).withColumn("imp", imp).where(~F.col("evicted") & (F.col("base") >= threshold)))
    results, drops = None, None
    for ranked in _ranked(mentions, start, damping, rounds, direction, entry):  # a table for some of the queries: all their entries, so it goes before the next is made
        some = ranked.withColumnRenamed("score", "ppr")
        p75 = index_quantile(some.select("query_id", F.col("ppr").alias("value")), 0.75).select("query_id", F.col("value").alias("p75"), "n")
        gated = candidates(some, states, vectors, queries).join(p75, "query_id").withColumn("drop_stage", gate_stage("sim", "ppr", "p75", "n", gate))
        gated = written(gated)
        kept = gated.where("drop_stage IS NULL").withColumn("score", activation.composite("base", "ppr", "sim", "imp", weights))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        top = written(kept.withColumn("rank", rank).where(F.col("rank") <= limit).withColumn("why", why("base", "ppr", "sim", "imp", weights)))
        dropped = written(diagnostics(gated))
        discard(ranked, gated)
        results, drops = (top, dropped) if results is None else (results.union(top), drops.union(dropped))
    discard(mentions, start)
    return with_context(results, trails, communities), drops


def _ranked(mentions: DataFrame, start: DataFrame, damping: float, rounds: int, direction: str, entry: Column) -> Iterator[DataFrame]:
    """The scores `(query_id, id, score)` of entries, in written tables of some queries each; at least one table."""
    if direction != "undirected":
        yield written(graph.pagerank(graph.semantic_graph(mentions, direction), start, damping, rounds).where(entry))
        return
    right = mentions.select(F.col("dst").alias("id"))
    if not right.where(entry).isEmpty() or not start.join(right, "id", "left_semi").isEmpty() or not right.join(mentions.select(F.col("src").alias("id")), "id", "left_semi").isEmpty():
        yield written(graph.pagerank_between(mentions, start, damping, rounds).where(entry))
        return
    empty = True
    for scores in graph.pagerank_left(mentions, start, damping, rounds):
        empty = False
        yield scores
    if empty:
        yield written(start.where(entry).withColumn("score", F.lit(0.0)))


def with_context(results: DataFrame, trails: DataFrame | None, communities: DataFrame | None) -> DataFrame:
    """Trail and community summaries `(id, summary)` of the results alone; '' where there is none."""
    for name, side in (("trail_context", trails), ("community_context", communities)):
        results = results.withColumn(name, F.lit("")) if side is None else results.join(side.select("id", F.col("summary").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return results


def similar(queries: DataFrame, vectors: DataFrame, bodies: DataFrame, limit: int = 10) -> DataFrame:
    """The nearest entries alone; no graph, nothing reinforced."""
    return nearest(queries, vectors, limit).join(bodies, "id", "left")


def community_members(members: DataFrame, bodies: DataFrame, community: str) -> DataFrame:
    """R17."""
    return members.where(F.col("community") == community).join(bodies, "id").orderBy("id")


def surprise(hits: DataFrame | None, states: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """`(query_id, id, score, rank)`: the longest unseen first: age / (1 + age). Evicted entries go, the faded stay. Without
    hits, all entries are candidates of one query."""
    s = states.withColumnRenamed("e", "id").where("NOT evicted")
    df = s.withColumn("query_id", F.lit("all")) if hits is None else hits.select("query_id", "id").join(s, "id")
    age = activation.age_seconds(now)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return df.withColumn("score", age / (1 + age)).select("query_id", "id", "score").withColumn("rank", rank).where(F.col("rank") <= limit)


def page(results: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of each query's ranked results; beyond the end it is empty."""
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return results.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
