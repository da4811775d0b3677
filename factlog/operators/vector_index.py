"""R19 with an index: exact nearest neighbours by cosine that leave most vectors unread.

Every unit vector belongs to the cell of its nearest centre. A cell's vectors are sorted by their angle to the centre and cut into blocks, so a
block is a ring: it has a least and a greatest angle. By the triangle inequality of angles no vector of a block is nearer to a query than
`max(low - a, a - high)`, a being the query's angle to the centre. A search first reads the blocks of least bound until they
hold k vectors; the k-th best of these is a limit, and only blocks whose bound does not pass it are read then. What was not read cannot be among the k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.operators import recall
from factlog.session import discard, partitions, written

BLOCK_ROWS = 512
MOST_BLOCKS = 1 << 19  # blocks grow with the table, so that their bounds (32 bytes each) can be broadcast whatever its size
MOST_CELLS = 2048
SLACK = 1e-6  # of angles: far more than rounding makes of them
VISITS = 1 << 13  # visits that stand in one batch
READERS = 1 << 12  # queries that a task compares with one block
_ROWS = "width int, cell int, angle double, id string, unit binary"


@dataclass
class Index:
    """`rows` (block, id, unit) on disk; per width the unit centres; per width the blocks' numbers, cells, least and greatest angles, and rows."""

    rows: DataFrame
    centres: dict[int, np.ndarray]
    blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def count(self) -> int:
        return int(sum(b[4].sum() for b in self.blocks.values()))


def finite(df: DataFrame, key: str) -> DataFrame:
    """`(key, embedding)` in doubles: rows with entries, all of them finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)


def units(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every width in the batch: the width, its rows and their unit vectors (a zero vector stays)."""
    lists = batch.column("embedding")
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    ends = np.cumsum(sizes)
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        x = flat[(ends[rows] - width)[:, None] + np.arange(width)]
        norm = np.sqrt((x * x).sum(axis=1))
        yield int(width), rows, x / np.where(norm > 0, norm, 1.0)[:, None]


def _fit(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means: unit centres; a centre that nothing falls to takes the vector that is farthest from its own."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near, sims = nearest_centre(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        far = iter(np.argsort(sims))
        for c in np.flatnonzero(norm == 0):
            sums[c], norm[c] = sample[next(far)], 1.0
        centres = sums / norm[:, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, sims = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), step := max(1, 4_000_000 // len(centres))):
        s = x[lo : lo + step] @ centres.T
        at[lo : lo + step] = s.argmax(axis=1)
        sims[lo : lo + step] = s.max(axis=1)
    return at, sims


def angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def build(vectors: DataFrame, block_rows: int = BLOCK_ROWS, cells: int | None = None) -> Index:
    """The index of `(id, embedding)`. Centres are fitted on a bounded sample (16 vectors a cell, by a hash of the id); every vector is indexed.

    cells: how many a width gets, the root of its rows by default, at most MOST_CELLS. Rows are sorted over the cluster by (cell, angle, id): a cell
    that holds a third of all vectors is many ranges, never one task. Null, empty and non-finite vectors are left out; zero vectors are a
    cell of their own, at a right angle to everything.
    """
    spark = vectors.sparkSession
    rows = finite(vectors.select(F.col("id").cast("string").alias("id"), "embedding"), "id")
    sizes = {r["width"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).collect()}
    centres: dict[int, np.ndarray] = {}
    for width, n in sizes.items():
        want = min(cells or max(1, int(n**0.5)), MOST_CELLS)
        share = min(1.0, 16 * want / n)
        some = rows.where(F.size("embedding") == width)
        some = some if share >= 1 else some.where(F.xxhash64("id", F.lit("cells")) < -(1 << 63) + int(share * (1 << 64)))
        sample = [u[(u != 0).any(axis=1)] for b in some.select("embedding").toArrow().combine_chunks().to_batches() for _, _, u in units(b)]  # about 16 rows a cell
        sample = np.concatenate(sample) if sample else np.zeros((0, width))
        centres[width] = _fit(sample, want) if len(sample) else np.eye(1, width)
    shared = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors a width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, u in units(batch):
                cell, sims = nearest_centre(u, shared.value[width])
                zero = ~(u != 0).any(axis=1)
                yield pa.RecordBatch.from_pydict({
                    "width": pa.array(np.full(len(at), width, np.int32)), "cell": pa.array(np.where(zero, -1, cell).astype(np.int32)), "angle": pa.array(np.where(zero, 0.0, angle(sims))),
                    "id": batch.column("id").take(pa.array(at)), "unit": pa.array([r.tobytes() for r in u], pa.binary()),
                })

    total = sum(sizes.values())
    size = max(block_rows, -(-2 * total // MOST_BLOCKS))
    assigned = written(rows.mapInArrow(assign, _ROWS))
    keys = ["width", "cell", "angle", "id"]
    sorted_ = assigned.repartitionByRange(max(partitions(spark), total // 200_000), *keys).sortWithinPartitions(*keys)
    placed = written(sorted_.mapInArrow(lambda batches: _cut(batches, size), "block long, " + _ROWS))
    discard(assigned)
    blocks = {}
    found = placed.groupBy("block", "width", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).orderBy("block").toArrow()  # at most about MOST_BLOCKS rows
    for width in sizes:
        at = np.flatnonzero(found.column("width").to_numpy() == width)
        blocks[width] = tuple(found.column(c).to_numpy()[at] for c in ("block", "cell", "low", "high", "n"))
    return Index(placed.select("block", "id", "unit"), centres, blocks)


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Number the blocks of rows that are sorted by cell: a block ends with its cell or after `size` rows."""
    from pyspark import TaskContext

    block, held, now = (TaskContext.get().partitionId() << 32) - 1, 0, None
    for batch in batches:
        keys = zip(batch.column("width").to_pylist(), batch.column("cell").to_pylist(), strict=True)
        out = np.zeros(batch.num_rows, np.int64)
        for i, key in enumerate(keys):
            if key != now or held == size:
                block, held, now = block + 1, 0, key
            held += 1
            out[i] = block
        yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], ["block", *batch.schema.names])


def save(index: Index, path: str) -> None:
    """Write the index under `path`; an index that is there stays until the new one is whole (the bounds are written last)."""
    spark = index.rows.sparkSession
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    centres = [(w, i, c.tolist()) for w, cs in index.centres.items() for i, c in enumerate(cs)]
    spark.createDataFrame(centres, "width int, cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    bounds = [(w, *map(float, r)) for w, b in index.blocks.items() for r in zip(*b, strict=True)]
    spark.createDataFrame(bounds, "width int, block double, cell double, low double, high double, n double").write.mode("overwrite").parquet(f"{path}/bounds")


def load(spark: SparkSession, path: str) -> Index:
    centres: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/centres").orderBy("width", "cell").collect():
        centres.setdefault(r["width"], []).append(r["centre"])
    bounds = spark.read.parquet(f"{path}/bounds").orderBy("block").toArrow()
    blocks = {}
    for width in centres:
        at = np.flatnonzero(bounds.column("width").to_numpy() == width)
        b, c, low, high, n = (bounds.column(x).to_numpy()[at] for x in ("block", "cell", "low", "high", "n"))
        blocks[width] = (b.astype(np.int64), c.astype(np.int64), low, high, n.astype(np.int64))
    return Index(spark.read.parquet(f"{path}/rows"), {w: np.array(c) for w, c in centres.items()}, blocks)


def bounds(q: np.ndarray, centres: np.ndarray, blocks: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For unit queries and all blocks of their width: the least angle that a vector of the block can have, and the order in which blocks are first read."""
    _, cell, low, high, _ = blocks
    a = angle(q @ centres.T)[:, np.maximum(cell, 0)]
    bound = np.maximum(np.maximum(low - a, a - high), 0.0)
    bound[:, cell < 0] = np.pi / 2
    bound[~(q != 0).any(axis=1)] = np.pi / 2  # a zero query is at a right angle to everything
    return bound, np.argsort(bound + 1e-3 * a, axis=1, kind="stable")


def plans(batch: pa.RecordBatch, centres: dict, blocks: dict, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of the batch's queries: their rows, which blocks they read first, the blocks' bounds, and the unit vectors."""
    for width, rows, u in units(batch):
        if width not in blocks or not len(blocks[width][0]):
            continue
        n = blocks[width][4]
        for lo in range(0, len(rows), step := max(1, 2_000_000 // len(n))):
            bound, order = bounds(u[lo : lo + step], centres[width], blocks[width])
            read = np.cumsum(n[order], axis=1) - n[order] < enough
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order, read, axis=1)
            yield rows[lo : lo + step], first, bound, u[lo : lo + step]


def search(index: Index, queries: DataFrame, k: int, floor: float | None = None, exclude_self: bool = False, most_share: float = 1 / 3) -> tuple[DataFrame | None, float]:
    """`(query_id, id, sim, rank)` as `recall.nearest` gives them, and the share of all pairs of queries and vectors that were compared.

    The rows are None where the bounds let more than `most_share` of the pairs through: then nothing but the first blocks was read, and comparing blocks
    of queries with all vectors (`recall.nearest`) moves fewer bytes.
    """
    spark = queries.sparkSession
    q = written(finite(queries, "query_id"))
    kind = q.schema["query_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((index.centres, index.blocks))  # bounded by MOST_CELLS and MOST_BLOCKS
    enough = 2 * (k + 1)
    visit = f"block long, query_id {kind}, unit binary, least double"

    def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, blocks = shared.value
        for batch in batches:
            for rows, first, _, u in plans(batch, centres, blocks, enough):
                yield from _visits(batch, rows, first, u, np.full(len(rows), -2.0), blocks)

    best = written(_top(_compared(index, q.mapInArrow(opening, visit), k, floor, exclude_self, kind), k))
    limit = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("least"))
    asked = written(q.join(limit, "query_id", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(-2.0)), F.lit(-2.0 if floor is None else float(floor)))))

    def open_blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        centres, blocks = shared.value
        least = batch.column("least").to_numpy()
        for rows, first, bound, u in plans(batch, centres, blocks, enough):
            # cosines are rounded to twelve places before they are compared
            reach = np.where(least[rows] < -1, 4.0, angle(least[rows] - 1e-12) + SLACK)
            yield rows, first, (bound <= reach[:, None]) & ~first, u, least[rows], blocks

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = 0
        for batch in batches:
            for rows, first, rest, u, _, blocks in open_blocks(batch):
                pairs += int(((first | rest) @ blocks[u.shape[1]][4]).sum())
        yield pa.RecordBatch.from_pydict({"pairs": pa.array([pairs])})

    asked_n = q.count()
    share = (asked.mapInArrow(cost, "pairs long").agg(F.sum("pairs")).first()[0] or 0) / max(1, asked_n * index.count())
    if share > most_share:
        discard(q, best, asked)
        return None, share

    def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, rest, u, least, blocks in open_blocks(batch):
                yield from _visits(batch, rows, rest, u, least, blocks)

    more = _compared(index, asked.mapInArrow(closing, visit), k, floor, exclude_self, kind)
    return _top(best.select("query_id", "id", "sim").union(more), k), share


def _visits(batch: pa.RecordBatch, rows: np.ndarray, chosen: np.ndarray, u: np.ndarray, least: np.ndarray, blocks: dict) -> Iterator[pa.RecordBatch]:
    """The chosen pairs of queries and blocks, VISITS at a time: each carries its query's vector."""
    who, which = np.nonzero(chosen)
    raw = pa.array([r.tobytes() for r in u], pa.binary())
    for lo in range(0, len(who), VISITS):
        some, at = who[lo : lo + VISITS], which[lo : lo + VISITS]
        yield pa.RecordBatch.from_pydict({"block": pa.array(blocks[u.shape[1]][0][at]), "query_id": batch.column("query_id").take(pa.array(rows[some])), "unit": raw.take(pa.array(some)), "least": pa.array(least[some])})


def _compared(index: Index, visits: DataFrame, k: int, floor: float | None, exclude_self: bool, kind: str) -> DataFrame:
    """`(query_id, id, sim)`: for every visit the k best of its block. A block that many queries read is sent to as many tasks as it takes."""
    visits = written(visits)
    load = visits.groupBy("block").agg(F.ceil(F.count("*") / READERS).cast("int").alias("parts"))
    side = visits.join(load, "block").select("block", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("id"), "query_id", "unit", "least")
    rest = index.rows.join(load, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "id", F.lit(None).cast(kind).alias("query_id"), "unit", F.lit(None).cast("double").alias("least"))
    both = rest.union(side).repartition("block", "part").sortWithinPartitions("block", "part", "side", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, raws, held = None, [], [], None
        for batch in batches:
            block, part, side = (batch.column(c).to_numpy() for c in ("block", "part", "side"))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == b:
                    continue
                if (block[a], part[a]) != now:
                    now, ids, raws, held = (block[a], part[a]), [], [], None
                if not side[a]:
                    ids += batch.column("id").slice(a, b - a).to_pylist()
                    raws += batch.column("unit").slice(a, b - a).to_pylist()
                elif ids:
                    held = np.frombuffer(b"".join(raws), float).reshape(len(ids), -1) if held is None else held
                    for lo in range(a, b, step := max(1, 2_000_000 // len(ids))):
                        some = batch.slice(lo, min(step, b - lo))
                        yield from _best(some, ids, held, k, floor, exclude_self)

    return both.mapInArrow(meet, f"query_id {kind}, id string, sim double")


def _best(asked: pa.RecordBatch, ids: list[str], held: np.ndarray, k: int, floor: float | None, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    q = np.frombuffer(b"".join(asked.column("unit").to_pylist()), float).reshape(asked.num_rows, -1)
    sims = np.round(q @ held.T, 12)  # equal vectors have equal cosines
    names = [str(x) for x in asked.column("query_id").to_pylist()]
    if exclude_self:
        own = {x: j for j, x in enumerate(ids)}
        for i, x in enumerate(names):
            if x in own:
                sims[i, own[x]] = -np.inf
    least = np.maximum(asked.column("least").to_numpy(), -2.0 if floor is None else floor)[:, None]
    if len(ids) > k:
        least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k][:, None])
    who, at = np.nonzero(sims >= least)
    order = np.lexsort((at, -sims[who, at], who))  # the block's ids are ascending, so ties go by id
    who, at = who[order], at[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    who, at = who[keep], at[keep]
    if len(who):
        yield pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(who)), pa.array([ids[j] for j in at], pa.string()), pa.array(sims[who, at])], ["query_id", "id", "sim"])


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "sim", "rank")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, exclude_self: bool = False, index: Index | None = None) -> DataFrame:
    """R19 by the index (built here if none is given), or block by block where its bounds do not prune: the same rows either way."""
    found, _ = search(index or build(vectors), queries, k, floor, exclude_self)
    return recall.nearest(queries, vectors, k, floor, exclude_self) if found is None else found
