"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of codes form a product grid of cells. Every vector
is listed in its cell and visits the nearest cells by a multi-sequence traversal: the codes of each half are sorted by distance and
cells are visited by increasing sum. How many cells are visited is calibrated: as many as it takes to meet the target recall for
vectors at exactly the threshold. What meets in a cell is verified in double precision, and a pair counts if either of the two
visits the other's cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from factlog.llm.common import share_of
from factlog.llm.ngram_join import _by_key, local_components
from factlog.operators.components import connected_components
from factlog.session import partitions, written


def _raw(values, kind) -> bytes | None:
    """A vector's bytes; None if it is null, empty or zero or has null or non-finite components."""
    if values is None or not len(values) or any(x is None for x in values):
        return None
    x = np.asarray(values, kind)
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def unit(raws: list[bytes], kind) -> np.ndarray:
    """The vectors at unit length, in double precision."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kind_of(vectors: DataFrame):
    """float32 for a column of floats, which loses nothing and halves what is shuffled; else double precision."""
    return np.float32 if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else np.float64


def _rows(vectors: DataFrame, kind) -> DataFrame:
    """`(vec_id, label, k1, k2, raw)`; raw is null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.string())
            raw = [None if i is None or g is None else _raw(v, kind) for i, g, v in zip(ids.to_pylist(), labels.to_pylist(), batch.column("embedding").to_pylist(), strict=True)]
            key = [(None, None) if r is None else np.frombuffer(xxhash.xxh3_128_digest(r), np.int64).tolist() for r in raw]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "label", "k1", "k2", "raw"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, label string, k1 long, k2 long, raw binary")


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    step = max(1, CELLS // len(centres))
    for _ in range(rounds):
        near = np.concatenate([distances(x[i : i + step], centres).argmin(axis=1) for i in range(0, len(x), step)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, c, len(centres)) for c in x.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]


CELLS = 4_000_000  # numbers of a distance table that is held at a time


class Grid:
    """The codebooks of the two halves, and how many cells a traversal visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.visits = first, second, 1

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest `visits` cells of every row, nearest first.

        The n nearest cells of a pair of sorted code lists lie at ranks (i, j) with (i + 1)(j + 1) <= n, since all cells of
        lower ranks in both lists come before; only these are compared.
        """
        half = x.shape[1] // 2
        a, b = distances(x[:, :half], self.first), distances(x[:, half:], self.second)
        visits = min(visits, a.shape[1] * b.shape[1])
        oa, ob = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        i, j = np.array([(i, j) for i in range(min(visits, a.shape[1])) for j in range(min(visits // (i + 1), b.shape[1]))]).T
        sums = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        order = sums.argsort(axis=1, kind="stable")[:, :visits]
        return (np.take_along_axis(oa, i[order], 1) * b.shape[1] + np.take_along_axis(ob, j[order], 1)).astype(np.int32)

    def calibrate(self, x: np.ndarray, threshold: float, recall: float) -> Grid:
        """Visits: how many it takes until `recall` of partners at exactly the threshold cosine are met; all cells for a recall of 1."""
        rng = np.random.default_rng(6)
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        side /= np.sqrt((side * side).sum(axis=1, keepdims=True))
        partner = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * side
        home = self.traverse(partner, 1)[:, 0]
        half = x.shape[1] // 2
        a, b = distances(x[:, :half], self.first), distances(x[:, half:], self.second)
        sums = a[np.arange(len(x)), home // len(self.second)] + b[np.arange(len(x)), home % len(self.second)]
        b.sort(axis=1)
        rank = np.array([np.searchsorted(bi, s - ai, side="right").sum() for ai, bi, s in zip(a, b, sums, strict=True)])  # cells that are as near
        self.visits = len(self.first) * len(self.second) if recall >= 1 else max(1, int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]))
        return self


def codes_for(rows: float, cell_rows: int) -> int:
    """Codes a half so that a cell of the grid has about `cell_rows` of a label's rows."""
    return max(2, int(np.ceil(np.sqrt(rows / cell_rows))))


def fit(sample: list[bytes], codes: int, threshold: float, recall: float, kind) -> dict[int, Grid]:
    """A grid for every width in the sample."""
    out = {}
    for size in {len(r) for r in sample}:
        x = unit([r for r in sample if len(r) == size], kind)
        half = x.shape[1] // 2
        grid = Grid(kmeans(x[:, :half], codes), kmeans(x[:, half:], codes))
        out[size] = grid.calibrate(x[:2048], threshold, recall)
    return out


def _entries(classes: DataFrame, grids, kind) -> DataFrame:
    """Each class in its cell's list (listed) and as a visitor of the cells that it visits; `cells` holds all of them, home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            size = np.array([len(r) for r in raws])
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                grid = grids.value.get(int(width))
                some = [raws[i] for i in rows]
                step = max(1, CELLS // max(len(grid.first), grid.visits)) if grid else 1
                cells = np.concatenate([grid.traverse(unit(some[i : i + step], kind), grid.visits) for i in range(0, len(some), step)]) if grid else np.zeros((len(rows), 1), np.int32)
                n, v = cells.shape
                at = np.repeat(rows, v + 1)
                cell = np.concatenate([cells[:, :1], cells], axis=1).ravel()
                listed = np.tile([True] + [False] * v, n)
                label = batch.column("label").to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array([f"{label[i]}/{width}/{c}" for i, c in zip(at, cell, strict=True)]),
                    "listed": pa.array(listed),
                    "cid": batch.column("cid").take(pa.array(at)),
                    "copies": batch.column("copies").take(pa.array(at)),
                    "cells": pa.array([c.tobytes() for c in cells], pa.binary()).take(pa.array(np.repeat(np.arange(n), v + 1))),
                    "raw": batch.column("raw").take(pa.array(at)),
                })

    return classes.select("cid", "label", "copies", "raw").mapInArrow(run, "cell string, listed boolean, cid long, copies long, cells binary, raw binary")


def _verify(entries: DataFrame, threshold: float, kind) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "pair"):
            listed = t.column("listed").to_numpy(zero_copy_only=False)
            own, guest = np.flatnonzero(listed), np.flatnonzero(~listed)
            if not len(own) or not len(guest):
                continue
            ids, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy().astype(np.float64)
            raws, cells = t.column("raw").to_pylist(), t.column("cells").to_pylist()
            visited = np.frombuffer(b"".join(cells), np.int32).reshape(len(cells), -1)
            x = unit(raws, kind)
            linked = (x[guest] @ x[own].T >= threshold) & (ids[guest][:, None] != ids[own][None])
            if not linked.any():
                continue
            homes, home = np.unique(visited[guest, 0], return_inverse=True)
            met = (visited[own][None] == homes[:, None, None]).any(axis=2)[home]  # the listed one visits the guest's cell too
            one_way = linked & ~met
            ids_all, at = np.unique(ids, return_inverse=True)
            weight = np.bincount(at[guest], linked @ copies[own], len(ids_all)) + np.bincount(at[own], one_way.T @ copies[guest], len(ids_all))
            whole = np.zeros((len(ids_all), len(ids_all)), bool)
            i, j = np.nonzero(linked)
            whole[at[guest][i], at[own][j]] = whole[at[own][j], at[guest][i]] = True
            label = local_components(whole)
            some, star = np.flatnonzero(weight), np.flatnonzero(label != np.arange(len(ids_all)))
            yield pa.RecordBatch.from_pydict({
                "src": pa.array(np.concatenate([ids_all[some], ids_all[star]])),
                "dst": pa.array(np.concatenate([np.zeros(len(some), np.int64), ids_all[label[star]]]), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(star), bool)])),
                "n": pa.array(np.concatenate([weight[some].astype(np.int64), np.zeros(len(star), np.int64)]), mask=np.concatenate([np.zeros(len(some), bool), np.ones(len(star), bool)])),
            })

    return entries.mapInArrow(run, "src long, dst long, n long")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, sample_rows: int = 8192, cell_rows: int = 32) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` of every row of `vectors` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine is at least `threshold`. component_id is the smallest
    vec_id that is reachable by links, itself included; kept: vec_id is that. Vectors that are null, empty or zero or hold null or
    non-finite components, and rows with a null label, link with nothing. Vectors of different widths do not link. A null
    vec_id links with nothing and has a null component. Equal vectors are one entry of the index, so repeated rows are each
    returned and each count. Other columns are dropped; no rows give no rows.

    The codebooks grow with the rows of a label, so that a cell keeps about `cell_rows` of them. They are fitted on a sample of about sample_rows
    vectors, or of 16 a code where there are more codes (a number that grows with the square root of the rows); every vector is indexed.
    recall is the share of pairs at exactly the threshold that one direction of the search is calibrated to meet; closer pairs are
    met more often. Cells with many rows are cut into blocks, so no task holds a whole cell. A width that the sample lacks is one cell.
    """
    spark, kind = vectors.sparkSession, kind_of(vectors)
    rows = _rows(vectors, kind)
    good = rows.where("raw IS NOT NULL")
    classes = written(good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    of_label = classes.groupBy("label").agg(F.count("*").alias("n"))
    total, around = of_label.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n"), F.lit(0.0))).first()
    codes = codes_for(around, cell_rows)  # by the label that a row is likely to have, not the mean one
    share = min(1.0, max(sample_rows, 16 * codes) / max(total, 1))
    picked = classes.where(share_of(share, "cid", "label")).select("cid", "raw").toArrow().sort_by("cid")
    if total and not picked.num_rows:
        raise ValueError("the sample for the codebooks is empty")
    grids = spark.sparkContext.broadcast(fit(picked.column("raw").to_pylist(), codes, threshold, recall, kind))

    entries = _entries(classes, grids, kind)
    sizes = entries.groupBy("cell").agg(F.sum(F.col("listed").cast("long")).alias("own"), F.sum((~F.col("listed")).cast("long")).alias("guests")).where("own > 0")
    parts = lambda n: F.ceil(F.col(n) / F.least(F.lit(4096), F.greatest(F.lit(512), F.ceil(F.col(n) / 16)))).cast("int")
    sizes = written(sizes.select("cell", parts("own").alias("a"), parts("guests").alias("b")))
    entries = entries.join(sizes, "cell")  # cells with visitors alone go
    mine = F.pmod(F.xxhash64("cid"), F.when(F.col("listed"), F.col("a")).otherwise(F.col("b")))
    entries = entries.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("listed"), F.col("b")).otherwise(F.col("a")) - 1)))
    i, j = F.when(F.col("listed"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("listed"), F.col("other")).otherwise(F.col("mine"))
    entries = entries.select("listed", "cid", "copies", "cells", "raw", F.concat_ws(":", "cell", i, j).alias("pair"))
    entries = entries.repartition(partitions(spark), "pair").sortWithinPartitions("pair")
    found = written(_verify(entries, threshold, kind))

    links = found.where("n IS NOT NULL").groupBy(F.col("src").alias("cid")).agg(F.sum("n").alias("links"))
    component = connected_components(found.where("dst IS NOT NULL")).select(F.col("id").alias("cid"), "component")
    done = classes.select("label", "k1", "k2", "cid", "copies").join(component, "cid", "left").join(links, "cid", "left")
    done = written(done.select("label", "k1", "k2", F.coalesce("component", "cid").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked = good.select("vec_id", "label", "k1", "k2").join(done, ["label", "k1", "k2"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
