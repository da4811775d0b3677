"""Best-fit packing of documents into training windows under conflicts.

Open bins stand in the order of their residual room, each with a bitmap of the sources and one of the duplicate clusters that it holds. A
piece goes to the tightest bin that has room and no conflict: the search starts at the first residual that is large
enough and moves to the successor until a bin is compatible; if none is, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.llm.common import small, texts_of, whole_texts
from factlog.llm.ngram_join import ngram_join
from factlog.session import partitions, written

OUTPUT = "doc_id long, piece int, start long, n_words long, bin string, position int, room long"


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """`(bin, room left after it)` of every piece, in the order given. A bin takes at most `per_source` pieces of a
    source and one of a cluster. Bins of equal residual are tried in the order in which they were opened.

    Full bins leave the order. The bitmaps are integers: bit s of planes[p] is set if the bin has more than p pieces of
    source s.
    """
    open_bins: list[tuple[int, int]] = []  # (residual, bin)
    seen: list[int] = []  # clusters
    planes: list[list[int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (seen[open_bins[at][1]] & c or planes[open_bins[at][1]][-1] & s):
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(seen)
            seen.append(0)
            planes.append([0] * per_source)
        seen[b] |= c
        first = next(p for p in range(per_source) if not planes[b][p] & s)
        planes[b][first] |= s
        out.append((b, room - size))
        if room > size:
            insort(open_bins, (room - size, b))
    return out


MEASURED = "doc_id long, source long, cluster long, n long, h long"


def measured(docs: DataFrame) -> DataFrame:
    """Every row's id, source, number of words, and a cluster: equal for texts that differ only in case and white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            words = [x.encode().lower().split() for x in texts_of(batch)]
            cluster = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(cluster), pa.array([len(w) for w in words], pa.int64()), batch.column("h")], ["doc_id", "source", "cluster", "n", "h"])

    return _keyed(docs).mapInArrow(run, MEASURED)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("source"), F.lit(0)).alias("source"), "text", F.xxhash64("doc_id", "text").alias("h"))


def near_copies(docs: DataFrame) -> DataFrame:
    """As `measured`, with near copies as `ngram_join` has them in one cluster. A hash of id and text stands in for the id, so rows without an
    id and ids of several texts count as well. Texts without words are clusters of their own."""
    rows = _keyed(docs).select(F.col("h").alias("doc_id"), "text", F.col("doc_id").alias("id"), "source")
    found = ngram_join(rows, carry=["id", "source"])
    return found.select(F.col("id").alias("doc_id"), "source", F.col("component_id").alias("cluster"), F.col("n_words").alias("n"), F.col("doc_id").alias("h"))


def best_fit(docs: DataFrame, capacity: int = 2048, per_source: int = 4, shard_rows: int = 2048, rows: DataFrame | None = None) -> DataFrame:
    """Pack every row's whole text, measured in white-space separated words, into bins of `capacity` words.

    Longer texts are split into pieces: full pieces fill a bin each, the last one is packed. `rows` says which
    documents are copies of each other (`measured`, the default: equal texts but for case and white space; `near_copies`: near ones
    too); a bin never holds two pieces of one cluster, and at most `per_source` of one source. Rows are dealt into shards of
    about `shard_rows` by a hash of id and text, so a frequent source or a large cluster is spread over all of them, and repeats of one
    row are dealt one by one. Every shard is packed by decreasing size. The number of shards follows the number of rows.

    Returns `(doc_id, piece, start, n_words, bin, position, room)`: start is the piece's first word, bin is shard and
    number, position the piece's place in the bin, room what the finished bin has left. Null and empty texts give one
    piece of 0 words in a bin of their own. A null source or id is a value like any other. Repeated rows are packed each; other columns are
    dropped; no rows give no rows.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    rows = written(measured(docs) if rows is None else rows)
    shards = max(1, -(-rows.count() // shard_rows))
    # repeats of a row have one hash: the task and its row number tell them apart
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(shards)))
    rows = rows.repartition(max(partitions(spark), min(shards, 20_000)), "shard").sortWithinPartitions("shard", "doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if held and held[0].column("shard")[0].as_py() != shard[a]:
                    yield _packed(held, capacity, per_source)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield _packed(held, capacity, per_source)

    return rows.mapInArrow(run, OUTPUT)


def _packed(held: list[pa.RecordBatch], capacity: int, per_source: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    ids, n = t.column("doc_id").to_pylist(), t.column("n").to_numpy()
    shard = t.column("shard")[0].as_py()
    source = np.unique(t.column("source").to_numpy(), return_inverse=True)[1].tolist()
    cluster = np.unique(t.column("cluster").to_numpy(), return_inverse=True)[1].tolist()
    pieces = []  # (size, row, piece, start)
    whole = []
    for i, size in enumerate(n.tolist()):
        full, rest = divmod(size, capacity)
        whole += [(capacity, i, k, k * capacity) for k in range(full)]
        if rest or not full:
            (pieces if rest else whole).append((rest, i, full, full * capacity))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    at = pack([p[0] for p in pieces], [source[p[1]] for p in pieces], [cluster[p[1]] for p in pieces], capacity, per_source)
    bins = max((b for b, _ in at), default=-1) + 1
    left: dict[int, int] = dict(at)  # the last piece's residual
    rows, count = [], [0] * bins
    for (size, i, k, start), (b, _) in zip(pieces, at, strict=True):
        rows.append((ids[i], k, start, size, f"{shard}:{b}", count[b], left[b]))
        count[b] += 1
    rows += [(ids[i], k, start, size, f"{shard}:{bins + j}", 0, capacity - size) for j, (size, i, k, start) in enumerate(whole)]
    names = ["doc_id", "piece", "start", "n_words", "bin", "position", "room"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)], names)
