"""Sorted arrays of numbers as compressed bytes, and rows that carry them from one group of tasks to another.

A row is `(kind, place, of, x, a, b)`: bytes x of some kind for the group `place`, from the group `of`, with two numbers that
sums over a whole table need. Rows are sent once for a whole list of keys, so shuffles move a few bytes a key; lists without keys
are not sent, so there are never more rows than keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

ROW = "kind string, place long, of long, x binary, a double, b double"
_FIELDS = pa.schema([("kind", pa.string()), ("place", pa.int64()), ("of", pa.int64()), ("x", pa.binary()), ("a", pa.float64()), ("b", pa.float64())])


def squeeze(*columns: np.ndarray) -> bytes:
    """Arrays of one length as bytes: the numbers' bytes stand plane by plane, which shortens well. Unsigned 64-bit columns
    are taken as differences, so a sorted one takes what its gaps need."""
    planes = []
    for c in columns:
        c = np.diff(c, prepend=np.uint64(0)) if c.dtype == np.uint64 else np.ascontiguousarray(c)
        planes.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.compress(b"".join(planes), 1)


def expand(raw: bytes, *kinds) -> list[np.ndarray]:
    """The columns of `squeeze`."""
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    kinds = [np.dtype(k) for k in kinds]
    n, at, out = len(flat) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        c = np.ascontiguousarray(flat[at : at + n * k.itemsize].reshape(k.itemsize, n).T).reshape(-1).view(k)
        out.append(np.cumsum(c, dtype=np.uint64) if k == np.uint64 else c)
        at += n * k.itemsize
    return out


def stretches(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """`(key, begin, end)` of every run of equal keys."""
    if len(sorted_keys):
        cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)], strict=True):
            yield int(sorted_keys[a]), a, b


def row(kind: str, place: int, of: int, x: bytes, a: float = 0.0, b: float = 0.0) -> tuple:
    return kind, place, of, x, a, b


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[tuple[int, bytes]]]]]:
    """Every place of rows that are sorted by it, with its `(of, x)` by kind, in the order of `of`."""
    now, held = None, {}
    for batch in batches:
        for kind, place, of, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "place", "of", "x")), strict=True):
            if place != now:
                if held:
                    yield now, {k: sorted(v) for k, v in held.items()}
                now, held = place, {}
            held.setdefault(kind, []).append((of, x))
    if held:
        yield now, {k: sorted(v) for k, v in held.items()}


def at_places(rows: DataFrame, partitions: int, each: Callable[[int, dict[str, list[tuple[int, bytes]]]], list[tuple]]) -> DataFrame:
    """`each(place, rows by kind)` for every place, on whichever task the place falls; its rows again as a table of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in by_place(batches):
            if out := each(place, held):
                yield batch_of(out)

    return rows.repartition(partitions, "place").sortWithinPartitions("place").mapInArrow(run, ROW)


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of lists `(sorted keys, numbers...)`: all keys, the sums of their numbers, and for each list where its keys stand."""
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [np.bincount(back, np.concatenate([p[i] for p in parts]), len(keys)) for i in range(1, len(parts[0]))]
    ends = np.cumsum([len(p[0]) for p in parts])
    return keys, sums, [back[e - len(p[0]) : e] for e, p in zip(ends, parts, strict=True)]
