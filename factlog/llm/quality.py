"""Quality classification by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.llm.common import keep_rows, share_of, small, texts_of

DIM = 1 << 15  # hashed words
STATS = 16
SIZE = DIM + STATS
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 sign, 8 high byte.
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t"), (5, b"\r\n"), (6, b".,;:'\"?-()")):
    _CLASS[list(_bytes)] = _k
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 7
_CLASS[128:] = 8


class Words(dict):
    """Hashed place of a word; at most 2**17 are kept in a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        out = zlib.crc32(word) % DIM
        if len(word) <= 64:
            self[word] = out
        return out


def features(texts: list[str], n_chars: list[int | None], places: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as (offsets, places, values). A row always has its statistics, so no row is empty."""
    offsets, at, values = [0], [], []
    for text, chars in zip(texts, n_chars, strict=True):
        raw = text.encode(errors="replace")
        words = raw.lower().split()
        n, size = len(words), max(len(raw), 1)
        if n:
            where, times = np.unique(np.fromiter(map(places.__getitem__, words), np.int32, n), return_counts=True)
            weight = np.log1p(times)
            weight = weight / np.sqrt((weight * weight).sum())
        else:
            where, weight = np.zeros(0, np.int32), np.zeros(0)
        kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) if raw else np.zeros(9)
        lines = raw.split(b"\n")
        letters = max(kinds[1] + kinds[2] + kinds[8], 1)
        stats = [
            1.0, kinds[2] / letters, kinds[3] / size * 4, kinds[4] / size * 4, kinds[6] / size * 8, kinds[7] / size * 4, kinds[8] / size * 2, kinds[0] / size * 4,
            np.log1p(n) / 8, len(set(words)) / max(n, 1), min(size / max(n, 1), 40) / 10, len(set(lines)) / len(lines), min(1.0, len(lines) / max(n, 1)),
            raw.count(b"|") / size * 8, raw.count(b"!") / size * 8, np.log1p(len(text) if chars is None else chars) / 12,
        ]
        at += [where, np.arange(DIM, SIZE, dtype=np.int32)]
        values += [weight, np.array(stats)]
        offsets.append(offsets[-1] + len(where) + STATS)
    return np.array(offsets), np.concatenate(at) if at else np.zeros(0, np.int32), np.concatenate(values).astype(np.float32) if values else np.zeros(0, np.float32)


class Machine:
    """score = sigmoid(b + sum w x + (sum over factors of (sum v x)^2 - sum (v x)^2) / 2): linear in the row's length."""

    def __init__(self, factors: int = 4, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(SIZE, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SIZE, factors)).astype(np.float32)

    def raw(self, offsets, at, x):
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, offsets[:-1])
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, offsets[:-1])).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[at] * x, offsets[:-1]) + pairs, sums

    def score(self, offsets, at, x) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(offsets, at, x)[0], -30, 30).astype(float)))

    def fit(self, offsets, at, x, y, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 1e-5) -> Machine:
        """AdaGrad over mini-batches in a fixed random order. Classes weigh alike in the loss's gradient up to a factor of 4."""
        rng, n = np.random.default_rng(1), len(y)
        share = np.clip(y.mean(), 0.05, 0.95)
        weight = np.where(y == 1, 1.0, min(4.0, share / (1 - share)))
        gb, gw, gv = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                rows = order[lo : lo + batch]
                sizes = offsets[rows + 1] - offsets[rows]
                local = np.concatenate([[0], np.cumsum(sizes)])
                pick = np.repeat(offsets[rows] - local[:-1], sizes) + np.arange(local[-1])
                a, xs = at[pick], x[pick]
                z, sums = self.raw(local, a, xs)
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                each = np.repeat(err, sizes)
                gb += err.sum() ** 2
                self.bias -= rate * err.sum() / np.sqrt(gb)
                touched, back = np.unique(a, return_inverse=True)
                d = np.bincount(back, each * xs, len(touched)) + decay * self.w[touched]
                gw[touched] += d**2
                self.w[touched] -= rate * d / np.sqrt(gw[touched])
                slope = each[:, None] * xs[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[a] * xs[:, None])
                d = np.stack([np.bincount(back, s, len(touched)) for s in slope.T], axis=1) + decay * self.v[touched]
                gv[touched] += d**2
                self.v[touched] -= rate * d / np.sqrt(gv[touched])
        return self


def _chars(batch: pa.RecordBatch, n: int) -> list:
    return batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * n


def train(docs: DataFrame, labels: DataFrame, rows: int = 8192) -> Machine:
    """Fit on about `rows` labelled documents: a bounded sample of `labels` (doc_id, quality) by a hash of the id.

    Rows that repeat an id and its text count once. Without any labelled row the machine scores 0.5 everywhere.
    """
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, rows / max(labels.count(), 1))
    some = labels.where(share_of(share, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Words()
        for batch in small(batches):
            offsets, at, x = features(texts_of(batch), _chars(batch, batch.num_rows), places)
            cuts = zip(offsets, offsets[1:], strict=False)
            parts = [(at[a:b].tobytes(), x[a:b].tobytes()) for a, b in cuts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("quality").cast(pa.int32()), "at": pa.array([p for p, _ in parts], pa.binary()), "x": pa.array([p for _, p in parts], pa.binary())})

    # about `rows` ids and flags: small enough to broadcast whatever the size of the corpus
    # only the columns that are read meet the labels, so columns of any name may stand beside them
    docs = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    found = docs.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "text"]).mapInArrow(run, "doc_id long, y int, at binary, x binary").toArrow().sort_by("doc_id")
    machine = Machine()
    if found.num_rows:
        at = [np.frombuffer(b, np.int32) for b in found.column("at").to_pylist()]
        x = np.concatenate([np.frombuffer(b, np.float32) for b in found.column("x").to_pylist()])
        machine.fit(np.concatenate([[0], np.cumsum([len(a) for a in at])]), np.concatenate(at), x, found.column("y").to_numpy().astype(float))
    else:
        machine.v[:] = 0
    return machine


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, rows: int = 8192) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row of `docs`.

    Learns from `labels` (doc_id, quality 0/1) of documents that are not held out; inputs are the text and, where the
    table has it, n_chars. rows: the bound of the labelled sample. score: 0 to 1, higher for better; predicted = 1 if
    score >= 0.5. Null and empty texts are scored by their statistics. An id with both labels counts as good. Repeated
    rows and ids each give a row; a null doc_id is not held out; other columns are dropped; no rows give no rows.
    """
    marked = docs.select("doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []), held_out.alias("held_out"))
    machine = train(marked.where("NOT held_out AND text IS NOT NULL"), labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Words()
        for batch in small(batches):
            texts, chars = texts_of(batch), _chars(batch, batch.num_rows)
            score = np.concatenate([shared.value.score(*features(texts[i : i + 500], chars[i : i + 500], places)) for i in range(0, len(texts), 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return marked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, held_out, rows: int = 8192) -> DataFrame:
    """The rows of `docs`, with all their columns, that score at least 0.5; trained as in `quality_scores`.

    Null and empty texts are scored by their statistics like any other; repeated rows stay or go together; rows without an id are scored too;
    no rows give no rows; columns of any name pass through.
    """
    machine = train(docs.where(~held_out & F.col("text").isNotNull()), labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def good(batch: pa.RecordBatch) -> list[bool]:
        texts, chars, places = texts_of(batch), _chars(batch, batch.num_rows), Words()
        return [bool(s >= 0.5) for i in range(0, len(texts), 500) for s in shared.value.score(*features(texts[i : i + 500], chars[i : i + 500], places))]

    return keep_rows(docs, good)
