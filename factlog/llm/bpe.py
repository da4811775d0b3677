"""Byte-level BPE over rank files: vectorised pre-tokenisation, cached pair merging, and decoding.

Boundaries come from arrays alone. Code points are mapped to a few classes; each class is a transition function on the
states of a small automaton, and because function composition is associative, the automaton runs over many stretches
of the batch at once: compose the functions inside every stretch, scan over the stretches' compositions for the state
in which each begins, then replay every stretch from its state. The slices between boundaries feed a cache of merged
pieces, and the slices' offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factlog.llm.common import small, texts_of

# Classes of code points. SPACE is white space other than U+0020, which is BLANK; the letters that can end a
# contraction have classes of their own; END stands between two texts.
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, STMD, R, V, L, E, END = range(12)
#: The kind of piece that a class belongs to: other, letter, number, space, end.
KIND = np.array([0, 1, 2, 3, 3, 0, 1, 1, 1, 1, 1, 4], np.uint8)
# States: what came last. Q is a quote that begins a piece, QRV and QL a quote and a letter, C a finished contraction.
S_START, S_O, S_L, S_N, S_S, S_B, Q, QRV, QL, C2, C3 = range(11)


def _automaton() -> np.ndarray:
    """NEXT[class, state]."""
    plain = {OTHER: S_O, LETTER: S_L, NUMBER: S_N, SPACE: S_S, BLANK: S_B, STMD: S_L, R: S_L, V: S_L, L: S_L, E: S_L, END: S_START}
    out = np.zeros((12, 11), np.uint8)
    for kind, state in plain.items():
        out[kind] = state
    out[QUOTE] = Q
    out[QUOTE, [S_O, S_B, Q]] = S_O  # inside a run, or after the blank that the run takes
    out[STMD, Q] = C2
    out[[R, V], Q] = QRV
    out[L, Q] = QL
    out[E, QRV] = C3
    out[L, QL] = C3
    return out


NEXT = _automaton()
STRETCH = 256


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode properties that the pattern names; the last entry is END."""
    out = np.zeros(0x110001, np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
        found = "".join(regex.findall(f"{name}+", points))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    out[0x20], out[0x27], out[0x110000] = BLANK, QUOTE, END
    for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in letters:
            out[ord(x)] = kind
    return out


def states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state after every code point, by composition inside stretches and a scan over them."""
    n = len(kinds)
    rows = -(-n // STRETCH)
    grid = np.full(rows * STRETCH, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, STRETCH).T)
    size = NEXT.shape[1]
    flat = NEXT.ravel()
    whole = np.tile(np.arange(size, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = flat[column.astype(np.int32)[:, None] * size + whole]
    step = 1
    while step < rows:  # inclusive scan: whole[i] becomes the composition of stretches 0..i
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    now = np.concatenate([[S_START], whole[:-1, S_START]]).astype(np.int32)
    out = np.empty((STRETCH, rows), np.uint8)
    for j, column in enumerate(grid):
        now = flat[column.astype(np.int32) * size + now].astype(np.int32)
        out[j] = now
    return out.T.ravel()[:n]


def boundaries(texts: list[str]) -> list[np.ndarray]:
    """For every text, the code point offsets at which a piece begins, and its length at the end."""
    lengths = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(lengths + 1)
    points = np.full(int(ends[-1]) if len(texts) else 0, 0x110000, np.uint32)
    body = np.ones(len(points), bool)
    body[ends - 1] = False
    points[body] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[points]
    state, kind = states(kinds), KIND[kinds]
    before = np.concatenate([[4], kind[:-1]])
    after = np.concatenate([kind[1:], [4]])
    start = kind != before
    blank = kinds == BLANK
    start[1:] &= ~(blank[:-1] & (kind[1:] < 3))  # a blank goes with the run that follows it
    start |= (kind == 3) & (after < 3)  # the last of some white space stands apart from the rest
    for done, size in ((C2, 2), (C3, 3)):
        at = np.flatnonzero(state == done)
        for back in range(size - 1):
            start[at - back] = False
        start[at + 1] = True
    found = np.flatnonzero(start)
    firsts = ends - lengths - 1
    lo = np.searchsorted(found, firsts)
    hi = np.searchsorted(found, ends - 1)
    return [np.append(found[a:b] - f, n) for a, b, f, n in zip(lo, hi, firsts, lengths, strict=True)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the lowest-ranked adjacent pair is merged first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 48:
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (low := min(pairs)) < 1 << 30:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]
    size, left, right = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[piece[i : i + 2]], i, 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and size[i] and (j := right[i]) < n and (r := ranks.get(piece[i : j + size[j]])) is not None:
            heapq.heappush(heap, (r, i, size[i] + size[j]))

    while heap:
        _, i, both = heapq.heappop(heap)
        j = right[i]
        if not size[i] or j >= n or size[i] + size[j] != both:
            continue
        size[i], size[j], right[i] = both, 0, right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        offer(left[i])
    return [ranks[piece[i : i + size[i]]] for i in range(n) if size[i]]


class PieceCache(dict):
    """For a piece: its number of ids, the ids' digits joined by commas, and the bytes that they decode to."""

    def __init__(self, ranks: dict[bytes, int], room: int):
        super().__init__()
        self.ranks, self.room = ranks, room
        self.pieces = {v: k for k, v in ranks.items()}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = merge(piece.encode(), self.ranks)
        out = len(ids), ",".join(map(str, ids)), self.decode(ids)
        if len(piece) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = out
        return out


def encode(texts: list[str], cache: PieceCache) -> Iterator[list[tuple[int, str, bytes]]]:
    """The cached pieces of every text in turn; about a million code points are classified at a time."""
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= 1 << 20 or i == len(texts) - 1:
            for t, at in zip(group, boundaries(group), strict=True):
                at = at.tolist()
                yield [cache[t[a:b]] for a, b in zip(at, at[1:], strict=False)]
            group, size = [], 0


def bpe_round_trip(docs: DataFrame, path: str, cache_size: int = 200_000, ids: bool = False) -> DataFrame:
    """Encode every text by the rank file at `path` and decode the ids again.

    Returns `(doc_id, n_tokens, ids_sha256, decoded_sha256)`; with `ids`, also `ids` (array of int) and `offsets` (the
    byte at which each id's piece begins in the text). The pattern is that of this family of vocabularies (English
    contractions, letters, numbers, other signs, white space). cache_size bounds what a worker keeps. Null and empty
    texts have no tokens and the digests of nothing. Repeated rows and ids each give a row; a null doc_id stays null; other columns are
    dropped; an empty table gives an empty result. Very long pieces are merged with a heap, in n log n.
    """
    more = ", ids array<int>, offsets array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceCache(read_ranks(path), cache_size)
        for batch in small(batches):
            n, shas, back, lists, starts = [], [], [], [], []
            for pieces in encode(texts_of(batch), cache):
                n.append(sum(p[0] for p in pieces))
                joined = ",".join([p[1] for p in pieces])
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([p[2] for p in pieces])).hexdigest())
                if ids:
                    lists.append([int(x) for x in joined.split(",")] if joined else [])
                    size = np.cumsum([0, *(len(cache.pieces[i]) for i in lists[-1])])
                    starts.append(size[:-1].tolist())
            out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shas, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if ids:
                out |= {"ids": pa.array(lists, pa.list_(pa.int32())), "offsets": pa.array(starts, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """`(doc_id, text)` from rows with `doc_id` and `ids`; null ids give null, ids outside the file fail the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {v: k for k, v in read_ranks(path).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(map(pieces.__getitem__, x)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
