"""Exact self-join of documents by the Jaccard similarity of their word shingles, for corpora with large near-copy groups.

Sets are ordered by a hash of the shingle, and every step is exact:

1. Equal sets are one class.
2. A set that links with another shares at least a known share of the first half of its order with it. Shingles of
   those halves are counted in packed, sorted lists; a set too few of whose shingles occur elsewhere is skipped as a whole.
3. Of the rest, the frequency of every shingle is counted in the same way, and sets are indexed by the classic prefix, the
   rare shingles first. Lists are sorted by size and skipped in blocks by position: the place that a shingle has in its set bounds
   the size of any partner that first meets it there, and a list is broken wherever no such bound reaches on. What shares a
   block joins one candidate group. Only a spanning star of each block is emitted, never its pairs.
4. Inside a group, answers are derived from set relations: one set's overlaps are counted, and those of each set that is highly
   similar to it follow from them. Where the number of shingles in which the two differ already decides a link, nothing more is
   done; else the overlaps are mended by the lists of the differing shingles alone. Large groups are cut into blocks, so no task
   holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.llm.common import small, texts_of, without
from factlog.llm.packed import stretches
from factlog.operators.components import connected_components
from factlog.session import discard, partitions, written

CHUNK_DOCS, CHUNK_GRAMS = 8192, 1_000_000
GROUP_CHARS = 1 << 21  # code points of texts that are hashed together
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; a worker keeps at most 2**18."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[str], width: int, hashes: WordHashes) -> Iterator[tuple[np.ndarray, int]]:
    """Of every text the sorted distinct shingle hashes and the number of words. Words are split at ASCII white space and only A-Z is
    lower-cased, which is what bytes.split and bytes.lower do. Fewer words than `width`: the whole sequence is the one shingle."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= GROUP_CHARS or i + 1 == len(texts):
            words = [x.encode().lower().split() for x in texts[lo : i + 1]]
            counts = [len(w) for w in words]
            h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(counts))
            acc = np.zeros(max(0, len(h) - width + 1), np.uint64)
            for k in range(width):
                acc = acc * _P + h[k : len(acc) + k]
            acc = mix(acc + np.uint64(width))
            at = 0
            for n in counts:
                if n >= width:
                    yield distinct(acc[at : at + n - width + 1]), n
                elif n:
                    short = np.zeros(1, np.uint64)
                    for k in range(n):
                        short = short * _P + h[at + k]
                    yield mix(short + np.uint64(n)), n
                else:
                    yield np.zeros(0, np.uint64), 0
                at += n
            lo, size = i + 1, 0


def _split(mixed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket and a 32-bit place in it. Places that clash only make a shingle look shared: sets are kept, never lost."""
    x = (mixed >> np.uint64(20)) * np.uint64(buckets)
    return (x >> np.uint64(44)).astype(np.int32), ((x & np.uint64((1 << 44) - 1)) >> np.uint64(12)).astype(np.uint32)


def sorted_places(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the shingles by bucket and place, and both in that order (which is that of the mixed numbers)."""
    mixed = mix(grams * _P)
    order = np.argsort(mixed)
    return order, *_split(mixed[order], buckets)


def _pack(places: np.ndarray, owners: np.ndarray) -> bytes:
    planes = np.diff(places, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.compress(planes + owners.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    n = len(planes) // 6
    places = np.cumsum(np.ascontiguousarray(planes[: 4 * n].reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)
    return places, np.ascontiguousarray(planes[4 * n :].reshape(2, n).T).view("<u2").ravel()


def _sets(docs: DataFrame, width: int, buckets: int, carry: list[str]) -> DataFrame:
    """One row per document (its size and the 128-bit key of its set) and the packed lists of each chunk of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        task, seq = TaskContext.get().partitionId(), 0
        ids, keys, sizes, grams, counts, rest = [], [], [], [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            chunk = (task << 24) + seq
            flat = np.concatenate(grams)
            owner = np.repeat(np.arange(len(grams), dtype=np.uint16), [len(g) for g in grams])
            order, bucket, at = sorted_places(flat, buckets)
            owner = owner[order]
            lists = [*stretches(bucket)]
            n, m = len(ids), len(lists)
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk] * (n + m), pa.int64()),
                "bucket": pa.array([None] * n + [k for k, *_ in lists], pa.int32()),
                "packed": pa.array([None] * n + [_pack(at[x:y], owner[x:y]) for _, x, y in lists], pa.binary()),
                "idx": pa.array([*range(n)] + [None] * m, pa.int32()),
                "doc_id": pa.array(ids + [None] * m, pa.int64()),
                "n": pa.array(sizes + [None] * m, pa.int64()),
                "k1": pa.array([k[0] for k in keys] + [None] * m, pa.int64()),
                "k2": pa.array([k[1] for k in keys] + [None] * m, pa.int64()),
                "n_words": pa.array(counts + [None] * m, pa.int64()),
                **{c: pa.array([x[i] for x in rest] + [None] * m, pa.int64()) for i, c in enumerate(carry)},
            })

        for batch in small(batches):
            others = zip(*(batch.column(c).to_pylist() for c in carry), strict=True) if carry else repeat(())
            for doc_id, more, (s, words) in zip(batch.column("doc_id").to_pylist(), others, shingle_sets(texts_of(batch), width, hashes), strict=bool(carry)):
                raw = s.tobytes()
                ids.append(doc_id)
                counts.append(words)
                rest.append(more)
                sizes.append(len(s))
                keys.append(tuple(np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist()))
                grams.append(s[: len(s) // 2 + 1])
                held += len(grams[-1])
                if len(ids) >= CHUNK_DOCS or held >= CHUNK_GRAMS:
                    yield flush()
                    ids, keys, sizes, grams, counts, rest, held, seq = [], [], [], [], [], [], 0, seq + 1
        if ids:
            yield flush()

    schema = "chunk long, bucket int, packed binary, idx int, doc_id long, n long, k1 long, k2 long, n_words long"
    return docs.select("doc_id", "text", *carry).mapInArrow(run, schema + "".join(f", `{c}` long" for c in carry))


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key in turn, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if b <= a:
                continue
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _shared_counts(lists: DataFrame, buckets: int) -> DataFrame:
    """`(chunk, idx, hits)`: how many shingles of each document's first half occur in another document's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "bucket"):
            parts = [_unpack(x) for x in t.column("packed").to_pylist()]
            chunk = np.repeat(np.arange(len(parts)), [len(p) for p, _ in parts])
            at, owner = np.concatenate([p for p, _ in parts]), np.concatenate([o for _, o in parts]).astype(np.int64)
            order = np.argsort(at, kind="stable")
            same = at[order][1:] == at[order][:-1]
            shared = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            if not len(shared):
                continue
            code, n = np.unique(chunk[shared] << 16 | owner[shared], return_counts=True)
            names = t.column("chunk").to_numpy()
            which, first = np.unique(code >> 16, return_index=True)
            ends = [*first[1:], len(code)]
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(names[which], pa.int64()),
                "hits": pa.array([zstandard.compress((code[a:b] & 0xFFFF).astype("<u2").tobytes() + np.minimum(n[a:b], 65535).astype("<u2").tobytes(), 1) for a, b in zip(first, ends, strict=True)], pa.binary()),
            })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "chunk"):
            total = np.zeros(1 << 16, np.int64)
            for raw in t.column("hits").to_pylist():
                x = np.frombuffer(zstandard.decompress(raw), "<u2")
                total[x[: len(x) // 2]] += x[len(x) // 2 :]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(some), t.column("chunk")[0].as_py())), "idx": pa.array(some.astype(np.int32)), "hits": pa.array(total[some])})

    n = max(partitions(lists.sparkSession), min(buckets, 20_000))
    found = lists.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "chunk long, hits binary")
    return found.repartition(partitions(lists.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk long, idx int, hits long")


def _chunks(sets: DataFrame) -> DataFrame:
    """The sets of `(cid, grams)` by the chunk: ids, sizes, and all shingles in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw = batch.column("grams").to_pylist()
            ids, size = batch.column("cid").to_numpy(), np.array([len(x) // 8 for x in raw], np.int64)
            last = 0
            for i in range(len(raw)):
                if i + 1 == len(raw) or size[last : i + 2].sum() > 100_000:
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([(task << 24) + seq]), "ids": pa.array([ids[last : i + 1].tobytes()]), "sizes": pa.array([size[last : i + 1].tobytes()]), "grams": pa.array([b"".join(raw[last : i + 1])])})
                    last, seq = i + 1, seq + 1

    return sets.mapInArrow(run, "chunk long, ids binary, sizes binary, grams binary")


def _sorted_places(grams: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """How a chunk's shingles are sorted by bucket and place, the places, and `(bucket, begin, end)` of every bucket that has some."""
    order, bucket, at = sorted_places(np.frombuffer(grams, np.uint64), buckets)
    return order, at, [*stretches(bucket)]


def _frequencies(chunks: DataFrame, buckets: int) -> DataFrame:
    """`(chunk, bucket, df)`: in how many sets each shingle of the chunk occurs, in the order of `_sorted_places`."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, grams in zip(batch.column("chunk").to_pylist(), batch.column("grams").to_pylist(), strict=True):
                _, at, lists = _sorted_places(grams, buckets)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, *_ in lists], pa.int32()), "chunk": pa.array([chunk] * len(lists), pa.int64()), "places": pa.array([_pack(at[x:y], np.zeros(y - x, np.uint16)) for _, x, y in lists], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "bucket"):
            parts = [_unpack(x)[0] for x in t.column("places").to_pylist()]
            _, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            df = np.minimum(n, 65535).astype("<u2")[back]
            ends = np.cumsum([len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([t.column("chunk").combine_chunks(), t.column("bucket").combine_chunks(), pa.array([zstandard.compress(df[e - len(x) : e].tobytes(), 1) for e, x in zip(ends, parts, strict=True)], pa.binary())], ["chunk", "bucket", "df"])

    n = max(partitions(chunks.sparkSession), min(buckets, 20_000))
    return chunks.select("chunk", "grams").mapInArrow(ask, "bucket int, chunk long, places binary").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "chunk long, bucket int, df binary")


def _stars(chunks: DataFrame, buckets: int, percent: int) -> DataFrame:
    """`(src, dst)`: a star for every block of sets that have a prefix shingle in common and that their positions let meet.

    Shingles are ordered by their frequency, the rare first, so prefixes avoid what many sets have; sets of which too few
    shingles occur in any other set are skipped.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "chunk"):
            rows = {b: i for i, b in enumerate(t.column("bucket").to_pylist())}
            own = rows.pop(-1)
            ids, size = (np.frombuffer(t.column(c)[own].as_py(), np.int64) for c in ("ids", "sizes"))
            grams = t.column("grams")[own].as_py()
            order, _, lists = _sorted_places(grams, buckets)
            df = np.zeros(len(order), np.int64)
            for b, x, y in lists:
                i = rows[b]
                df[order[x:y]] = np.frombuffer(zstandard.decompress(t.column("df")[i].as_py()), "<u2")
            flat = np.frombuffer(grams, np.uint64)
            owner = np.repeat(np.arange(len(ids)), size)
            least = -(-percent * size // 100)
            shared = np.bincount(owner[df > 1], minlength=len(ids)) >= least
            by_rarity = np.lexsort((flat, df, owner))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            prefix = (rank < np.repeat(size - least + 1, size)) & np.repeat(shared, size) & (df[by_rarity] > 1)
            keep, rank = by_rarity[prefix], rank[prefix]
            sort, bucket, place_of = sorted_places(flat[keep], buckets)
            keep, rank = keep[sort], rank[sort]
            lists = [*stretches(bucket)]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, *_ in lists], pa.int32()),
                "places": pa.array([place_of[x:y].tobytes() for _, x, y in lists], pa.binary()),
                "ids": pa.array([ids[owner[keep[x:y]]].tobytes() for _, x, y in lists], pa.binary()),
                "sizes": pa.array([size[owner[keep[x:y]]].astype(np.int32).tobytes() for _, x, y in lists], pa.binary()),
                "ranks": pa.array([rank[x:y].astype(np.int32).tobytes() for _, x, y in lists], pa.binary()),
            })

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "bucket"):
            at, ids, size, rank = (np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()]) for c, kind in (("places", np.uint32), ("ids", np.int64), ("sizes", np.int32), ("ranks", np.int32)))
            order = np.lexsort((ids, size, at))
            at, ids, size, rank = at[order], ids[order], size[order].astype(np.int64), rank[order]
            # a partner that meets this set first here has at most size - rank shingles in common with it, and so at most this size
            reach = (size - rank) * (100 + percent) // percent - size
            number = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])]) << 40
            joined = np.maximum.accumulate(number + np.maximum(reach, 0))[:-1] >= (number + size)[1:]
            block = np.concatenate([[0], np.cumsum(~joined)])
            low = np.minimum.reduceat(ids, np.flatnonzero(np.concatenate([[True], ~joined])))[block]
            pairs = np.unique(np.stack([low, ids], 1)[low != ids], axis=0)
            yield pa.RecordBatch.from_pydict({"src": pa.array(pairs[:, 0]), "dst": pa.array(pairs[:, 1])})

    spark = chunks.sparkSession
    n = max(partitions(spark), min(buckets, 20_000))
    none = F.lit(None).cast("binary")
    own = chunks.select("chunk", F.lit(-1).alias("bucket"), "ids", "sizes", "grams", none.alias("df"))
    both = own.union(_frequencies(chunks, buckets).select("chunk", "bucket", none, none, none, "df"))
    lists = both.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(index, "bucket int, places binary, ids binary, sizes binary, ranks binary")
    return lists.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(link, "src long, dst long")


def _unchunked(chunks: DataFrame) -> DataFrame:
    """`(cid, grams)` again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, grams in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "grams")), strict=True):
                ends = np.cumsum(np.frombuffer(sizes, np.int64)) * 8
                yield pa.RecordBatch.from_pydict({"cid": pa.array(np.frombuffer(ids, np.int64)), "grams": pa.array([grams[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary())})

    return chunks.select("ids", "sizes", "grams").mapInArrow(run, "cid long, grams binary")


class Lists:
    """For every column (shingle) the rows that have it."""

    def __init__(self, column: np.ndarray, row: np.ndarray, columns: int, rows: int):
        order = np.argsort(column, kind="stable")
        self.rows, self.n = row[order], rows
        self.start = np.searchsorted(column[order], np.arange(columns + 1))

    def read(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all the columns in turn, and how many each has."""
        sizes = self.start[columns + 1] - self.start[columns]
        at = np.repeat(self.start[columns] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.rows[at], sizes

    def overlaps(self, columns: np.ndarray) -> np.ndarray:
        return np.bincount(self.read(columns)[0], minlength=self.n)


ALIKE = 4  # sets that differ in at most a fourth of a set's shingles have their answers derived from its


def links_within(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets in `a` link with which in `b` (None: with each other).

    A set's overlaps with all others are counted from the lists of its shingles. With them come the answers of the sets that are highly similar
    to it: such a set's overlap with any other lies between the counted one less what the set lacks and that plus what it adds.
    Where both ends say the same, the link is decided; for the others the overlaps are mended by the lists of the differing shingles.
    """
    every = a + (b or [])
    n, m, shift = len(a), len(b) if b is not None else len(a), len(a) if b is not None else 0
    sizes = np.array([len(x) for x in every], np.int64)
    row = np.repeat(np.arange(len(every)), sizes)
    gram, column = np.unique(np.concatenate(every), return_inverse=True)
    ends = np.cumsum(sizes)
    own = row < n
    mine = Lists(column[own], row[own], len(gram), n)
    theirs = mine if b is None else Lists(column[~own], row[~own] - shift, len(gram), m)
    size, other = sizes[:n], sizes[shift : shift + m]
    out, done = np.zeros((n, m), bool), np.zeros(n, bool)
    for x in np.argsort(size, kind="stable"):
        if done[x]:
            continue
        columns = column[ends[x] - size[x] : ends[x]]
        shared = mine.overlaps(columns)
        alike = ~done & (ALIKE * (size[x] + size - 2 * shared) <= size[x])
        alike[x] = True
        done |= alike
        counted = shared if b is None else theirs.overlaps(columns)
        some = np.flatnonzero(alike)
        for lo in range(0, len(some), step := max(1, 4_000_000 // max(m, int(size[x])))):
            part = some[lo : lo + step]
            need = -(-percent * (size[part, None] + other[None]) // (100 + percent))
            lacks, adds = (size[x] - shared[part])[:, None], (size[part] - shared[part])[:, None]
            out[part] = counted[None] - lacks >= need
            undecided = (counted[None] + adds >= need) & ~out[part]
            if undecided.any():
                rest = np.flatnonzero(undecided.any(axis=1))
                exact = counted[None] + _changes([column[ends[r] - size[r] : ends[r]] for r in part[rest]], columns, theirs)
                out[part[rest]] = exact >= need[rest]
    return out


def _changes(sets: list[np.ndarray], columns: np.ndarray, lists: Lists) -> np.ndarray:
    """What each of the sets' overlaps has more or less than those of the set with `columns`, by the lists of the columns that differ."""
    at = np.full(len(lists.start) - 1, -1, np.int64)
    at[columns] = np.arange(len(columns))
    who, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    inside = at[flat] >= 0
    has = np.zeros((len(sets), len(columns)), bool)
    has[who[inside], at[flat[inside]]] = True
    set_of, lacking = np.nonzero(~has)
    which = np.concatenate([who[~inside], set_of])
    column, sign = np.concatenate([flat[~inside], columns[lacking]]), np.concatenate([np.ones((~inside).sum()), -np.ones(len(lacking))])
    out = np.zeros(len(sets) * lists.n)
    lengths = np.cumsum(lists.start[column + 1] - lists.start[column])
    cuts = [0, *np.searchsorted(lengths, np.arange(4_000_000, lengths[-1] if len(lengths) else 0, 4_000_000)).tolist(), len(column)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        rows, sizes = lists.read(column[x:y])
        out += np.bincount(np.repeat(which[x:y], sizes) * lists.n + rows, np.repeat(sign[x:y], sizes), len(out))
    return out.reshape(len(sets), lists.n).round().astype(np.int64)


def local_components(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix reaches."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        np.minimum.at(new, label, new)
        if (new == label).all():
            return label
        label = new


def _verify(members: DataFrame, percent: int) -> DataFrame:
    """`(src, dst, n)`: for every class its links' weights (dst null), and a spanning star of each block's links (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "pair"):
            ids, copies, side = (t.column(c).to_numpy() for c in ("cid", "copies", "side"))
            order = np.lexsort((ids, side))
            ids, copies, side = ids[order], copies[order], side[order]
            raw = t.column("grams").to_pylist()
            grams = [np.frombuffer(raw[i], np.uint64) for i in order]
            n = int((side == 0).sum())
            both = n < len(ids)
            if len(ids) < 2 or not n:
                continue
            linked = links_within(grams[:n], grams[n:] if both else None, percent)
            whole = np.zeros((len(ids), len(ids)), bool)
            if both:
                whole[:n, n:], whole[n:, :n] = linked, linked.T
            else:
                whole[:] = linked
                np.fill_diagonal(whole, False)
            weight = whole @ copies.astype(np.float64)
            label = local_components(whole)
            some, star = np.flatnonzero(weight), np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_pydict({
                "src": pa.array(np.concatenate([ids[some], ids[star]])),
                "dst": pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[label[star]]]), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(star), bool)])),
                "n": pa.array(np.concatenate([weight[some].astype(np.int64), np.zeros(len(star), np.int64)]), mask=np.concatenate([np.zeros(len(some), bool), np.ones(len(star), bool)])),
            })

    return members.mapInArrow(run, "src long, dst long, n long")


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 75, carry: list[str] | None = None) -> DataFrame:
    """`(doc_id, n_shingles, component_id, n_links, n_words)` of every row of `docs`, and its columns `carry` (integers).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct `width`-word shingles (percent
    from 50 to 100).
    component_id is the smallest doc_id that is reachable by links, itself included; n_links counts the other rows that
    are linked directly. Null texts, empty ones and ones without words have no shingles, link with nothing and are their
    own component. Rows with a null doc_id link with nothing and have a null component. Repeated rows are copies of each
    other: each is returned, and each counts as a link of the others. An id
    that stands for several texts has the links and component of any of them. Other columns are dropped; no rows give no rows.
    """
    spark, more = docs.sparkSession, [f"__carry{i}" for i, _ in enumerate(carry or [])]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).cast("long").alias(m) for c, m in zip(carry or [], more, strict=True)))
    total = docs.count()
    buckets = min(1 << 18, max(64, -(-total // 2000)))  # a bucket and a place in it are cut out of 64 bits; 2**18 lists are enough for tasks of any corpus
    sets = written(_sets(docs, width, buckets, more))
    rows = sets.where("bucket IS NULL").select("chunk", "idx", "doc_id", "n", "k1", "k2", "n_words", *more)
    hits = _shared_counts(sets.where("bucket IS NOT NULL").select("chunk", "bucket", "packed"), buckets)
    # a linked set shares this much of its first half, whichever of the two halves ends first
    enough = F.greatest(F.lit(1), F.floor((percent / 100 - 0.5) * (percent / 100) * F.col("n")) - 1)
    marked = rows.where("doc_id IS NOT NULL AND n > 0").join(hits, ["chunk", "idx"], "left")
    classes = marked.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.max(F.coalesce("hits", F.lit(0)) >= enough).alias("likely"))
    classes = written(classes)

    likely = classes.where("likely").select(F.col("cid").alias("doc_id"), F.col("k1").alias("want"))
    if likely.count() <= 2_000_000:  # 32 MB at most; beyond that the texts are shuffled to the ids
        likely = F.broadcast(likely)
    chosen = docs.select("doc_id", "text").join(likely, "doc_id")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            raw = [x.tobytes() for x, _ in shingle_sets(texts_of(batch), width, hashes)]
            key = [np.frombuffer(xxhash.xxh3_128_digest(x), np.int64)[0] for x in raw]
            ok = [i for i, (k, w) in enumerate(zip(key, batch.column("want").to_pylist(), strict=True)) if k == w]  # an id may stand for several texts
            yield pa.RecordBatch.from_pydict({"cid": batch.column("doc_id").cast(pa.int64()).take(pa.array(ok, pa.int32())), "k1": pa.array([int(key[i]) for i in ok], pa.int64()), "grams": pa.array([raw[i] for i in ok], pa.binary())})

    got = chosen.mapInArrow(grams, "cid long, k1 long, grams binary")
    n, ids = rows.where("doc_id IS NOT NULL").agg(F.count("*"), F.countDistinct("doc_id")).first()
    got = got if n == ids else got.dropDuplicates(["cid", "k1"])
    chunks = written(_chunks(got.select("cid", "grams")))
    group = written(connected_components(_stars(chunks, buckets, percent).distinct()).select(F.col("id").alias("cid"), F.col("component").alias("grp")))
    sizes = group.groupBy("grp").agg(F.count("*").alias("size"))
    cells = F.ceil(F.col("size") / F.least(F.lit(2048), F.greatest(F.lit(256), F.ceil(F.col("size") / 16))))
    group = written(group.join(sizes, "grp").select("cid", "grp", cells.cast("int").alias("cells")))
    members = _unchunked(chunks).join(group.join(classes.groupBy("cid").agg(F.max("copies").alias("copies")), "cid"), "cid")
    mine = F.pmod(F.xxhash64("cid"), F.col("cells")).cast("int")
    members = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    members = members.select("cid", "copies", "grams", F.concat_ws(":", "grp", low, high).alias("pair"), (F.col("mine") != low).cast("int").alias("side"))
    members = members.repartition(partitions(spark), "pair").sortWithinPartitions("pair")
    found = written(_verify(members, percent))

    links = found.where("n IS NOT NULL").groupBy(F.col("src").alias("cid")).agg(F.sum("n").alias("links"))
    component = connected_components(found.where("dst IS NOT NULL")).select(F.col("id").alias("cid"), "component")
    classes = classes.join(component, "cid", "left").join(links, "cid", "left")
    classes = written(classes.select("k1", "k2", F.coalesce("component", "cid").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    discard(chunks, found)
    names = [F.col("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links", "n_words", *(F.col(m).alias(c) for c, m in zip(carry or [], more, strict=True))]
    linked = rows.where("doc_id IS NOT NULL AND n > 0").join(classes, ["k1", "k2"], "left").select(*names)
    alone = rows.where("doc_id IS NULL OR n = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long")).select(*names)
    return linked.union(alone)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of `docs`, with all their columns, less those whose component has a smaller doc_id.

    A document is its doc_id: if one row of an id is dropped, all are, and rows that repeat an id and its text are one. Rows with a null id stay.
    """
    found = ngram_join(docs, width, percent)
    n, ids, nulls = docs.agg(F.count("*"), F.countDistinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    kept = without(docs, found.where("component_id <> doc_id").select("doc_id").distinct())
    return kept if n - nulls == ids else kept.where("doc_id IS NULL").union(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
