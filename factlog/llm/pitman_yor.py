"""Language-model scoring by a hierarchical Pitman-Yor model of words.

The restaurants: one for single words over a uniform base, and above it one for every context word (the word before; the
text's end stands before its first word), with every word that follows it as a dish. Restaurants of all contexts share the parent: a
context's tables are the parent's customers. Tables are seated by Gibbs sweeps over the dishes of every context, each given the
parent's predictive probabilities; the seatings of the kept sweeps are averaged. All contexts and words are learned.

Texts become chunks: packed word hashes and the stream of their places. Pairs of words meet at the place of their hash, words at that
of theirs, so a frequent word, context or pair is one entry for each chunk and place, whatever its share of the corpus. A dish with one
customer has one table, so sweeps visit the others only. What a chunk asks for comes back in the order of its own lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.llm.common import small, texts_of, whole_texts
from factlog.llm.ngram_join import _P, mix
from factlog.llm.packed import ROW, at_places, batch_of, expand, merged, row, squeeze, stretches
from factlog.session import discard, partitions, written

END = b" "  # the end of a text: no word holds white space
CHUNK_TOKENS, CHUNK_DOCS = 1 << 20, 1 << 16
EXACT = 256  # customers of a dish up to which its tables' distribution is tabulated
BUCKET_TOKENS = 1 << 19  # tokens of the corpus for each place
CHUNK = "chunk long, ids array<long>, held array<boolean>, sizes array<long>, words binary, stream binary, tokens long"
_U64, _I32, _F64, _I64 = np.uint64, np.int32, np.float64, np.int64


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (as bytes.split and bytes.lower have it), then the end."""
    return [*text.encode().lower().split(), END]


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


@lru_cache(maxsize=8)
def seatings(d: float) -> np.ndarray:
    """The logarithm of the weight of all seatings of c customers at t tables, for c and t up to EXACT: generalised Stirling numbers."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        stay = out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300))
        out[c + 1, 1:] = np.logaddexp(stay, out[c, :-1])
        out[c + 1, c + 2 :] = -np.inf
    return out


def _exact(c: int, p: np.ndarray, a: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes that have c customers each, drawn from their exact distribution by the uniform numbers u."""
    fresh = np.cumsum(np.log(a[:, None] + d * np.arange(c)[None]), axis=1) + np.arange(1, c + 1)[None] * np.log(p)[:, None]
    w = fresh + seatings(d)[c, 1 : c + 1][None]
    w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
    return 1.0 + (w < u[:, None] * w[:, -1:]).sum(axis=1)


def seat(c: np.ndarray, p: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with `c` customers each, base probabilities `p` and `a` = strength + discount * tables of other dishes.

    Up to EXACT customers the tables are drawn from their exact distribution. Beyond, the weights of seatings follow, but for terms in
    1 / EXACT, a pure birth process of rate d in the logarithm of the customers: so the tables of the first EXACT customers are
    drawn with the base probability that the later ones leave, and the number of later tables is negative binomial.
    """
    p, a = np.asarray(p, float), np.broadcast_to(np.asarray(a, float), len(c))
    left = np.maximum((c - 0.5) / (EXACT - 0.5), 1.0) ** -d
    shrunk = p * left / (1 - p * (1 - left))
    out, u, first = np.ones(len(c)), rng.random(len(c)), np.minimum(c, EXACT)
    order = np.argsort(first, kind="stable")
    for customers, lo, hi in stretches(first[order]):
        if customers > 1:
            step = max(1, (1 << 21) // customers)
            for x in range(lo, hi, step):
                at = order[x : min(hi, x + step)]
                out[at] = _exact(customers, shrunk[at], a[at], d, u[at])
    large = np.flatnonzero(c > EXACT)
    if len(large):
        later = rng.negative_binomial(a[large] / d + out[large], 1 - p[large] * (1 - left[large]))
        out[large] = np.minimum(out[large] + later, c[large])
    return out


# --- chunks ---


class Numbers(dict):
    """Numbers words in the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def chunks_of(docs: DataFrame) -> DataFrame:
    """Texts `(doc_id, text, held_out)` as chunks: their ids and sizes, the sorted hashes of their words, and every token's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Numbers()
        ids, held, found = [], [], []
        size = 0

        def out() -> pa.RecordBatch:
            words, rank = np.unique(np.array([xxhash.xxh64_intdigest(w) for w in places], _U64), return_inverse=True)
            stream = rank[np.concatenate(found)]
            places.clear()
            sizes = [len(x) for x in found]
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([0], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "words": pa.array([squeeze(words)], pa.binary()), "stream": pa.array([squeeze(stream.astype(_I32))], pa.binary()), "tokens": pa.array([len(stream)], pa.int64()),
            })

        for batch in small(batches):
            for doc_id, hold, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("held_out").to_pylist(), texts_of(batch), strict=True):
                t = tokens(text)
                ids.append(doc_id)
                held.append(hold)
                found.append(np.fromiter(map(places.__getitem__, t), _I32, len(t)))
                size += len(t)
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield out()
                    ids, held, found, size = [], [], [], 0
        if ids:
            yield out()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, CHUNK).withColumn("chunk", F.monotonically_increasing_id())


class Chunk:
    """A chunk's words and, for every token, its word; `paired`: also its distinct pairs in the order of their places, and every token's pair."""

    def __init__(self, held: list[bool], sizes: list[int], words: bytes, stream: bytes):
        (self.words,), (self.stream,) = expand(words, _U64), expand(stream, _I32)
        self.held, self.sizes = np.array(held, bool), np.array(sizes, _I64)
        self.learned = np.repeat(~self.held, self.sizes)

    def paired(self, places: int) -> Chunk:
        end = np.searchsorted(self.words, _U64(xxhash.xxh64_intdigest(END)))
        before = np.concatenate([[end], self.stream[:-1]]).astype(_I64)  # every text ends with the end
        code, pair = np.unique(before * len(self.words) + self.stream, return_inverse=True)
        self.u, self.w = code // len(self.words), code % len(self.words)
        place = place_of(mix(self.words[self.u] * _P + self.words[self.w]), places)
        order = np.argsort(place, kind="stable")
        self.u, self.w, self.place = self.u[order], self.w[order], place[order]
        rank = np.empty(len(order), _I64)
        rank[order] = np.arange(len(order))
        self.pair = rank[pair]
        return self

    def counts(self, which: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(which[self.learned], minlength=n).astype(_I32)


def place_of(hashes: np.ndarray, places: int) -> np.ndarray:
    """Places by the first 32 bits, so that sorted hashes have sorted places."""
    return ((hashes >> _U64(32)) * _U64(places) >> _U64(32)).astype(_I64)


def short(hashes: np.ndarray) -> np.ndarray:
    """The first 40 bits, by which pairs know their words."""
    return hashes >> _U64(24)


def by_word(kind: str, of: int, places: int, keys: np.ndarray, *numbers: np.ndarray, bits: int = 40) -> list[tuple]:
    """Rows that take sorted keys and their numbers to the places of the words."""
    full = keys << _U64(64 - bits)
    return [row(kind, p, of, squeeze(keys[a:b], *(n[a:b] for n in numbers))) for p, a, b in stretches(place_of(full, places))]


def homes_of(places: int) -> int:
    """Places of words: fewer than those of pairs, with the square root of these, so that the lists between the two stay long."""
    return max(64, int(8 * places**0.5))


def summed_by(keys: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    some, back = np.unique(keys, return_inverse=True)
    return some, *(np.bincount(back, n, len(some)).astype(_I32) for n in numbers)


def _of_chunks(chunks: DataFrame, each) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, held, sizes, words, stream in zip(*(batch.column(c).to_pylist() for c in ("chunk", "held", "sizes", "words", "stream")), strict=True):
                if rows := each(name, Chunk(held, sizes, words, stream)):
                    yield batch_of(rows)

    return chunks.select("chunk", "held", "sizes", "words", "stream").mapInArrow(run, ROW)


# --- learning ---


def pair_lists(chunks: DataFrame, places: int) -> DataFrame:
    """Every chunk's distinct pairs, with their counts in its training texts, to the places of the pairs."""

    def each(name: int, c: Chunk) -> list[tuple]:
        c.paired(places)
        u, w, n = short(c.words)[c.u], short(c.words)[c.w], c.counts(c.pair, len(c.u))
        return [row("pairs", p, name, squeeze(u[a:b], w[a:b].view(_I64), n[a:b])) for p, a, b in stretches(c.place)]

    return _of_chunks(chunks, each)


def word_lists(chunks: DataFrame, places: int) -> DataFrame:
    """Every chunk's words, with their counts in its training texts, to the places of the words."""
    return _of_chunks(chunks, lambda name, c: by_word("words", name, homes_of(places), c.words, c.counts(c.stream, len(c.words)), bits=64))


def count_pairs(lists: DataFrame, tasks: int, places: int) -> DataFrame:
    """At every place of pairs: `state`, the dishes with more than one customer and their tables; `links`, for each chunk's pairs 0 (never seen), 1
    (seen once) or 2 + the number in `state`; and to the words: how many dishes, and how many with one customer, they have as
    contexts (`u`) and in how many contexts they are dishes (`w`). a, b of `state`: pairs seen once and twice."""

    def each(place: int, held) -> list[tuple]:
        parts = [(of, *expand(x, _U64, _I64, _I32)) for of, x in held["pairs"]]
        u, w, n = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        _, first, which = np.unique(mix(u * _P + w.view(_U64)), return_index=True, return_inverse=True)
        total = np.bincount(which, n).astype(_I64)
        by_context = np.argsort(u[first], kind="stable")
        which, total = np.argsort(by_context)[which], total[by_context]
        u, w = u[first][by_context], w.view(_U64)[first][by_context]
        many, known = total > 1, total > 0
        back = np.where(many, np.cumsum(many) + 1, known).astype(_I32)[which]
        ends = np.cumsum([len(p[1]) for p in parts])
        out = [row("links", place, p[0], squeeze(back[e - len(p[1]) : e])) for p, e in zip(parts, ends, strict=True)]
        one = (total == 1).astype(_I32)
        for kind, keys in (("u", u), ("w", w)):
            out += by_word(kind, place, homes_of(places), *summed_by(keys[known], known[known], one[known]))
        out.append(row("state", place, place, squeeze(u[many], w[many].view(_I64), total[many], np.ones(many.sum()), np.zeros(many.sum(), _I64)), float(one.sum()), float((total == 2).sum())))
        return out

    return at_places(lists, tasks, each)


_STATE = (_U64, _I64, _I64, _F64, _I64)  # u, w, customers, tables, sum of tables over the kept sweeps
_WORD = (_U64, _I64, _I64, _I64, _F64, _F64)  # hash, count, dishes and contexts with one customer, current share, weighted sum of probabilities


def count_words(rows: DataFrame, tasks: int) -> DataFrame:
    """`word` rows: at every place its training words. a, b: words in one and in two contexts; the sums `total` and `kinds` in `totals` rows."""

    def each(place: int, held) -> list[tuple]:
        keys, (n,), _ = merged([tuple(expand(x, _U64, _I32)) for _, x in held.get("words", [])] or [(np.zeros(0, _U64), np.zeros(0, _I32))])
        keys, n = keys[n > 0], n[n > 0].astype(_I64)
        ones = {}
        kinds = np.zeros(len(keys))
        for kind in ("u", "w"):
            ones[kind] = np.zeros(len(keys), _I64)
            if len(keys) and held.get(kind):
                some, (all_, one), _ = merged([tuple(expand(x, _U64, _I32, _I32)) for _, x in held[kind]])
                at = find(short(keys), some)
                ones[kind][at] = one
                if kind == "w":
                    kinds[at] = all_
        zero = np.zeros(len(keys))
        return [
            row("word", place, place, squeeze(keys, n, ones["u"], ones["w"], zero, zero), float((kinds == 1).sum()), float((kinds == 2).sum())),
            row("totals", place, place, b"", float(n.sum()), float(len(keys))),
        ]

    return at_places(rows, tasks, each)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted keys stand in the sorted keys, which hold them all."""
    return np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)


def customers_up(state: DataFrame, places: int, kept: bool = False) -> DataFrame:
    """The tables of every place's dishes, summed by context (`u`) and by word (`w`), to the places of the words. kept: the tables of all
    kept sweeps, by context alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, x in zip(batch.column("place").to_pylist(), batch.column("x").to_pylist(), strict=True):
                u, w, _, t, sums = expand(x, *_STATE)
                out = by_word("u", place, homes_of(places), *summed_by(u, sums if kept else t))
                out += [] if kept else by_word("w", place, homes_of(places), *summed_by(w.view(_U64), t))
                if out:
                    yield batch_of(out)

    return state.mapInArrow(run, ROW)


def sweep_words(rows: DataFrame, tasks: int, d: float, a: float, base: float, seed: int, last: tuple[float, float, float]) -> DataFrame:
    """The parent's part of a sweep: tables of every word given its customers. Answers the places that asked: the tables of their
    contexts (`U`), and their words' shares before scaling (`W`). last: weight, scale and floor of the sweep before, whose shares are
    added to the sums now. a, b of `word`: the place's customers and tables."""
    weight, scale, floor = last

    def each(place: int, held) -> list[tuple]:
        (_, raw), out = held["word"][0], []
        keys, n, ones_u, ones_w, share, sums = expand(raw, *_WORD)
        sums = sums + weight * (share * scale + floor)
        cut = short(keys)
        up, tables = np.zeros(len(keys), _I64), ones_u.copy()
        asked = {}
        for kind in ("u", "w"):
            asked[kind] = (np.zeros(0, _I64), [])
            if held.get(kind):
                some, (t,), each_at = merged([tuple(expand(x, _U64, _I32)) for _, x in held[kind]])
                at = find(cut, some)
                asked[kind] = (at, each_at)
                (tables if kind == "u" else up)[at] += t.astype(_I64)
        c = ones_w + up
        rng = np.random.default_rng([seed, place])
        t = seat(c, np.full(len(c), base), np.full(len(c), a), d, rng) if len(c) else np.zeros(0)
        share = c - d * t
        out.append(row("word", place, place, squeeze(keys, n, ones_u, ones_w, share, sums), float(c.sum()), float(t.sum())))
        for kind, values in (("u", tables.astype(_I32)), ("w", share.astype(np.float32))):
            at, each_at = asked[kind]
            out += [row(kind.upper(), of, place, squeeze(values[at[i]])) for (of, _), i in zip(held.get(kind, []), each_at, strict=True)]
        return out

    return at_places(rows, tasks, each)


def sweep_pairs(rows: DataFrame, tasks: int, d: float, strength: float, scale: float, floor: float, seed: int, kept: int) -> DataFrame:
    """The contexts' part of a sweep: new tables of every dish, given the parent's probabilities and the last tables of its restaurant."""

    def each(place: int, held) -> list[tuple]:
        if not held.get("state"):
            return []
        u, w, n, t, sums = expand(held["state"][0][1], *_STATE)
        if len(u):
            tables = np.concatenate([expand(x, _I32)[0] for _, x in held["U"]])[np.unique(u, return_inverse=True)[1]]
            share = np.concatenate([expand(x, np.float32)[0] for _, x in held["W"]])[np.unique(w.view(_U64), return_inverse=True)[1]]
            t = seat(n, share.astype(_F64) * scale + floor, strength + d * (tables - t), d, np.random.default_rng([seed, place]))
        return [row("state", place, place, squeeze(u, w, n, t, sums + kept * t.astype(_I64)))]

    return at_places(rows, tasks, each)


def learn(chunks: DataFrame, places: int, burn: int, keep: int, strength: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """The model: dishes `state` and `links`, `words`, and the figures that every score needs."""
    tasks = tasks_of(chunks, places)
    counted = written(count_pairs(pair_lists(chunks, places), tasks, places), by="kind")
    links, state = counted.where("kind = 'links'"), counted.where("kind = 'state'")
    old = written(count_words(word_lists(chunks, places).union(counted.where("kind IN ('u', 'w')")), tasks))
    discard(counted, parts=["kind=u", "kind=w"])
    words = old.where("kind = 'word'")
    sums = lambda df: df.agg(F.coalesce(F.sum("a"), F.lit(0.0)), F.coalesce(F.sum("b"), F.lit(0.0))).first()
    (total, kinds), d1, d2 = sums(old.where("kind = 'totals'")), discount_of(*sums(words)), discount_of(*sums(state))
    base, last, floors = 1 / (kinds + 1), (0.0, 0.0, 0.0), 0.0
    for sweep in range(burn + keep):
        kept = int(sweep >= burn)
        seated = written(sweep_words(customers_up(state, places).union(words), tasks, d1, strength + d1 * kinds, base, 2 * sweep, last))
        discard(old)
        old, words = seated, seated.where("kind = 'word'")
        customers, tables = sums(words)
        scale, floor = 1 / (strength + customers), (strength + d1 * tables) * base / (strength + customers)
        last = (kept / keep, scale, floor)
        floors += kept * floor / keep
        new = written(sweep_pairs(seated.where("kind IN ('U', 'W')").union(state), tasks, d2, strength, scale, floor, 2 * sweep + 1, kept))
        discard(state, parts=["kind=state"] if sweep == 0 else None)
        state = new
    figures = {"total": int(total), "kinds": int(kinds), "floor": floors, "d": d2, "strength": strength, "last": last, "keep": keep}
    return links, state, words, figures


def tasks_of(chunks: DataFrame, places: int) -> int:
    """Places are worked off one by one, so a task may have several."""
    return max(partitions(chunks.sparkSession), places // 16)


# --- scoring ---


def answered(links: DataFrame, state: DataFrame, words: DataFrame, chunks: DataFrame, places: int, figures: dict) -> DataFrame:
    """To every chunk: `pairs`, the customers and summed tables of its pairs, and `words`, the counts, shares and summed tables of its words."""
    tasks = tasks_of(chunks, places)
    weight, scale, floor = figures["last"]

    def of_pairs(place: int, held) -> list[tuple]:
        _, _, n, _, t = expand(held["state"][0][1], *_STATE)
        n, t = np.concatenate([[0, 1], n]), np.concatenate([[0, figures["keep"]], t])
        return [row("pairs", of, place, squeeze(n[i], t[i])) for of, x in held.get("links", []) for i in expand(x, _I32)]

    def of_words(place: int, held) -> list[tuple]:
        keys, c, ones, _, share, sums = expand(held["word"][0][1], *_WORD)
        tables = figures["keep"] * ones
        if held.get("u"):
            some, (t,), _ = merged([tuple(expand(x, _U64, _I32)) for _, x in held["u"]])
            tables[find(short(keys), some)] += t.astype(_I64)
        keys, c, tables = np.append(keys, _U64(0)), np.append(c, 0), np.append(tables, 0)
        p = np.append(sums + weight * (share * scale + floor), figures["floor"])
        out = []
        for of, x in held.get("ask", []):
            want = expand(x, _U64)[0]
            at = np.minimum(np.searchsorted(keys[:-1], want), len(keys) - 1)
            at = np.where(keys[at] == want, at, len(keys) - 1)
            out.append(row("words", of, place, squeeze(c[at], p[at], tables[at])))
        return out

    asks = _of_chunks(chunks, lambda name, c: by_word("ask", name, homes_of(places), c.words, bits=64))
    return at_places(links.union(state), tasks, of_pairs).union(at_places(asks.union(words).union(customers_up(state, places, kept=True)), tasks, of_words))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def scores_of(chunks: DataFrame, answers: DataFrame, places: int, figures: dict) -> DataFrame:
    spark = chunks.sparkSession
    none = F.lit(None)
    own = chunks.select("chunk", none.cast("string").alias("kind"), none.cast("long").alias("of"), none.cast("binary").alias("x"), "ids", "held", "sizes", "words", "stream")
    rest = answers.select(F.col("place").alias("chunk"), "kind", "of", "x", *[none.cast(own.schema[c].dataType).alias(c) for c in ("ids", "held", "sizes", "words", "stream")])

    def score(mine: dict, got: dict[str, list[tuple[int, bytes]]]) -> pa.RecordBatch:
        c = Chunk(mine["held"], mine["sizes"], mine["words"], mine["stream"]).paired(places)
        n, t = (np.concatenate(x) for x in zip(*(expand(x, _I64, _I64) for _, x in sorted(got["pairs"])), strict=True))
        count, p, tables = (np.concatenate(x) for x in zip(*(expand(x, _I64, _F64, _I64) for _, x in sorted(got["words"])), strict=True))
        keep, d, strength = figures["keep"], figures["d"], figures["strength"]
        guests = strength + count[c.u]
        lp = np.log10(np.maximum(n - d * t / keep, 0) / guests + (strength + d * tables[c.u] / keep) / guests * p[c.w])
        base = np.log10((count + 1) / (figures["total"] + figures["kinds"] + 1))
        starts = np.cumsum(c.sizes) - c.sizes
        of_docs = lambda x: np.add.reduceat(x, starts)
        total = of_docs(lp[c.pair])
        return pa.RecordBatch.from_arrays([
            pa.array(mine["ids"], pa.int64()), pa.array(c.held), pa.array(c.sizes), pa.array(of_docs((count > 0).astype(_I64)[c.stream])), pa.array(np.full(len(c.sizes), figures["total"], _I64)),
            pa.array(of_docs(base[c.stream])), pa.array(total), pa.array(10 ** np.minimum(-total / c.sizes, 300)),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, got = None, None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != now:
                    if mine:
                        yield score(mine, got)
                    now, mine, got = r["chunk"], None, {}
                if r["kind"] is None:
                    mine = r
                else:
                    got.setdefault(r["kind"], []).append((r["of"], r["x"]))
        if mine:
            yield score(mine, got)

    return own.union(rest).repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(run, SCORES)


def lm_scores(docs: DataFrame, held_out, burn: int = 1, keep: int = 3) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)` of every row's whole text.

    Tokens are words between ASCII white space with A-Z lower-cased, then one end. Learns from the rows that are not held out. base_score: the sum of
    log10((c + 1) / (N + V + 1)) with the training counts c, their sum N and their number V. score: the model's log10
    probability of the text, with all contexts and words of the training rows. burn and keep: the Gibbs sweeps.
    Null texts count as empty: one token. Repeated rows are each counted and returned; a null doc_id is not held out; other columns are dropped; no rows
    give no rows. If all rows are held out, every probability is that of the uniform base over one word. A very long text is a chunk of its own.
    """
    whole_texts(docs.sparkSession)
    chunks = written(chunks_of(docs.select("doc_id", "text", held_out.alias("held_out"))))
    n = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    places = max(64, -(-n // BUCKET_TOKENS))
    links, state, words, figures = learn(chunks, places, burn, keep)
    answers = written(answered(links, state, words, chunks, places, figures))
    discard(links, state, words)
    return scores_of(chunks, answers, places, figures)
