"""Language identification by interpolated Kneser-Ney character models, one for each language.

An n-gram of four code points is one 64-bit number, sixteen hashed bits for each. A model is a few sorted arrays of such
numbers with the discounted probabilities and the back-off weights beside them, looked up by binary search. All n-grams count, however
rare: discounts and continuation counts come from all of them. Models of up to ROOM n-grams are broadcast. Larger ones stay a
table that is dealt out by the hashes of the n-grams, and texts ask it for theirs, chunk by chunk; both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.llm.common import keep_rows, small, texts_of
from factlog.llm.ngram_join import mix
from factlog.llm.packed import ROW, at_places, batch_of, expand, row, squeeze, stretches
from factlog.session import discard, partitions, written

ORDER = 4
ROOM = 1 << 22  # n-grams of four, of all languages together, up to which the models are broadcast (about 150 MB)
EDGE = 1  # stands before the first code point
GROUP = 1 << 19  # code points that are handled at a time


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each code point of the lower-cased texts, and how many each text has."""
    texts = [x.lower() for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes + ORDER - 1)
    points = np.full(int(ends[-1]) if len(texts) else 0, EDGE, np.uint64)
    body = np.ones(len(points), bool)
    first = ends - sizes - ORDER + 1
    for k in range(ORDER - 1):
        body[first + k] = False
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[body] = (raw ^ (raw >> np.uint64(16)) * np.uint64(40503)) & np.uint64(0xFFFF)
    code = points[ORDER - 1 :]
    for back in range(1, ORDER):
        code = code | points[ORDER - 1 - back : len(points) - back] << np.uint64(16 * back)
    return code[body[ORDER - 1 :]], sizes


def groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about GROUP code points."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= GROUP or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def gram_counts(labelled: DataFrame) -> DataFrame:
    """`(lang, code, n)` over all texts of `(lang, text)`; summed in the map tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (codes, counts) in sorted(held.items()):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": pa.array(codes.view(np.int64)), "n": pa.array(counts)})

        for batch in small(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                codes, counts = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                for lo, hi in groups_of(texts):
                    c, n = np.unique(grams(texts[lo:hi])[0], return_counts=True)
                    codes, back = np.unique(np.concatenate([codes, c]), return_inverse=True)
                    counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)
                held[lang] = codes, counts
            if sum(len(c) for c, _ in held.values()) > 1_000_000:
                yield from out()
                held = {}
        yield from out()

    return labelled.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / max(1, ones + 2 * twos))) if ones else 0.5


class Model:
    """Interpolated Kneser-Ney over sorted arrays. Level k holds the (k+1)-grams; lower levels count distinct left neighbours."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = []
        for k in range(ORDER, 0, -1):
            d = discount(np.count_nonzero(counts == 1), np.count_nonzero(counts == 2))
            context, at = np.unique(codes >> np.uint64(16), return_inverse=True)
            total = np.bincount(at, counts)
            kinds = np.bincount(at)
            self.levels.append((codes, np.maximum(counts - d, 0) / total[at], context, d * kinds / total))
            shorter = codes & np.uint64((1 << 16 * (k - 1)) - 1)
            codes, counts = np.unique(shorter, return_counts=True)

    def log2(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / 65536)
        for k, (known, share, context, weight) in zip(range(1, ORDER + 1), reversed(self.levels), strict=True):
            part = codes & np.uint64((1 << 16 * k) - 1)
            before = part >> np.uint64(16)
            i = np.minimum(np.searchsorted(context, before), len(context) - 1)
            p = p * np.where(context[i] == before, weight[i], 1.0)
            i = np.minimum(np.searchsorted(known, part), len(known) - 1)
            p = p + np.where(known[i] == part, share[i], 0.0)
        return np.log2(p)


class Table:
    """Models too large to broadcast: `prices` rows `(place, x)` of packed `(key, language, value)`, for the shares of n-grams and the
    weights of contexts of every order."""

    def __init__(self, prices: DataFrame, names: list[str], places: int):
        self.prices, self.names, self.places = prices, names, places


def key_of(codes: np.ndarray, k: int, weight: bool) -> np.ndarray:
    """The key of a k-gram's share, or of the weight of a context of k - 1 code points."""
    return mix(codes ^ np.uint64((2 * k + weight) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def place_of(keys: np.ndarray, places: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)


def tabled(counts: DataFrame, names: list[str], places: int) -> Table:
    """The models as a table, from all `(lang, code, n)`. Every order is an aggregate of the one above."""
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")).cast("int") - 1
    level = counts.select(number.alias("lang"), "code", "n")
    parts = []
    for k in range(ORDER, 0, -1):
        level = written(level)
        context = F.shiftrightunsigned("code", 16)
        d = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()
        by = {r["lang"]: discount(r["ones"], r["twos"]) for r in d}
        each = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[F.col("lang")] if by else F.lit(0.5)
        sums = level.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        share = F.greatest(F.col("n") - each, F.lit(0.0)) / F.col("total")
        parts.append(level.withColumn("context", context).join(sums, ["lang", "context"]).select("lang", F.lit(k).alias("k"), F.lit(False).alias("weight"), "code", share.alias("value")))
        parts.append(sums.select("lang", F.lit(k), F.lit(True), "context", each * F.col("kinds") / F.col("total")))
        level = level.groupBy("lang", F.col("code").bitwiseAND((1 << 16 * (k - 1)) - 1).alias("code")).agg(F.count("*").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, k, weight, code, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "k", "weight", "code", "value"))
            keys = np.zeros(len(k), np.uint64)
            for order in np.unique(k):
                for w in (False, True):
                    some = (k == order) & (weight == w)
                    keys[some] = key_of(code[some].view(np.uint64), int(order), w)
            at = np.argsort(keys, kind="stable")
            keys, lang, value = keys[at], lang[at], value[at]
            if len(keys):
                yield batch_of([row("price", p, 0, squeeze(keys[x:y], lang[x:y], value[x:y])) for p, x, y in stretches(place_of(keys, places))])

    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return Table(written(out.mapInArrow(pack, ROW)), names, places)


def train(labelled: DataFrame, room: int = ROOM) -> dict[str, Model] | Table:
    """A model for each language of `(lang, text)`, from the counts of all rows. room: the most n-grams that are broadcast."""
    counts = written(gram_counts(labelled.where("lang IS NOT NULL AND text IS NOT NULL")))
    total = counts.count()
    if total > room:
        names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
        table = tabled(counts, names, max(64, total // (1 << 19)))
        discard(counts)
        return table
    kept = counts.toArrow()
    discard(counts)
    langs = np.array(kept.column("lang").to_pylist(), dtype=object)
    codes, n = kept.column("code").to_numpy().view(np.uint64), kept.column("n").to_numpy()
    out = {}
    for lang in sorted(set(langs)):
        mine = np.flatnonzero(langs == lang)
        mine = mine[np.argsort(codes[mine])]
        out[str(lang)] = Model(codes[mine], n[mine])
    return out


def entropies(texts: list[str], models: dict[str, Model]) -> np.ndarray:
    """Bits a code point of each text under each model; 0 for an empty text."""
    out = np.zeros((len(texts), len(models)))
    for lo, hi in groups_of(texts):
        codes, sizes = grams(texts[lo:hi])
        if not len(codes):
            continue
        kinds, back = np.unique(codes, return_inverse=True)
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        for j, model in enumerate(models.values()):
            out[lo + some, j] = -np.add.reduceat(model.log2(kinds)[back], starts) / sizes[some]
    return out


def bucket(n_chars):
    """Lengths are calibrated by powers of two."""
    return np.minimum(np.log2(np.maximum(n_chars, 1)).astype(int), 14)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


Limits = dict[str, list[float]]


def choose(bits: np.ndarray, names: list[str], sizes: np.ndarray, letters: np.ndarray, limits: Limits | None):
    """Per text, from its bits a code point under each model: language, score, least bits, and whether it is accepted."""
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(bits)), best]
    score = 1 / np.exp2(np.minimum(60, 8 * (bits - least[:, None])) * -1).sum(axis=1)
    known = letters & bool(names)
    lang = [names[j] if k else "und" for j, k in zip(best, known, strict=True)]
    high = np.array([limits[g][b] if limits and k else np.inf for g, b, k in zip(lang, bucket(sizes), known, strict=True)])
    return lang, np.where(known, score, 0.0), least, known & (least <= high)


def decide(texts: list[str], models: dict[str, Model], limits: Limits | None):
    names = [*models]
    bits = entropies(texts, models) if names else np.zeros((len(texts), 1))
    return choose(bits, names, np.array([len(x) for x in texts], np.int64), np.array([has_letter(x) for x in texts], bool), limits)


FOUND = "doc_id long, h long, held_out boolean, lang_pred string, score double, bits double, accepted boolean"


def identify(docs: DataFrame, models: dict[str, Model] | Table, limits: Limits | None = None) -> DataFrame:
    """Predict the language of every row's whole text; `h` is the text's hash. See `language_id` for the other columns."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text", "held_out")
    if isinstance(models, Table):
        return _asked(docs, models, limits)
    shared = docs.sparkSession.sparkContext.broadcast((models, limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield found_rows(batch.column("doc_id").cast(pa.int64()), batch.column("h"), batch.column("held_out"), decide(texts_of(batch), *shared.value))

    return docs.mapInArrow(run, FOUND)


def found_rows(ids, hashes, held, decision) -> pa.RecordBatch:
    lang, score, least, accepted = decision
    return pa.RecordBatch.from_arrays([ids, hashes, held, pa.array(lang, pa.string()), pa.array(score), pa.array(least), pa.array(accepted)], ["doc_id", "h", "held_out", "lang_pred", "score", "bits", "accepted"])


CHUNK = "chunk long, ids array<long>, hashes array<long>, held array<boolean>, letters array<boolean>, codes binary, stream binary, sizes array<long>"


def _asked(docs: DataFrame, table: Table, limits: Limits | None) -> DataFrame:
    """`identify` by a table: chunks of texts send the keys of their distinct n-grams to the keys' places and get the values of all languages."""
    names, places = table.names, table.places

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = texts_of(batch)
            for lo, hi in groups_of(texts):
                codes, sizes = grams(texts[lo:hi])
                kinds, stream = np.unique(codes, return_inverse=True)
                columns = [pa.array([batch.column(c)[lo:hi].to_pylist()], pa.list_(kind)) for c, kind in (("doc_id", pa.int64()), ("h", pa.int64()), ("held_out", pa.bool_()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int64()), *columns, pa.array([[has_letter(x) for x in texts[lo:hi]]], pa.list_(pa.bool_())), pa.array([squeeze(kinds)], pa.binary()), pa.array([squeeze(stream.astype(np.int32))], pa.binary()), pa.array([sizes.tolist()], pa.list_(pa.int64()))],
                    ["chunk", "ids", "hashes", "held", "letters", "codes", "stream", "sizes"],
                )

    def keys(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The chunk's sorted keys, and for shares and weights of every order where each n-gram's key stands."""
        every = []
        for k in range(1, ORDER + 1):
            part = codes & np.uint64((1 << 16 * k) - 1)
            every += [key_of(part, k, False), key_of(part >> np.uint64(16), k, True)]
        some, back = np.unique(np.concatenate(every), return_inverse=True)
        return some, list(back.reshape(2 * ORDER, len(codes)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("chunk").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                some, _ = keys(expand(raw, np.uint64)[0])
                if len(some):
                    yield batch_of([row("ask", p, name, squeeze(some[x:y])) for p, x, y in stretches(place_of(some, places))])

    def answer(place: int, held) -> list[tuple]:
        parts = [expand(x, np.uint64, np.int32, np.float64) for _, x in held.get("price", [])]
        kinds, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True) if parts else (np.zeros(0, np.uint64), None)
        values = np.full((len(kinds) + 1, len(names)), np.nan)
        if parts:
            values[back, np.concatenate([p[1] for p in parts])] = np.concatenate([p[2] for p in parts])
        out = []
        for of, x in held.get("ask", []):
            want = expand(x, np.uint64)[0]
            at = np.minimum(np.searchsorted(kinds, want), max(len(kinds) - 1, 0))
            at = np.where(kinds[at] == want, at, len(kinds)) if len(kinds) else np.zeros(len(want), np.int64)
            out.append(row("value", of, place, squeeze(*values[at].T)))
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, got = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != now:
                    if mine:
                        yield decided(mine, got)
                    now, mine, got = r["chunk"], None, []
                if r["x"] is None:
                    mine = r
                else:
                    got.append((r["of"], r["x"]))
        if mine:
            yield decided(mine, got)

    def decided(mine: dict, got: list[tuple[int, bytes]]) -> pa.RecordBatch:
        codes, stream, sizes = expand(mine["codes"], np.uint64)[0], expand(mine["stream"], np.int32)[0], np.array(mine["sizes"], np.int64)
        bits = np.zeros((len(sizes), len(names)))
        if len(codes):
            _, at = keys(codes)
            values = np.concatenate([np.stack(expand(x, *[np.float64] * len(names)), axis=1) for _, x in sorted(got)])
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            for j in range(len(names)):
                p = np.full(len(codes), 1 / 65536)
                for k in range(ORDER):
                    share, weight = values[at[2 * k], j], values[at[2 * k + 1], j]
                    p = p * np.where(np.isnan(weight), 1.0, weight)
                    p = p + np.where(np.isnan(share), 0.0, share)
                bits[some, j] = -np.add.reduceat(np.log2(p)[stream], starts) / sizes[some]
        return found_rows(pa.array(mine["ids"], pa.int64()), pa.array(mine["hashes"], pa.int64()), pa.array(mine["held"], pa.bool_()), choose(bits, names, sizes, np.array(mine["letters"], bool), limits))

    n = max(partitions(docs.sparkSession), places // 16)
    chunks = written(docs.mapInArrow(cut, CHUNK).withColumn("chunk", F.monotonically_increasing_id()))
    asks = chunks.select("chunk", "codes").mapInArrow(ask, ROW)
    answers = written(at_places(asks.union(table.prices), n, answer))
    none = F.lit(None)
    own = chunks.select("*", none.cast("long").alias("of"), none.cast("binary").alias("x"))
    rest = answers.select(F.col("place").alias("chunk"), *[none.cast(own.schema[c].dataType).alias(c) for c in chunks.columns[1:]], "of", "x")
    return own.union(rest).repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(score, FOUND)


def calibrate(labelled: DataFrame, models: dict[str, Model] | Table, rows: int | None, spread: float) -> Limits:
    """For each language and power of two of the length, the most bits a code point that are accepted: the mean of the training documents
    of that language and `spread` standard deviations, which are wider for short texts. A language that none of its own documents is taken for is held
    to the widest of the other limits. rows: None for all training documents, as the queries have it; a number for about as many of each language, by a hash."""
    counts = labelled.groupBy("lang").count().collect()  # one row for a language
    bound = F.lit(None).cast("long")
    for r in counts:
        if rows is not None and r["count"] > rows:
            bound = F.when(F.col("lang") == r["lang"], -(1 << 63) + int(rows / r["count"] * (1 << 64))).otherwise(bound)
    some = labelled.where(F.coalesce(F.xxhash64("doc_id", "text") < bound, F.lit(True))).withColumn("held_out", F.lit(False))
    found = identify(some, models).where("lang_pred <> 'und'").groupBy("lang_pred").agg(F.avg("bits").alias("mean"), F.coalesce(F.stddev_pop("bits"), F.lit(0.0)).alias("sd")).collect() if counts else []
    known = {r["lang_pred"]: (r["mean"], r["sd"]) for r in found}
    widest = (max((m for m, _ in known.values()), default=16.0), max((d for _, d in known.values()), default=0.0))
    out = {}
    for lang in names_of(models):
        mean, sd = known.get(lang, widest)
        # shorter texts vary more: a text of 2**b code points gets the spread of the sample widened by its length
        out[lang] = [float(min(16.0, mean + spread * max(sd, 0.25) * (1 + 16 / 2**b))) for b in range(15)]
    return out


def names_of(models: dict[str, Model] | Table) -> list[str]:
    return models.names if isinstance(models, Table) else [*models]


def learned(docs: DataFrame, held_out, room: int, calibration_rows: int | None, spread: float) -> tuple[dict[str, Model] | Table, Limits | None]:
    labelled = docs.select("doc_id", "text", "lang", held_out.alias("held_out")).where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")
    models = train(labelled, room)
    return models, calibrate(labelled, models, calibration_rows, spread) if names_of(models) else None


def language_id(docs: DataFrame, held_out, room: int = ROOM, calibration_rows: int | None = None, spread: float = 8.0) -> DataFrame:
    """`(doc_id, held_out, lang_pred, score, bits, accepted)` of every row.

    Learns from text and lang of rows that are not held out (`held_out`: a boolean column); predicts from the text alone.
    lang_pred has the fewest bits a code point (ties: the first by name); `und` if the text is null or empty or has no letter, or nothing
    could be learned. score: 0 to 1, how far the choice stands from the others; 0 for `und`. accepted: false for `und`, and
    for texts whose bits exceed what the training documents of the language lead to expect: all of them, or about `calibration_rows` of each
    language if a number is given. room: the most n-grams that are broadcast; no result depends on it. Repeated rows each count and each give a row; a null
    doc_id is not held out; other columns are dropped; an empty table gives an empty result.
    """
    models, limits = learned(docs, held_out, room, calibration_rows, spread)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), models, limits).drop("h")


def keep_known(docs: DataFrame, held_out, room: int = ROOM, calibration_rows: int | None = None, spread: float = 8.0) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is accepted; learned as in `language_id`.

    Null and empty texts and texts without a letter go. A text is accepted or not whatever its id, so repeated rows stay or go together; null ids
    are ids like any other; columns of any name pass through; no rows give no rows.
    """
    models, limits = learned(docs, held_out, room, calibration_rows, spread)
    if isinstance(models, Table):
        known = identify(docs.select("doc_id", "text", F.lit(False).alias("held_out")), models, limits).where("accepted").select("h").distinct()
        return docs.join(known, F.xxhash64(docs["text"]) == known["h"], "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast((models, limits))
    return keep_rows(docs, lambda batch: decide(texts_of(batch), *shared.value)[3])
