"""Token counts by a two-tier lookup inside the map tasks.

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens; tier two is a bounded cache in each
Python worker, filled by the tokenizer library for what the table lacks. No pre-token is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlog.llm.common import share_of, small, texts_of

#: How byte-level BPE of this family splits a text before the merges (fixed by the vocabulary file's pre-tokenizer).
#: White space is Unicode's White_Space property, as the library has it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def library(path: str):
    """The library's tokenizer for a .json or .model file, as a function from texts to token counts."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def specials(path: str) -> list[str]:
    """Special strings that the library finds inside texts by default."""
    from tokenizers import Tokenizer

    return [x.content for x in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


class WorkerCache(dict):
    """Lengths by pre-token: the broadcast tier, then what this worker has met. At most `room` entries are added."""

    def __init__(self, table: dict[str, int], count, room: int):
        super().__init__(table)
        self.frequent, self.count, self.room, self.left = table, count, room, room

    def __missing__(self, piece: str) -> int:
        n = self.count([piece])[0]
        if len(piece) <= 64:
            if self.left <= 0:
                self.clear()
                self.update(self.frequent)
                self.left = self.room
            self[piece] = n
            self.left -= 1
        return n


def frequent_lengths(docs: DataFrame, path: str, size: int, sample_docs: int) -> dict[str, int]:
    """The broadcast tier: the `size` commonest pre-tokens of about `sample_docs` documents, with their lengths.

    The sample decides speed alone: whatever the table lacks is encoded where it is met, so no count depends on it.
    """
    split = regex.compile(SPLIT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch):
                seen.update(split.findall(text))
        top = [(k, v) for k, v in seen.most_common(size) if len(k) <= 64]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in top], pa.string()), "n": pa.array([v for _, v in top], pa.int64())})

    share = min(1.0, sample_docs / max(docs.count(), 1))
    some = docs.where(share_of(share, "doc_id", "text"))
    rows = some.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()
    pieces = [r["piece"] for r in rows]
    return dict(zip(pieces, library(path)(pieces), strict=True)) if pieces else {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, table_size: int = 1 << 16, sample_docs: int = 4096, cache_size: int = 1 << 19) -> DataFrame:
    """`(doc_id, n_bytes, n_tokens, over_limit)` of every row of `docs`, as the vocabulary file's library counts.

    path: a .json (tokenizers) or .model (sentencepiece) file, the same on every executor. No begin, end or added special tokens;
    a special string inside a text counts as its one token. limit: over_limit is n_tokens > limit. table_size: entries of
    the broadcast table, which bounds it. cache_size: entries that a worker keeps beside them.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and repeated ids each give their own row; a null
    doc_id stays null; other columns are dropped. An empty table gives an empty result.
    .model files have no pre-tokens, so their texts go to the library whole.
    """
    spark: SparkSession = docs.sparkSession
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    pieces = path.endswith(".json")
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, table_size, sample_docs) if pieces else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = library(path)
        cache = WorkerCache(shared.value, count, cache_size)
        split = regex.compile(SPLIT)
        inside = specials(path) if pieces else []
        cut = regex.compile("|".join(map(regex.escape, sorted(inside, key=len, reverse=True)))) if inside else None

        def whole(text: str) -> int:
            if cut is None or not any(x in text for x in inside):
                return sum(map(cache.__getitem__, split.findall(text)))
            parts = cut.split(text)
            return len(parts) - 1 + sum(sum(map(cache.__getitem__, split.findall(p))) for p in parts)

        for batch in small(batches):
            texts = texts_of(batch)
            n = [whole(x) for x in texts] if pieces else count(texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, schema)
