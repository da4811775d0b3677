"""Quality rules of documents and of their hosts: failures are summed by host, rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.llm.common import map_batches, texts_of
from factlog.session import written

SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
GROUP_CHARS = 1 << 21  # code points of texts that are measured together
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: What a document can fail, by its measures. The first two are failures of the document itself, the others count for its host alone.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)",
}
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def repeated(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """How many words of every text stand in a window of three that its text has twice or more. words: their numbers; text: whose they are, ascending."""
    out = np.zeros(texts, np.int64)
    if len(words) < 4:
        return out
    whole = text[2:] == text[:-2]
    # exact: windows are ranked by the rank of their first two words and the third, then by that rank and the text
    rank = np.unique(words[:-2] << 32 | words[1:-1], return_inverse=True)[1]
    rank = np.unique(rank << 32 | words[2:], return_inverse=True)[1]
    _, back, n = np.unique(rank << 32 | text[2:], return_inverse=True, return_counts=True)
    hit = whole & (np.bincount(back, whole, len(n))[back] > 1)
    in_window = np.zeros(len(words), bool)
    for k in range(3):
        in_window[k : len(words) - 2 + k] |= hit
    return out + np.bincount(text[in_window], minlength=texts)


def measure(texts: list[str]) -> list[np.ndarray]:
    """The columns of MEASURES for every text."""
    out = np.zeros((6, len(texts)), np.int64)
    lo, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size < GROUP_CHARS and i + 1 < len(texts):
            continue
        raws = [t.encode() for t in texts[lo : i + 1]]
        words = [r.split() for r in raws]
        sizes = np.array([len(w) for w in words], np.int64)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        out[0, lo : i + 1] = sizes
        out[4, lo : i + 1] = repeated(flat, np.repeat(np.arange(len(raws)), sizes), len(raws))
        for k, (t, raw) in enumerate(zip(texts[lo : i + 1], raws, strict=True), lo):
            out[1, k] = len(t) - (len(raw) - len(raw.translate(None, SPACE)))
            out[2, k] = len(raw) - len(raw.translate(None, SYMBOLS))
            lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
            out[3, k], out[5, k] = len(lines) - len(set(lines)), len(lines)
        lo, size = i + 1, 0
    return [*out]


def measured(docs: DataFrame) -> DataFrame:
    """`(doc_id, source, MEASURES)` of every row's whole text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(c) for c in measure(texts_of(batch))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *columns], ["doc_id", "source", *(x.split()[0] for x in MEASURES.split(", "))])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"), each, f"doc_id long, source string, {MEASURES}")


def host_rates(rows: DataFrame) -> DataFrame:
    """`(source, rule, n, failed, prior_rate, prior_weight, rate)` of every host and rule.

    The prior of a rule is a beta distribution fitted to the hosts by moments: its mean is the share of all documents that fail, its weight
    (alpha + beta) follows from how much more the hosts' rates differ than chance would let them. rate is the host's mean after its own documents are
    added: (failed + weight * mean) / (n + weight). Counts are summed inside the tasks before they meet by host, so a host with a third of
    all rows is a few rows in the shuffle; the prior is a sum over the hosts, again by tasks. Documents without a source are of no host.
    """
    sums = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    hosts = rows.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"), *sums)
    long = f"stack({len(RULES)}, " + ", ".join(f"'{r}', {r}" for r in RULES) + ") AS (rule, failed)"
    hosts = hosts.selectExpr("source", "n", long)
    square = F.col("failed").cast("double") * F.col("failed") / F.col("n")
    sums = hosts.groupBy("rule").agg(F.count("*").alias("k"), F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(square).alias("f2"))
    mean = F.col("all_failed") / F.col("all_n")
    spread = F.col("f2") - F.col("all_failed") * mean  # of the rates, weighted by the hosts' documents
    free, room = F.col("k") - 1, F.col("all_n") - F.col("n2") / F.col("all_n") - (F.col("k") - 1)
    # the share of the variance that lies between the hosts, within bounds: the prior weighs 10 to 99 documents
    share = F.greatest(F.lit(0.01), F.least(F.lit(1 / 11), F.coalesce((F.try_divide(spread, mean * (1 - mean)) - free) / F.when(room > 0, room), F.lit(0.0))))
    prior = sums.select("rule", mean.alias("prior_rate"), (1 / share - 1).alias("prior_weight"))
    rate = (F.col("failed") + F.col("prior_weight") * F.col("prior_rate")) / (F.col("n") + F.col("prior_weight"))
    return hosts.join(F.broadcast(prior), "rule").select("source", "rule", "n", "failed", "prior_rate", "prior_weight", rate.alias("rate"))


def bad_hosts(rates: DataFrame, most: float = 0.5, times: float = 2.0) -> DataFrame:
    """`(source, rules)`: hosts where some rule's shrunk rate is over `most` and over `times` its prior's mean, and which rules."""
    over = rates.where((F.col("rate") > most) & (F.col("rate") > times * F.col("prior_rate")))
    return over.groupBy("source").agg(F.array_sort(F.collect_set("rule")).alias("rules"))  # at most one entry a rule


def host_rules(docs: DataFrame, most: float = 0.5, times: float = 2.0) -> DataFrame:
    """`(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rules, kept)` of every row.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. host_rules: the rules of which the document's host is
    found guilty (`bad_hosts`), null if of none. kept: neither the document nor its host failed. A host is guilty if it, its few documents
    shrunk towards the others, fails a rule in more than `most` of its documents and more than `times` as often as all documents
    do; a table whose hosts are alike thus condemns none of them, and neither does one with a single host.

    Null and empty texts have no words and fail. Rows with a null source belong to no host: their own failures decide. Repeated rows each count and each
    give a row; a null doc_id is an id like any other; other columns are dropped; no rows give no rows.
    """
    rows = written(measured(docs))
    bad = written(bad_hosts(host_rates(rows), most, times))
    if bad.count() <= 500_000:  # a few dozen MB of names
        joined = rows.join(F.broadcast(bad), "source", "left")
    else:  # a host's rows are dealt over 64 keys, and so is each verdict
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(64)).cast("int")).join(salted, ["source", "salt"], "left")
    failed = F.expr(FAILED)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.col("rules").alias("host_rules"), (~failed & F.col("rules").isNull()).alias("kept"))
