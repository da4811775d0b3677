"""Spelling variants of a corpus's words: an asymmetric chunk join within one edit, and chains of ever more frequent forms.

Of two words the shorter one (the smaller one, if they are as long) contributes two disjoint chunks, its halves; the other one contributes its positional
grams. One edit leaves one of the halves as it is, and that half stands in the other word at the same place or, if the edit lies before it,
shifted by as much as the words differ in length, which is at most one. So only the grams that stand within that shift of a half can meet it.
Halves of short words are shared by thousands of words. The half that the edit did touch is therefore cut into two chunks once more,
by the same argument: one of them is left as it is. A key is the half and the quarter that are left, so a group holds words that
differ in one stretch of a quarter of their length, and pairs of a group are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlog.session import discard, written

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(docs: DataFrame, least: int = 7, rare: int = 31) -> DataFrame:
    """`(word, n)`: the words of at least `least` code points and how often they occur.

    Runs of letters are lower-cased; where `rare` divides the crc32 h of "doc_id:run", the run loses its code point h mod length, which seeds
    the misspellings. Occurrences are summed inside the tasks before they meet by word.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    shorter = F.concat(F.expr("left(run, int(h % length(run)))"), F.expr("substr(run, int(h % length(run)) + 2)"))
    word = found.withColumn("h", h).select(F.when(F.col("h") % rare == 0, shorter).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _cuts(length: Column) -> list[Column]:
    """The ends of the four quarters of a word: its halves, each cut in two."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def _key(word: Column, length: Column, quarter: int, shift: Column | int) -> Column:
    """What is left of a word of `length` if the edit lies in the quarter: the half without it and the other quarter of its half. Parts behind the
    edit stand `shift` further on in the partner."""
    cuts = _cuts(length)
    part = lambda a, b, by: F.substring(word, (cuts[a] + 1 + by).cast("int"), (cuts[b] - cuts[a]).cast("int"))
    half = (2, 4, shift) if quarter < 2 else (0, 2, F.lit(0))
    rest = quarter ^ 1
    other = (rest, rest + 1, shift if rest > quarter else F.lit(0))
    return F.struct(F.lit(quarter).alias("quarter"), F.xxhash64(length.cast("int"), part(*half), part(*other)).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """`(a, an, b, bn)`: all pairs of distinct `(word, n)` that differ by exactly one inserted, deleted or replaced code point, each once."""
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("an"), F.explode(F.array(*(_key(F.col("word"), size, q, F.lit(0)) for q in range(4)))).alias("k"))
    grams = [_key(F.col("word"), size - longer, q, F.lit(longer)) for longer in (0, 1) for q in range(4)]
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.explode(F.array(*grams)).alias("k"))
    met = chunks.join(grams, chunks["k"] == grams["k"])
    shorter = (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    near = met.where(shorter & (F.length("b") - F.length("a") <= 1) & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "an", "b", "bn").distinct()  # an edit in a run of one letter may lie in either of two quarters


def forms_of(words: DataFrame, pairs: DataFrame, times: int = 10) -> DataFrame:
    """`(word, n, n_near, form, form_n)` of every word: its near words are counted and the most frequent one (ties: the first in code-point order) is its
    form, if it occurs at least `times` as often."""
    both = pairs.selectExpr("a AS word", "an AS n", "b AS other", "bn AS other_n").union(pairs.selectExpr("b", "bn", "a", "an"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    chosen = best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))
    fits = F.col("form_n") >= times * F.col("n")
    return words.join(chosen, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))


def roots_of(forms: DataFrame) -> DataFrame:
    """`(word, root)` of every word that has a form: where its chain of forms ends. Every step multiplies the count, so chains are short and end; each
    round doubles what is followed."""
    at = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(at)
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10) -> DataFrame:
    """`(word, form, root, n, n_near, form_n)` of every word of `docs` with at least `least` code points and `occurrences` occurrences.

    n: occurrences in all texts; n_near: words that are one edit away; form: the most frequent of them (ties: the first in code-point order) if it
    occurs at least `times` as often, else null; form_n: how often that is; root: the end of the chain of forms, the word itself if it has none.

    Null and empty texts have no words. Repeated rows each count. A null doc_id counts as the empty text before the colon. Other columns are
    dropped; no words give no rows. `least` must be 4 at least, so that every quarter has a code point.
    """
    if least < 4:
        raise ValueError("words are cut into four parts: least must be 4 or more")
    words = written(words_of(docs, least).where(F.col("n") >= occurrences))
    forms = written(forms_of(words, near_pairs(words), times))
    discard(words)
    return forms.join(roots_of(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
