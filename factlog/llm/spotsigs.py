"""Document fingerprints from spot signatures, in DataFrame functions alone.

A signature is a common word and the content words that follow it. A document's fingerprint is the sorted set of its
signatures' hashes; documents are compared by the Jaccard similarity of these sets. `near_documents` finds all near ones: sets are
partitioned by their length, so that only neighbouring partitions can hold partners, met through their rarest signatures, pruned by
size and position, and verified by Jaccard. `spot_fingerprints` makes the two comparisons that it is asked for, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.operators.components import connected_components
from factlog.session import written

#: Common words of English, German, French and Spanish, which anchor signatures.
ANCHORS = (
    "the of and to in a is that it was for on are as with be this by at from or an which not have but"
    " der die das und ist von den mit des ein eine nicht auf für im dem sich als zu auch"
    " le la les et est un une du dans que qui en pour pas sur par au avec ce"
    " el los las y es una del por con para su se lo no al como más"
).split()
CHAIN = 2  # content words in a chain
REACH = 4  # a chain is sought in the stretch that its anchor begins and the next three
MARK = "\u0001"


def fingerprints(docs: DataFrame, text: str, out: str, anchors: list[str] = ANCHORS) -> DataFrame:
    """Add `out`: the sorted set of the 32-bit hashes of the signatures of column `text`.

    Words are runs of letters and digits, lower-cased. A text without any signature gets one, the hash of its words, so
    equal texts always have equal fingerprints and texts of other words differ; null counts as the empty text.
    """
    words, stretches, tails = f"__{out}_words", f"__{out}_stretches", f"__{out}_tails"
    known = list(dict.fromkeys(anchors))
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    marked = F.transform(words, lambda w: F.when(w == "", w).when(w.isin(known), F.concat(F.lit(MARK), w, F.lit(" "))).otherwise(F.concat(w, F.lit(" "))))
    chain = lambda s, i: F.substring_index(F.array_join(F.slice(tails, i + 1, REACH), ""), " ", CHAIN)
    hashed = F.transform(stretches, lambda s, i: F.when((i > 0) & (chain(s, i) != ""), F.hash(F.substring_index(s, " ", 1), chain(s, i))))
    found = F.array_sort(F.array_distinct(F.filter(hashed, lambda h: h.isNotNull())))
    df = docs.withColumn(words, split).withColumn(stretches, F.split(F.array_join(marked, ""), MARK))
    df = df.withColumn(tails, F.transform(stretches, lambda s: s.substr(F.instr(s, " ") + 1, F.length(s))))
    df = df.withColumn(out, found).withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.hash(F.array_join(words, " ")))))
    return df.drop(words, stretches, tails)


def likeness(a: str, b: str, floor: float = 0.0) -> Column:
    """The Jaccard similarity of two fingerprints; 0 without a comparison if their sizes alone keep it under `floor`."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(F.col(a) == F.col(b), 1.0).when(low < floor * high, 0.0).otherwise(exact)


def near_documents(docs: DataFrame, floor: float = 0.75, rounds: int = 3) -> DataFrame:
    """`(doc_id, near_id)` of every row: the smallest doc_id that is reachable by links of at least `floor` between fingerprints.

    Equal fingerprints are one set. A set is listed under its rarest signatures, as many as any partner must share one of, in its partition of lengths and
    the next. First every list's members are compared with one member, drawn anew in each of `rounds`, which joins groups of near copies
    without their pairs; then the pairs of a list that are still in different groups are. Exact. Null texts count as empty; a null doc_id
    links with nothing and has a null near_id; rows that repeat an id share what any of them links with; no rows give no rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(near_ids(docs, floor, rounds), "doc_id", "left")


def near_ids(docs: DataFrame, floor: float = 0.75, rounds: int = 3) -> DataFrame:
    """`near_documents` with one row for every id that is not null."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = written(fingerprints(rows, "text", "own").select("doc_id", "own"))
    sets = written(own.groupBy("own").agg(F.min("doc_id").alias("cid")).withColumn("n", F.size("own")))
    each = sets.select("cid", "n", F.explode("own").alias("sig"))
    shared = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(shared, "sig", "left").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("by"))
    prefix = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.lit(floor) * F.col("n") - 1e-9).cast("int") + 1)
    listed = ranked.select("cid", "n", F.posexplode(prefix).alias("pos", "x")).where("x.df > 1")
    part = F.floor(F.log("n") / F.log(F.lit(1 / floor)) + 1e-9).cast("int")
    listed = listed.select("cid", "n", "pos", F.col("x.sig").alias("sig"), part.alias("own_part"), F.explode(F.array(part, part + 1)).alias("part"))
    lists = written(listed.withColumn("home", F.col("part") == F.col("own_part")).drop("own_part"))

    def kept(pairs: DataFrame) -> DataFrame:
        """Pairs `(a, n, pos, b, m, at)` that sizes and positions allow, and whose fingerprints are near."""
        least = F.lit(floor / (1 + floor)) * (F.col("n") + F.col("m")) - 1e-9
        some = pairs.where(F.col("a") != F.col("b")).where(F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"), "n", "m") >= least)
        some = some.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        some = some.join(sets.select(F.col("cid").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("own").alias("y")), "b")
        return some.where(likeness("x", "y", floor) >= floor - 1e-12).select("a", "b")

    one, other = lists.select(F.col("cid").alias("a"), "n", "pos", "sig", "part", "home"), ["b", "m", "at"]
    found = None
    for r in range(rounds):
        centre = lists.where("home").groupBy("sig", "part").agg(F.min_by(F.struct("cid", "n", "pos"), F.xxhash64("cid", F.lit(r))).alias("c"))
        star = one.join(centre, ["sig", "part"]).select("a", "n", "pos", *[F.col(f"c.{x}").alias(y) for x, y in zip(("cid", "n", "pos"), other, strict=True)])
        found = kept(star) if found is None else found.union(kept(star))
    found = written(found.distinct())
    group = written(connected_components(found, "a", "b").select(F.col("id").alias("cid"), F.col("component").alias("grp")))
    rest = lists.join(group, "cid", "left").withColumn("grp", F.coalesce("grp", "cid"))
    open_ = rest.groupBy("sig", "part").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("sig", "part")
    rest = written(rest.join(open_, ["sig", "part"]))
    x = rest.select(F.col("cid").alias("a"), "n", "pos", "sig", "part", F.col("home").alias("h"), F.col("grp").alias("g"))
    y = rest.where("home").select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), "sig", "part", F.col("grp").alias("k"))
    pairs = x.join(y, ["sig", "part"]).where((F.col("g") != F.col("k")) & (~F.col("h") | (F.col("a") < F.col("b"))))
    links = written(found.union(kept(pairs.select("a", "n", "pos", *other))))
    near = connected_components(links, "a", "b").select(F.col("id").alias("cid"), "component")
    named = sets.join(near, "cid", "left").select("own", F.coalesce("component", "cid").alias("near_id"))
    return written(own.join(named, "own").groupBy("doc_id").agg(F.min("near_id").alias("near_id")))


def with_next(docs: DataFrame, columns: list[str], bucket_rows: int = 128) -> DataFrame:
    """Add `next_<c>` for each of `columns`: the value of the next row by ascending doc_id, then text; after the last, the first.

    Rows are dealt into ranges of ids (bounds from approximate quantiles, at most 4096 numbers); each range also gets a copy
    of the first id's rows of the range that follows, so nothing is sorted as a whole: a range holds about `bucket_rows` rows, and from 4096 ranges
    on a 4096th of the table, which Spark sorts on disk where it must. Null ids come first.
    """
    n = docs.count()
    if n == 0:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns])
    k = int(min(4096, max(1, n // bucket_rows)))
    points = [i / k for i in range(1, k)]
    bounds = docs.select(F.percentile_approx("doc_id", points or [0.5], 16 * k).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds)) if points else []
    side = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + side] for i in range(0, len(bounds), side)] or [[]]
    coarse = F.array(*[F.lit(g[0]).cast("long") for g in groups if g]) if bounds else F.array().cast("array<long>")
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups]) if bounds else None
    if bounds:
        upto = F.size(F.filter(coarse, lambda b: b <= F.col("doc_id")))
        inside = F.size(F.filter(F.element_at(fine, F.greatest(upto, F.lit(1))), lambda b: b <= F.col("doc_id")))
        place = F.when(upto == 0, 0).otherwise((upto - 1) * side + inside)
    else:
        place = F.lit(0)
    df = docs.withColumn("__range", F.coalesce(place, F.lit(0)).cast("int"))
    firsts = sorted((r["__range"], r["low"], r["nulls"]) for r in df.groupBy("__range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect())
    before = {r: firsts[i - 1][0] for i, (r, *_) in enumerate(firsts)}
    low = {r: None if nulls else x for r, x, nulls in firsts}
    pairs = F.create_map(*[F.lit(x) for r in before for x in (r, before[r])])
    lows = F.create_map(*[x for r in low for x in (F.lit(r), F.lit(low[r]).cast("long"))])
    first = F.col("doc_id").eqNullSafe(F.element_at(lows, F.col("__range")))
    rows = F.when(first, F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("copy")), F.struct(F.element_at(pairs, F.col("__range")).alias("at"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("copy"))))
    df = df.withColumn("__to", F.explode(rows))
    order = Window.partitionBy("__to.at").orderBy("__to.copy", "doc_id", "text")
    df = df.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return df.where("__to.copy = 0").drop("__range", "__to")


def spot_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every row's whole text and its edited text, and compare.

    edited: the last floor(n_chars / 2) code points are replaced by as many (or all) of the next row's first. Returns
    `(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures)`; a fingerprint is its
    hashes in order, joined by commas. Null texts count as empty. Repeated rows and ids are rows like any other (the next
    of a repeated row is its repeat); a null doc_id comes first. Other columns are dropped; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(fingerprints(rows, "text", "own"), ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    df = fingerprints(df, "edited", "other")
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join(F.col("own").cast("array<string>"), ",").alias("fingerprint"),
        F.array_join(F.col("other").cast("array<string>"), ",").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
        F.size("own").cast("long").alias("n_signatures"),
    )
