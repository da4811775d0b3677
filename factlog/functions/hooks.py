"""Hooks for models, with deterministic defaults: embedder, concept extractor, link proposer, frame proposer, summarizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.functions.values import concepts
from factlog.session import written

Embedder = Callable[[pd.Series], pd.Series]


def embed(df: DataFrame, model: Embedder | None = None, text: str = "text", dim: int = 64) -> DataFrame:
    """Add `embedding`. A model is a function on batches of texts and runs as an iterator pandas UDF; without one, a hashing
    vectorizer over the concept tokens: built-ins alone, signed buckets, unit length."""
    if model is not None:

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield model(batch)

        return df.withColumn("embedding", run(text))
    tokens = concepts(text)
    number = lambda t, at, n: F.conv(F.substring(F.md5(t.cast("binary")), at, n), 16, 10).cast("long")
    bucket = lambda t: (number(t, 1, 8) % dim).cast("int")
    sign = lambda t: F.when(number(t, 9, 1) % 2 == 0, 1.0).otherwise(-1.0)
    hashed = F.transform(tokens, lambda t: F.struct(bucket(t).alias("b"), sign(t).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter("__h", lambda h: h["b"] == i), F.lit(0.0), lambda acc, h: acc + h["s"]))
    norm = F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda acc, x: acc + x * x))
    # explode of one value: what it holds is computed once, where projections would be merged and compute it for every use
    df = df.withColumn("__h", F.explode(F.array(hashed)))
    df = df.withColumn("__raw", F.explode(F.array(raw)))
    unit = F.transform("__raw", lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(0.0).cast("float"))
    return df.withColumn("__norm", F.explode(F.array(norm))).withColumn("embedding", unit).drop("__h", "__raw", "__norm")


def extract_concepts(df: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, text: str = "text") -> DataFrame:
    """Add `concepts`; the default is the lexical extractor."""
    return df.withColumn("concepts", concepts(text) if model is None else F.pandas_udf(model, "array<string>")(text))


def propose_links(candidates: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """`(src, dst, type, confidence)` from candidates `(src, dst, cosine)`. A model is called per source (which has at most k
    candidates); the default proposes SIMILAR_TO with the cosine as confidence."""
    if model is None:
        return candidates.select("src", "dst", F.lit("SIMILAR_TO").alias("type"), F.col("cosine").alias("confidence"))
    return candidates.groupBy("src").applyInPandas(lambda pdf: model(pdf), "src string, dst string, type string, confidence double")


def propose_frames(members: DataFrame, kind: str = "Principle", top: int = 5) -> DataFrame:
    """U4: a deterministic proposal per community from `(community, id, body)`: its commonest concepts, and the member that has the
    most of them as the exemplar. Counts and ranks are aggregates; no community is gathered."""
    tokens = written(members.select("community", "id", F.explode(concepts("body")).alias("token")))  # read for the counts and for the exemplars
    n = tokens.groupBy("community", "token").agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "token"))).where(F.col("r") <= top)
    names = best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), " ").alias("name"))
    hits = tokens.join(best.select("community", "token"), ["community", "token"]).groupBy("community", "id").agg(F.count("*").alias("hits"))
    exemplar = hits.groupBy("community").agg(F.min_by("id", F.struct(-F.col("hits"), "id")).alias("exemplar"))
    out = names.join(exemplar, "community")
    slots = F.to_json(F.struct("name", F.concat(F.lit("about "), "name").alias("statement"), F.col("community").cast("string").alias("scope")))
    return out.select("community", F.lit(kind).alias("type"), slots.alias("slots"), F.array("exemplar").alias("exemplars"))


def summarize(members: DataFrame, model: Callable[[pd.Series], pd.Series] | None = None, top: int = 8) -> DataFrame:
    """`(community, summary)`; the default lists the concepts that most members share."""
    if model is not None:
        joined = members.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("body")), "\n").alias("text"))
        return joined.select("community", F.pandas_udf(model, "string")("text").alias("summary"))
    return propose_frames(members, top=top).select("community", F.get_json_object("slots", "$.name").alias("summary"))
