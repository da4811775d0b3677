"""Retrieval evaluation, gate sweeps, run differences, latency percentiles."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.functions.values import col
from factlog.operators.recall import value_at
from factlog.session import written


def question_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """`(question, p1, p3, rr)` for every question with expected modules; hits `(question, rank, module)`, ranks from 1."""
    found = hits.join(expected.select("question", "module").distinct(), ["question", "module"]).groupBy("question").agg(F.min("rank").alias("best"))
    every = expected.select("question").distinct().join(found, "question", "left")
    hit = lambda k: F.when(F.col("best") <= k, 1.0).otherwise(0.0)
    return every.select("question", hit(1).alias("p1"), hit(3).alias("p3"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("rr"))


def run_metrics(per_question: DataFrame) -> DataFrame:
    """E1, averaged."""
    return per_question.agg(F.count("*").alias("scored"), F.avg("p1").alias("p_at_1"), F.avg("p3").alias("p_at_3"), F.avg("rr").alias("mrr"))


def agreement(tops: DataFrame) -> DataFrame:
    """Tops `(question, run, module)`, run 0 the primary: the share of rephrasings with the primary's top module."""
    first = tops.where("run = 0").select("question", F.col("module").alias("primary"))
    same = F.coalesce((F.col("module") == F.col("primary")) & (F.col("primary") != ""), F.lit(False))
    return tops.where("run > 0").join(first, "question", "left").groupBy("question").agg(F.avg(same.cast("double")).alias("agreement"))


def full_agreement(per_question: DataFrame) -> DataFrame:
    """E2, run level: only questions that agree fully count."""
    return per_question.agg(F.avg((F.col("agreement") == 1).cast("double")).alias("rephrasing_agreement"))


def negatives(hits: DataFrame, questions: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Whether no retrieval of a question that should find nothing has a top score at or over the threshold."""
    top = hits.where("rank = 1").groupBy("question").agg(F.max("score").alias("score"))
    return questions.join(top, "question", "left").select("question", F.coalesce(F.col("score") < threshold, F.lit(True)).alias("triggered"))


def keyword_score(answers: DataFrame, keywords: DataFrame, least: float = 0.6) -> DataFrame:
    """Answers `(question, body)` with lower-cased bodies joined; the share of `(question, keyword)` found, to two digits; EMPTY without results.

    A keyword counts if any body has it, which saves joining the bodies.
    """
    hit = answers.join(keywords, "question").groupBy("question", "keyword").agg(F.max(F.contains(F.lower("body"), F.lower("keyword"))).alias("hit"))
    some = answers.select("question").distinct().withColumn("some", F.lit(True))
    df = keywords.join(hit, ["question", "keyword"], "left").groupBy("question").agg(F.round(F.count_if("hit") / F.count("*"), 2).alias("score"))
    return df.join(some, "question", "left").select("question", F.when(F.col("some"), F.col("score")).otherwise(0.0).alias("score"), F.when(F.col("some").isNull(), "EMPTY").when(F.col("score") >= least, "PASS").otherwise("FAIL").alias("verdict"))


def module_path(body="body") -> Column:
    """E5."""
    return F.rtrim(F.regexp_extract(body, r"per-[a-z-]+:(\S+?)\s*\(", 1), F.lit("."))


def labelled_hits(dump: DataFrame) -> DataFrame:
    """`(question, sim, ppr, positive)` from questions with nested hits and expected modules; all-zero scores are an error."""
    dump = written(dump)  # read for the rows and for both checks
    df = dump.select("question", "expected", F.explode("hits").alias("h")).select("question", "h.sim", "h.ppr", F.array_contains("expected", F.col("h.module")).alias("positive"))
    if not dump.isEmpty() and df.where("sim <> 0 OR ppr <> 0").isEmpty():
        raise ValueError("the dump has no scores")
    return df


def grid(spark: SparkSession) -> DataFrame:
    """The points of the sweep, numbered in their order; strict > hard."""
    points = [p for p in product((0.30, 0.35, 0.40, 0.45), (0.50, 0.55, 0.60), (0.10, 0.15, 0.20), (0.40, 0.45, 0.50)) if p[1] > p[0]]
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point int, hard double, strict double, alpha double, composite double")


def f1(tp, fp, fn) -> Column:
    precision, recall = col(tp) / (col(tp) + col(fp)), col(tp) / (col(tp) + col(fn))
    return F.when(col(tp) > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def sweep(hits: DataFrame, points: DataFrame, sim_weight: float = 0.7, ppr_weight: float = 0.3) -> DataFrame:
    """F1 of every point; hits `(sim, ppr, positive)` meet each of the few points inside the scan's tasks."""
    kept = (F.col("sim") >= F.col("hard")) & ((F.col("sim") >= F.col("strict")) | (F.col("sim") >= F.col("hard") - F.col("alpha") * F.col("ppr"))) & (sim_weight * F.col("sim") + ppr_weight * F.col("ppr") >= F.col("composite"))
    df = hits.crossJoin(F.broadcast(points)).withColumn("kept", kept)
    by = df.groupBy("point", "hard", "strict", "alpha", "composite").agg(F.count_if(F.col("kept") & F.col("positive")).alias("tp"), F.count_if(F.col("kept") & ~F.col("positive")).alias("fp"), F.count_if(~F.col("kept") & F.col("positive")).alias("fn"))
    return by.withColumn("f1", f1("tp", "fp", "fn"))


def best_point(swept: DataFrame) -> DataFrame:
    """The first point of the best F1, and the F1 of the defaults."""
    default = F.max(F.when((F.col("hard") == 0.40) & (F.col("strict") == 0.55) & (F.col("alpha") == 0.15) & (F.col("composite") == 0.45), F.col("f1")))
    return swept.agg(F.max_by(F.struct("hard", "strict", "alpha", "composite", "f1"), F.struct("f1", -F.col("point"))).alias("b"), default.alias("baseline_f1"), F.count("*").alias("points")).select("b.*", "baseline_f1", "points")


def run_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """`(question, change)` of two runs' verdicts."""
    df = before.select("question", F.col("verdict").alias("v0")).join(after.select("question", F.col("verdict").alias("v1")), "question", "full_outer")
    change = F.when(F.col("v0").isNull(), "added").when(F.col("v1").isNull(), "removed").when(F.col("v0") == F.col("v1"), "unchanged").when(F.col("v1") == "FAIL", "new_fail").when(F.col("v0") == "FAIL", "resolved").otherwise("changed")
    return df.select("question", change.alias("change"))


def latency(samples: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """Nearest-rank percentiles of samples `(op, seconds)`: the value at ceil(p n) - 1; with budgets `(op, p95_budget)` also whether p95 keeps it.
    `value_at` finds the three values by ranges, so an operation with a third of all samples is no single task."""
    shares = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    sums = samples.groupBy("op").agg(F.count("*").alias("n"), (F.count("*") / F.sum("seconds")).alias("per_second"))
    place = {c: F.greatest(F.ceil(p * F.col("n")), F.lit(1)) - 1 for c, p in shares.items()}
    places = sums.select(F.col("op").alias("query_id"), F.array(*place.values()).alias("at"))
    found = value_at(samples.select(F.col("op").alias("query_id"), F.col("seconds").alias("value")), places).withColumnRenamed("query_id", "op")
    out = sums.join(found.select("op", "at", "value"), "op").groupBy("op", "n", "per_second").agg(*[F.max(F.when(F.col("at") == x, F.col("value"))).alias(c) for c, x in place.items()])
    out = out.select("op", "n", *shares, "per_second")
    return out if budgets is None else out.join(F.broadcast(budgets), "op", "left").withColumn("ok", F.col("p95") <= F.col("p95_budget"))
