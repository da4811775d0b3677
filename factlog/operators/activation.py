"""Activation: state from the log, decay, visibility, scores, reinforcement, pins and evictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlog.functions.values import col, decayed

STATE_ATTRIBUTES = ["encoding_at", "base_activation", "retrieval_count", "last_retrieved_at", "evicted_at", "evicted_at_retracted", "pinned", "pin_activation"]


def state(facts: DataFrame) -> DataFrame:
    """A1: the activation state of every entity, folded in one aggregate; the last write of an attribute counts.

    evicted: evicted_at is later, as a string, than evicted_at_retracted; no retraction loses to any eviction.
    """
    value = F.regexp_replace("v", '^"|"$', "")  # JSON strings without their quotes
    text = lambda a: F.max_by(F.when(F.col("a") == a, value), F.when(F.col("a") == a, F.col("tx")))
    df = facts.where(F.col("a").isin(STATE_ATTRIBUTES) & (F.col("op") == "add")).groupBy("e").agg(*[text(a).alias(a) for a in STATE_ATTRIBUTES])
    return df.select(
        "e",
        F.to_timestamp("encoding_at").alias("encoding_at"),
        F.coalesce(F.col("base_activation").cast("double"), F.lit(0.0)).alias("base_activation"),
        F.coalesce(F.col("retrieval_count").cast("double").cast("long"), F.lit(0)).alias("retrieval_count"),
        F.to_timestamp("last_retrieved_at").alias("last_retrieved_at"),
        F.coalesce(F.col("evicted_at") > F.coalesce("evicted_at_retracted", F.lit("")), F.lit(False)).alias("evicted"),
        F.coalesce(F.col("pinned") == "true", F.lit(False)).alias("pinned"),
        F.coalesce(F.col("pin_activation").cast("double"), F.lit(0.0)).alias("pin_activation"),
    )


def age_seconds(now: Column) -> Column:
    """Seconds since the later of encoding and last retrieval, at least 0."""
    last = F.greatest("encoding_at", "last_retrieved_at")
    return F.greatest((F.unix_micros(now) - F.unix_micros(last)) / 1e6, F.lit(0.0))


def current(now: Column, exponent: float = 0.5) -> Column:
    """A2: decayed base; 0 when evicted; not below the pin value when pinned."""
    value = decayed("base_activation", F.coalesce(age_seconds(now), F.lit(0.0)), exponent)
    return F.when(F.col("evicted"), 0.0).when(F.col("pinned"), F.greatest(value, "pin_activation")).otherwise(value)


def visible(states: DataFrame, now: Column, threshold: float = 0.0005, exponent: float = 0.5) -> DataFrame:
    """A3: entities at or over the threshold that are not evicted."""
    return states.withColumn("activation", current(now, exponent)).where(~F.col("evicted") & (F.col("activation") >= threshold))


def base_level(events: DataFrame, now: Column, exponent: float = 0.5) -> DataFrame:
    """A4: ln of the sum of age^-d over an entity's events `(e, at)`; an age of 0 or less counts as 1e-9 s."""
    age = (F.unix_micros(now) - F.unix_micros("at")) / 1e6
    return events.groupBy("e").agg(F.log(F.sum(F.pow(F.when(age > 0, age).otherwise(1e-9), F.lit(-exponent)))).alias("base_level"))


def importance(facet_boost, cross_project) -> Column:
    """A5."""
    return F.coalesce(col(facet_boost), F.lit(0.0)) + F.when(col(cross_project), 0.20).otherwise(0.0)


def composite(base, ppr, sim, imp, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.3, 0.1)) -> Column:
    """A6."""
    return sum((F.lit(w) * col(c) for w, c in zip(weights[1:], (ppr, sim, imp), strict=True)), F.lit(weights[0]) * col(base))


def seed(request) -> Column:
    """The base activation of a new entry: the request's value if it lies in (0, 1], else 1."""
    return F.when((col(request) > 0) & (col(request) <= 1), col(request)).otherwise(1.0)


def reinforce(states: DataFrame, surfaced: DataFrame, now: Column) -> DataFrame:
    """Three facts for every surfaced entity that is not evicted: base 1, the count raised by the times it surfaced, now."""
    times = surfaced.groupBy("e").agg(F.count("*").alias("times"))
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = F.array(
        F.struct(F.lit("base_activation").alias("a"), F.lit("1").alias("v")),
        F.struct(F.lit("retrieval_count").alias("a"), (F.col("retrieval_count") + F.col("times")).cast("string").alias("v")),
        F.struct(F.lit("last_retrieved_at").alias("a"), F.concat(F.lit('"'), stamp, F.lit('"')).alias("v")),
    )
    return states.where(~F.col("evicted")).join(times, "e").select("e", F.inline(rows))


def lifecycle(states: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """`(e, action)` with action pin, unpin, evict or unevict, set by set: facts `(e, a, v, status)`.

    A pin keeps the current decayed value and lifts an eviction in the same step; what changes nothing gives one row with
    a null attribute and the reason; an unknown entity gives ENTRY_NOT_FOUND.
    """
    stamp = F.concat(F.lit('"'), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"'))
    # pinning an evicted entry lifts the eviction first, so its value is read as if it were not evicted
    lifted = decayed("base_activation", F.coalesce(age_seconds(now), F.lit(0.0)))
    df = requests.join(states.withColumn("found", F.lit(True)), "e", "left")
    status = (
        F.when(F.col("found").isNull(), "ENTRY_NOT_FOUND")
        .when((F.col("action") == "pin") & F.col("pinned") & ~F.col("evicted"), "ALREADY_PINNED")
        .when((F.col("action") == "unpin") & ~F.col("pinned"), "NOT_PINNED")
        .when((F.col("action") == "evict") & F.col("evicted"), "ALREADY_EVICTED")
        .when((F.col("action") == "unevict") & ~F.col("evicted"), "NOT_EVICTED")
        .otherwise("OK")
    )
    row = lambda a, v: F.struct(F.lit(a).alias("a"), v.cast("string").alias("v"))
    pin = [row("pinned", F.lit("true")), row("pin_activation", lifted)]
    facts = (
        F.when(F.col("status") != "OK", F.array(row(None, F.lit(None))))
        .when((F.col("action") == "pin") & F.col("evicted"), F.array(*pin, row("evicted_at_retracted", stamp)))
        .when(F.col("action") == "pin", F.array(*pin))
        .when(F.col("action") == "unpin", F.array(row("pinned", F.lit("false"))))
        .when(F.col("action") == "evict", F.array(row("base_activation", F.lit("0")), row("evicted_at", stamp)))
        .otherwise(F.array(row("evicted_at_retracted", stamp)))
    )
    return df.withColumn("status", status).select("e", "action", "status", F.inline(facts))
