"""Subjects, retraction, contradictions; trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.functions.values import subject_error
from factlog.operators.recall import value_at

_row = lambda a, v, op="add": F.struct(F.lit(op).alias("op"), F.lit(a).alias("a"), v.cast("string").alias("v"))


def merge_facts(requests: DataFrame) -> DataFrame:
    """M1: `(a, b, actor)`: b becomes an alias of a. Three facts on b, or one row with the error."""
    blank = (F.coalesce(F.trim("a"), F.lit("")) == "") | (F.coalesce(F.trim("b"), F.lit("")) == "")
    error = F.when(blank, "BLANK_SUBJECT").when(F.col("a") == F.col("b"), "SAME_SUBJECT").otherwise(F.coalesce(subject_error("a"), subject_error("b")))
    facts = F.when(F.col("error").isNull(), F.array(_row("subject.alias_of", F.col("a")), _row("subject.canonical", F.col("a")), _row("subject.merge_actor", F.col("actor")))).otherwise(F.array(_row(None, F.lit(None))))
    return requests.withColumn("error", error).select(F.col("b").alias("e"), "error", F.inline(facts).alias("op", "attribute", "value"))


def contradictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """M2: facets `(pair, k, v, src)` that both sides of a pair have with different values, by pair and key."""
    right = b.select("pair", "k", F.col("v").alias("value_b"), F.col("src").alias("source_b"))
    return a.select("pair", "k", F.col("v").alias("value_a"), F.col("src").alias("source_a")).join(right, ["pair", "k"]).where("value_a <> value_b")


def contradiction_facts(found: DataFrame) -> DataFrame:
    """M2: five facts for each contradiction, on an entity named by its content, so that a retry writes the same."""
    e = F.concat(F.lit("contradiction:"), F.substring(F.sha2(F.concat_ws("\0", "pair", "k", "value_a", "value_b").cast("binary"), 256), 1, 26))
    rows = F.array(*[_row(f"contradiction.{n}", F.col(c)) for n, c in (("key", "k"), ("value_a", "value_a"), ("value_b", "value_b"), ("source_a", "source_a"), ("source_b", "source_b"))])
    return found.select(e.alias("e"), F.inline(rows))


def retract_facts(requests: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """M3, M4: `(e, reason, actor[, cascade])`: a retract of `exists`, the reason and the actor. With `cascade`, what a target is derived from
    goes too, once each, tagged with the target; the target's own rows stand first (step 0)."""
    direct = requests.select("e", "reason", "actor", F.lit(None).cast("string").alias("cascade_from"), F.lit(0).alias("step"))
    rows = direct
    if edges is not None:
        near = requests.where("cascade").join(edges.where("rel = 'DERIVED_FROM'").select(F.col("src").alias("e"), "dst"), "e")
        more = near.groupBy("dst").agg(F.min(F.struct("e", "reason", "actor")).alias("r")).select(F.col("dst").alias("e"), "r.reason", "r.actor", F.col("r.e").alias("cascade_from"), F.lit(1).alias("step"))
        rows = direct.union(more.join(direct.select("e"), "e", "left_anti"))
    facts = F.filter(F.array(_row("exists", F.lit("false"), "retract"), _row("retract.reason", F.col("reason")), _row("retract.actor", F.col("actor")), _row("retract.cascade_from", F.col("cascade_from"))), lambda r: r["v"].isNotNull())
    return rows.select("e", "step", F.inline(facts))


def escalations(found: DataFrame, frames: DataFrame, q: float = 0.9) -> DataFrame:
    """M5: contradicted frames `(frame_id)` that are cross-project or over the q-quantile of all frames' activation (between two values, by their distance).

    The quantile comes from the values at the two indices next to q (n - 1), which `value_at` finds by ranges: no task holds all values.
    """
    values = frames.where("activation IS NOT NULL").select(F.lit(0).alias("query_id"), F.col("activation").alias("value"))
    at = values.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", (F.lit(float(q)) * (F.col("n") - 1)).alias("at"))
    ends = value_at(values, at.select("query_id", F.array(F.floor("at"), F.ceil("at")).alias("at")))
    low, high, share = F.min("value"), F.max("value"), F.first("share")
    cut = ends.join(at.select("query_id", (F.col("at") - F.floor("at")).alias("share")), "query_id").agg((low + (high - low) * share).alias("cut"))
    return found.select("frame_id").distinct().join(frames, "frame_id").crossJoin(F.broadcast(cut)).where("cross_project OR activation > cut").select("frame_id", "cross_project", "activation")


def not_superseded(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """M6: entries that no other supersedes."""
    return entries.join(edges.where("rel = 'SUPERSEDES'").select(F.col("dst").alias("e")), "e", "left_anti")


def forget_project(entries: DataFrame, project: str) -> DataFrame:
    """M7: retraction requests for every live entry of a project; frames of other projects are no entries and stay."""
    return entries.where((F.col("project") == project) & ~F.col("retracted") & F.col("e").startswith("entry:")).select("e", F.lit("project forgotten").alias("reason"), F.lit("system").alias("actor"))


def open_contradictions(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """M8: frames with a contradiction `(frame_id, contradiction)` that is not resolved."""
    return found.join(resolved.select("contradiction"), "contradiction", "left_anti").select("frame_id").distinct()


def trail_facts(requests: DataFrame) -> DataFrame:
    """Begin `(trail, action, agent, name, at)` and end `(trail, action, at, summary)` as facts, or an error."""
    need = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = F.when(need("trail"), "MISSING_TRAIL_ID").when((F.col("action") == "begin") & need("agent"), "MISSING_AGENT").when((F.col("action") == "begin") & need("name"), "MISSING_NAME")
    begin = F.array(_row("kind", F.lit("trail")), _row("agent", F.col("agent")), _row("name", F.col("name")), _row("started_at", F.col("at")))
    end = F.array(_row("ended_at", F.col("at")), _row("summary", F.coalesce("summary", F.lit(""))))
    rows = F.when(F.col("error").isNotNull(), F.array(_row(None, F.lit(None)))).when(F.col("action") == "begin", begin).otherwise(end)
    return requests.withColumn("error", error).select("trail", "error", F.inline(rows).alias("op", "attribute", "value"))


def trail_attributes(facts: DataFrame) -> DataFrame:
    last = lambda a: F.coalesce(F.max_by(F.when(F.col("a") == a, F.col("v")), F.when(F.col("a") == a, F.col("tx"))), F.lit("")).alias(a)
    return facts.where("e LIKE 'trail:%'").groupBy(F.col("e").alias("trail")).agg(*[last(a) for a in ("agent", "name", "started_at", "ended_at", "summary")])


def trail_entries(facts: DataFrame) -> DataFrame:
    return facts.where("a = 'trail' AND op = 'add' AND e NOT LIKE 'trail:%'").select(F.col("v").alias("trail"), "e", "tx")


def trail(facts: DataFrame, name: str) -> DataFrame:
    """One trail's attributes and its entries by tx; no row if it is unknown."""
    entries = trail_entries(facts).where(F.col("trail") == name).groupBy("trail").agg(F.array_sort(F.collect_list(F.struct("tx", "e"))).alias("entries"))
    return trail_attributes(facts.where(F.col("e") == name)).join(entries, "trail", "left")


def trails(facts: DataFrame) -> DataFrame:
    """All trails with their numbers of entries: open ones first, then the last ended, then the last started."""
    n = trail_entries(facts).groupBy("trail").agg(F.count("*").alias("entries"))
    df = trail_attributes(facts).join(n, "trail", "full_outer").withColumn("entries", F.coalesce("entries", F.lit(0)))
    return df.orderBy(F.desc(F.coalesce(F.nullif("ended_at", F.lit("")), F.lit("~"))), F.desc_nulls_last("started_at"), "trail")


def ingest_trail(runs: DataFrame) -> DataFrame:
    """T4: the trail of an ingest run `(project, at, modules)`: begin and end at once."""
    name = F.concat_ws(":", F.lit("trail:ingest"), "project", "at")
    rows = F.array(_row("kind", F.lit("trail")), _row("agent", F.lit("ingest")), _row("name", F.concat(F.lit("ingest "), "project")), _row("started_at", F.col("at")), _row("ended_at", F.col("at")), _row("summary", F.concat(F.lit("ingested "), F.col("modules").cast("string"), F.lit(" modules"))))
    return runs.select(name.alias("e"), F.inline(rows))
