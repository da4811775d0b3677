"""Promotion of clusters to frames within and across projects, briefs of communities, frame schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.functions.constants import FRAME_SCHEMAS
from factlog.operators.graph import fingerprints


def reflect_candidates(members: DataFrame, cohesion: DataFrame, cursor: str | None, scope: DataFrame | None = None) -> DataFrame:
    """communities with a member after the cursor: size, distinct UTC days, cohesion, youngest tx.

    members: `(community, id, last_tx, ts)`; scope: the `id`s of one trail, if only its entries count.
    """
    m = members if scope is None else members.join(scope.select("id").distinct(), "id", "left_semi")
    fresh = F.max("last_tx") > cursor if cursor is not None else F.lit(True)
    by = m.groupBy("community").agg(F.count("*").alias("size"), F.countDistinct(F.to_date("ts")).alias("days"), F.max("last_tx").alias("youngest"), fresh.alias("fresh"))
    return by.where("fresh").drop("fresh").join(cohesion.select("community", "avg_cosine", "mdl_ratio"), "community", "left")


def reflect_reason(proposed: Column | None = None, size: int = 3, days: int = 2, cosine: float = 0.65, mdl: float = 1.3) -> Column:
    """the first threshold that a cluster misses, or ACCEPTED."""
    out = F.when(F.col("size") < size, "TOO_SMALL").when(F.col("days") < days, "TOO_FEW_DAYS").when(F.coalesce("avg_cosine", F.lit(0.0)) < cosine, "LOW_COSINE").when(F.coalesce("mdl_ratio", F.lit(1.0)) < mdl, "LOW_MDL")
    return (out if proposed is None else out.when(~proposed, "NOT_PROPOSED")).otherwise("ACCEPTED")


def reflect(candidates: DataFrame, **limits) -> DataFrame:
    """the decisions, which is the whole of a dry run."""
    return candidates.withColumn("reason", reflect_reason(**limits))


def frame_facts(frames: DataFrame) -> DataFrame:
    """facts of frames `(frame_id, tx, type, slots, schema_version, exemplars[, importance, cross_project])`, one tx a frame."""
    row = lambda a, v: F.struct(F.lit(a).alias("a"), v.alias("v"))
    fixed = [row("frame.type", F.col("type")), row("frame.slots", F.col("slots")), row("frame.schema_version", F.col("schema_version").cast("string"))]
    if "cross_project" in frames.columns:
        fixed += [row("frame.cross_project", F.col("cross_project").cast("string")), row("frame.importance", F.col("importance").cast("string"))]
    derived = F.transform(F.array_sort("exemplars"), lambda x: F.struct(F.lit("DERIVED_FROM").alias("a"), x.alias("v")))
    return frames.select(F.col("frame_id").alias("e"), "tx", F.inline(F.concat(F.array(*fixed), derived)))


def advance_cursor(decisions: DataFrame, cursor: str | None) -> DataFrame:
    """the youngest tx of the accepted clusters; never backwards."""
    return decisions.where("reason = 'ACCEPTED'").agg(F.greatest(F.max("youngest"), F.lit(cursor)).alias("cursor"))


def analyze_candidates(members: DataFrame, cohesion: DataFrame, least: int = 2) -> DataFrame:
    """Communities with at least `least` members that have a project: of those that were not migrated, the sorted
    projects, their number, and the largest share. members: `(community, id, project, migrated)`.

    Shares come from a count per community and project, so no community is gathered.
    """
    m = members.where("project IS NOT NULL AND project <> ''")
    own = F.count_if(~F.coalesce("migrated", F.lit(False)))
    by = m.groupBy("community", "project").agg(F.count("*").alias("every"), own.alias("own"))
    out = by.groupBy("community").agg(F.sum("every").alias("every"), F.sum("own").alias("size"), F.max("own").alias("top"), F.array_sort(F.collect_set(F.when(F.col("own") > 0, F.col("project")))).alias("projects"))
    out = out.where(F.col("every") >= least).withColumn("share", F.when(F.col("size") > 0, F.col("top") / F.col("size")).otherwise(0.0))
    return out.select("community", "size", "projects", "share").join(cohesion.select("community", "mdl_ratio"), "community", "left")


def analyze(candidates: DataFrame, mdl: float = 1.15, projects: int = 2, share: float = 0.70, boost: float = 0.20) -> DataFrame:
    """the decision in its order, and the boost on what is accepted."""
    reason = F.when(F.col("size") == 0, "ALL_MIGRATED").when(F.coalesce("mdl_ratio", F.lit(1.0)) < mdl, "LOW_MDL").when(F.size("projects") < projects, "TOO_FEW_PROJECTS").when(F.col("share") > share, "DOMINATED").otherwise("ACCEPTED")
    return candidates.withColumn("reason", reason).withColumn("importance", F.when(F.col("reason") == "ACCEPTED", boost).otherwise(0.0))


def schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, s, r, o, x) for n, s, r, o, x in FRAME_SCHEMAS], "type string, store string, required array<string>, optional array<string>, reflection_only boolean")


def check_frames(frames: DataFrame, known: DataFrame, direct: bool = False) -> DataFrame:
    """`error` per frame `(frame_id, type, slots map)`: unknown type, reflection-only in a direct write, or a required slot missing."""
    df = frames.join(F.broadcast(known), "type", "left")
    missing = F.array_except("required", F.map_keys("slots"))
    error = F.when(F.col("store").isNull(), "UNKNOWN_FRAME_TYPE").when(F.lit(direct) & F.col("reflection_only"), "REFLECTION_ONLY_KIND").when(F.size(missing) > 0, "MISSING_SLOT")
    return df.select("frame_id", "type", error.alias("error"))


def merge_schemas(known: DataFrame, custom: DataFrame) -> DataFrame:
    """own schemas; one that redefines a built-in type is marked."""
    return custom.join(known.select("type", F.lit("BUILTIN_REDEFINED").alias("error")), "type", "left").select("type", "error")


def latest_briefs(briefs: DataFrame) -> DataFrame:
    """per community the newest brief `(community, tx, slots)` whose slots are JSON."""
    good = briefs.where(F.try_parse_json("slots").isNotNull())
    return good.groupBy("community").agg(F.max_by(F.struct("tx", "slots"), "tx").alias("b")).select("community", "b.tx", "b.slots", F.get_json_object("b.slots", "$.membership_hash").alias("hash"))


def brief_work(now: DataFrame, prior: DataFrame) -> DataFrame:
    """per community whether its brief is kept, renewed or new. now: `(community, hash)`."""
    return now.join(prior.select("community", F.col("hash").alias("old")), "community", "left").select("community", "hash", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "skip").otherwise("renew").alias("status"))


def coverage(outcomes: DataFrame) -> DataFrame:
    """F16: outcomes `(community, status, prior)`: a failure that has a prior brief counts as covered."""
    covered = F.count_if(F.col("status").isin("summarised", "skip") | ((F.col("status") == "failed") & F.col("prior")))
    return outcomes.agg(F.count_if(F.col("status") == "summarised").alias("summarised"), F.count_if(F.col("status") == "skip").alias("skipped"), F.count_if((F.col("status") == "failed") & F.col("prior")).alias("failed_with_prior"), covered.alias("covered"), F.count("*").alias("total"), (covered / F.count("*")).alias("ratio"))


def valid_brief(returned_id="returned_id", returned_hash="returned_hash", community="community", hash_="hash") -> Column:
    """F17."""
    return F.coalesce((F.col(returned_id).cast("string") == F.col(community).cast("string")) & (F.col(returned_hash) == F.col(hash_)), F.lit(False))


def addressable(x: Column) -> Column:
    """an exemplar that can be found again: `prefix:id` with both parts."""
    return F.coalesce(x.rlike(r"^[a-z]+:.+$"), F.lit(False))


def materialise(members: DataFrame, states: DataFrame, most: int | None = None) -> DataFrame:
    """`(community, position, id, kind, body, ts)`: members by id, one row each, so no community is held as one value; of the first `most`
    communities, if given."""
    if most is not None:
        members = members.join(members.select("community").distinct().orderBy("community").limit(most), "community", "left_semi")
    place = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    return members.select("community", "id").join(states, "id").select("community", place.alias("position"), "id", "kind", "body", "ts")


def community_hashes(members: DataFrame) -> DataFrame:
    """G13 of communities `(community, id)` without levels."""
    return fingerprints(members.select(F.lit(0).alias("level"), "community", "id")).drop("level")
