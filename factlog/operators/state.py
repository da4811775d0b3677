"""Projection of facts into state: latest values, entities, edges, documents; incremental replay; history and as-of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.functions.constants import LWW_ATTRIBUTES
from factlog.functions.values import decoded, edge_type, label_of


def as_of(facts: DataFrame, tx: str | None) -> DataFrame:
    """H3: every read takes the facts up to a tx. The filter reaches the scan."""
    return facts if tx is None else facts.where(F.col("tx") <= tx)


def latest(facts: DataFrame) -> DataFrame:
    """The last value of every (e, a); a last retract removes it. One partial aggregate, no order needed."""
    last = F.max_by(F.struct("op", "v"), F.struct("tx", *[c for c in ("seq",) if c in facts.columns]))
    return facts.groupBy("e", "a").agg(last.alias("last"), F.max("tx").alias("tx")).where("last.op <> 'retract'").select("e", "a", F.col("last.v").alias("v"), "tx")


def collapse(facts: DataFrame, attributes: list[str] = LWW_ATTRIBUTES) -> DataFrame:
    """Of the given attributes only the last fact of every entity stays; all other facts stay.

    The last tx is found by a partial aggregate over the given attributes alone, so history rows are not shuffled for it.
    """
    single = F.col("a").isin(attributes)
    last = facts.where(single).groupBy("e", "a").agg(F.max_by(F.struct(*facts.columns), F.col("tx")).alias("f")).select("f.*")
    return facts.where(~single).unionByName(last.select(facts.columns))


def entities(facts: DataFrame) -> DataFrame:
    """One row per entity: its latest attributes, its label, its last tx, and the sticky tombstone."""
    head = facts.groupBy("e").agg(F.max("tx").alias("last_tx"), F.bool_or((F.col("op") == "retract") & (F.col("a") == "exists")).alias("retracted"))
    attrs = latest(facts).groupBy("e").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("a", "v")))).alias("attrs"))
    return head.join(attrs, "e", "left").select("e", label_of("e").alias("label"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), "last_tx", "retracted")


def edges(facts: DataFrame) -> DataFrame:
    """P5: typed edges, one per (src, rel, dst), with the last tx. Link payloads give their confidence and cosine as props."""
    kind, text = decoded("v")
    link = F.lower("a").startswith("link.")
    target = F.when(link, F.get_json_object("v", "$.target")).otherwise(F.when(kind == "string", text))
    props = F.when(link, F.map_filter(F.create_map(F.lit("confidence"), F.get_json_object("v", "$.confidence").cast("double"), F.lit("cosine"), F.get_json_object("v", "$.cosine").cast("double")), lambda k, v: v.isNotNull()))
    rows = facts.where("op = 'add'").select(F.col("e").alias("src"), edge_type("a").alias("rel"), target.alias("dst"), "tx", props.alias("props"))
    return rows.where("rel IS NOT NULL AND dst IS NOT NULL AND dst <> ''").groupBy("src", "rel", "dst").agg(F.max("tx").alias("last_tx"), F.max_by("props", "tx").alias("props"))


def documents(facts: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Entries and frames with their property bag; a vector stays when later facts bring none."""
    out = entities(facts).where("label IN ('Entry', 'Frame')")
    return out if vectors is None else out.join(vectors.select(F.col("entity_id").alias("e"), "embedding"), "e", "left")


def delta(facts: DataFrame, watermark: str | None) -> DataFrame:
    """The facts after a watermark."""
    return facts if watermark is None else facts.where(F.col("tx") > watermark)


def merge_latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert the latest values of a delta (with its retractions) into the state. Both are `(e, a, op, v, tx)`."""
    both = old.unionByName(new)
    return both.groupBy("e", "a").agg(F.max_by(F.struct("op", "v"), "tx").alias("last"), F.max("tx").alias("tx")).select("e", "a", "last.op", "last.v", "tx")


def fold(facts: DataFrame) -> DataFrame:
    """The state that `merge_latest` keeps: the last op and value of every (e, a)."""
    return facts.groupBy("e", "a").agg(F.max_by(F.struct("op", "v"), "tx").alias("last"), F.max("tx").alias("tx")).select("e", "a", "last.op", "last.v", "tx")


def advance(watermarks: DataFrame, applied: DataFrame) -> DataFrame:
    """The greatest tx of every target, old or applied."""
    return watermarks.unionByName(applied).groupBy("target").agg(F.max("tx").alias("tx"))


def max_tx(facts: DataFrame) -> DataFrame:
    """P16."""
    return facts.agg(F.max("tx").alias("max_tx"))


def rebuild(facts: DataFrame, path: str) -> dict[str, str]:
    """Write entities and edges to a new folder under `path` and give its places; the caller switches to it when all are
    written, so a failure leaves the active tables as they are. The same facts give the same state."""
    import uuid

    to = f"{path.rstrip('/')}/staging-{uuid.uuid4().hex}"
    out = {"entities": f"{to}/entities", "edges": f"{to}/edges"}
    entities(facts).write.parquet(out["entities"])
    edges(facts).write.parquet(out["edges"])
    return out


def drift(facts: DataFrame, digest: str) -> DataFrame:
    """Entries whose latest embedding digest is another than `digest`; entries without one are left out."""
    last = latest(facts.where("a = 'embedding_model_digest'")).where(F.col("v") != F.lit(digest))
    return last.select("e", F.col("v").alias("digest")).orderBy("e")


def rebind_facts(drifted: DataFrame, digest: str) -> DataFrame:
    """An audit fact {from, to} for every entry that is embedded anew."""
    return drifted.select("e", F.lit("model_rebind").alias("a"), F.to_json(F.struct(F.col("digest").alias("from"), F.lit(digest).alias("to"))).alias("v"))


def statistics(facts: DataFrame, watermarks: DataFrame, quarantined: DataFrame) -> DataFrame:
    """`(name, value)`: entries, the log's last tx, quarantined segments, and facts that each target lags behind."""
    lags = watermarks.select("target", F.col("tx").alias("mark"))
    late = facts.select("tx").join(F.broadcast(lags), F.col("tx") > F.col("mark")).groupBy("target").agg(F.count("*").alias("n"))
    behind = lags.select("target").distinct().join(late, "target", "left").select("target", F.coalesce("n", F.lit(0)).cast("string").alias("value"))
    return (
        facts.where("e LIKE 'entry:%'").agg(F.countDistinct("e").cast("string").alias("value")).select(F.lit("entries").alias("name"), "value")
        .union(facts.agg(F.max("tx").alias("value")).select(F.lit("log_tx").alias("name"), "value"))
        .union(quarantined.agg(F.countDistinct("file").cast("string").alias("value")).select(F.lit("quarantined").alias("name"), "value"))
        .union(behind.select(F.concat(F.lit("lag:"), "target").alias("name"), "value"))
    )


def history(facts: DataFrame, entity: str) -> DataFrame:
    """H1: all facts of one entity by tx, never collapsed."""
    return facts.where(F.col("e") == entity).orderBy("tx")


def introduced(facts: DataFrame, tx: str) -> DataFrame:
    """H2: entries whose first fact is not after `tx`, with that first tx. An unknown tx is an error."""
    if facts.where(F.col("tx") == tx).isEmpty():
        raise ValueError(f"unknown tx {tx}")
    return as_of(facts, tx).where("e LIKE 'entry:%'").groupBy("e").agg(F.min("tx").alias("tx"))
