"""P11-P13, ST1: entities' latest values, edges and vectors as copy-on-write buckets behind one pointer.

Rows are dealt into buckets by a hash of their entity. A delta touches some buckets; these are merged and written anew, the others are named again by the next
manifest. Steps: write, check, publish. The watermark is part of the manifest, so tables and watermark move together, or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlog.operators import state
from factlog.sources.versions import Version, Versions

STATE = "e string, a string, op string, v string, tx string"
EDGES = "src string, rel string, dst string, last_tx string, props map<string,double>"
VECTORS = "e string, embedding array<double>, digest string, tx string"
#: Of every table its schema and the column that deals its rows into buckets.
TABLES = {"state": (STATE, "e"), "edges": (EDGES, "src"), "vectors": (VECTORS, "e")}
KEYS = {"state": ["e", "a"], "edges": ["src", "rel", "dst"], "vectors": ["e"]}


class Rejected(ValueError):
    """What was written is not what it should be; the version before stays current."""


def _merged(tab: str, rows: DataFrame) -> DataFrame:
    """One row a key, that of the greatest tx. Sums are taken before the shuffle, so an entity with many facts is no hot key."""
    order = "last_tx" if tab == "edges" else "tx"
    names = [x.strip().split(" ")[0] for x in TABLES[tab][0].replace("map<string,double>", "map").split(",")]
    rest = [c for c in names if c not in KEYS[tab]]
    return rows.groupBy(*KEYS[tab]).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*KEYS[tab], *[F.col(f"last.{c}").alias(c) for c in rest]).select(names)


class Projection:
    """The derived tables of a log under `path`.

    buckets: how many folders a table has; files: files a touched bucket is dealt over by a hash of the key. before: called with the name of each step
    ("write", "check", "publish") before it is made; tests raise there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, files: int = 1, before: Callable[[str], None] = lambda step: None):
        self.versions, self.buckets, self.files, self.before = Versions(spark, path), buckets, files, before

    def table(self, tab: str, version: Version | None = None) -> DataFrame:
        version = version or self.versions.current() or Version(-1)
        return self.versions.table(version, tab, TABLES[tab][0])

    def latest(self) -> DataFrame:
        """P1 of what was applied."""
        return self.table("state").where("op <> 'retract'").drop("op")

    def edges(self) -> DataFrame:
        """P5 of what was applied."""
        return self.table("edges")

    def watermark(self) -> str | None:
        now = self.versions.current()
        return now.values.get("watermark") if now else None

    def heal(self, facts: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> Version | None:
        """Apply the facts after the stored watermark. Nothing new: no version."""
        return self.apply(state.delta(facts, self.watermark()), None, embed)

    def apply(self, delta: DataFrame, number: int | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> Version | None:
        """Merge a delta, late facts included, into the buckets that it touches. number: the version's, as a stream numbers its batches; one that is there already
        is not made again."""
        old = self.versions.current() or Version(-1)
        if number is not None and number <= old.number:
            return None
        fresh = {"state": state.fold(delta), "edges": state.edges(delta)} | ({"vectors": _vectors(delta, embed)} if embed else {})
        scanned, last = delta.agg(F.count("*"), F.max("tx")).first()
        if not scanned:
            return None
        return self._write(old, number if number is not None else old.number + 1, fresh, last, {"scanned": scanned, "applied": scanned, "rebinds": 0}, False)

    def rebuild(self, facts: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, digest: str | None = None, accept_drift: bool = True) -> Version:
        """All tables anew from the whole log; the version before stays in place until the new one is checked and published. With a digest,
        entries that were embedded by another model (P14) are counted as rebinds, or refuse the rebuild unless `accept_drift`."""
        rebinds = state.drift(facts, digest).count() if digest is not None else 0
        if rebinds and not accept_drift:
            raise Rejected(f"{rebinds} entries have vectors of another model")
        old = self.versions.current() or Version(-1)
        fresh = {"state": state.fold(facts), "edges": state.edges(facts)} | ({"vectors": _vectors(facts, embed)} if embed else {})
        scanned, last = facts.agg(F.count("*"), F.max("tx")).first()
        expected = facts.select("e", "a").distinct().count()
        return self._write(old, old.number + 1, fresh, last, {"scanned": scanned, "applied": expected, "rebinds": rebinds}, True, expected)

    def _write(self, old: Version, number: int, fresh: dict[str, DataFrame], last: str | None, counters: dict, whole: bool, expected: int | None = None) -> Version:
        versions, places = self.versions, {} if whole else dict(old.places)
        sizes = {} if whole else {k: x for k, x in old.values.items() if k.startswith("rows:")}
        for tab, new in fresh.items():
            schema, key = TABLES[tab]
            bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
            rows, before = new, {}
            if not whole:
                new = new.persist()
                touched = {r["b"] for r in new.select(bucket.alias("b")).distinct().collect()}  # at most `buckets`
                rows = _merged(tab, versions.table(old, tab, schema, touched).select(new.columns).union(new))
                before = {b: int(old.values[f"rows:{tab}:{b}"]) for b in touched if (tab, b) in old.places}
            folder = versions.new_folder()
            self.before("write")
            dealt = rows.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64(*KEYS[tab]), F.lit(self.files)))
            dealt.write.partitionBy("bucket").parquet(folder)
            self.before("check")
            for b, n in self._checked(tab, schema, folder, before, expected if tab == "state" else None).items():
                places[tab, b], sizes[f"rows:{tab}:{b}"] = f"{folder}/bucket={b}", str(n)
            new.unpersist()
        self.before("publish")
        mark = max(filter(None, (last, old.values.get("watermark"))), default=None)
        return versions.publish(Version(number, places, sizes | {"watermark": mark} | {k: str(v) for k, v in counters.items()}))

    def _checked(self, tab: str, schema: str, folder: str, before: dict[int, int], expected: int | None) -> dict[int, int]:
        """The rows of each bucket that was written, if every key stands once, no bucket lost rows, and a rebuild has all keys of the log."""
        spark = self.versions.spark
        back = spark.read.schema(f"{schema}, bucket int").parquet(folder)
        each = back.groupBy("bucket", *KEYS[tab]).agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()
        if bad := [r["bucket"] for r in each if r["n"] != r["keys"] or r["n"] < before.get(r["bucket"], 0)]:
            raise Rejected(f"{tab}: buckets {sorted(bad)[:5]} repeat keys or lost rows")
        if set(before) - {r["bucket"] for r in each}:
            raise Rejected(f"{tab}: buckets went missing")
        if expected is not None and sum(r["n"] for r in each) != expected:
            raise Rejected(f"{tab}: {sum(r['n'] for r in each)} keys, the log has {expected}")
        return {r["bucket"]: r["n"] for r in each}


def _vectors(facts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of the entries whose body is among the facts: `embed` adds `embedding` (U1) and `digest` to `(e, text, tx)`."""
    bodies = state.latest(facts.where("a = 'body'")).select("e", F.col("v").alias("text"), "tx")
    return embed(bodies).select("e", F.col("embedding").cast("array<double>").alias("embedding"), "digest", "tx")
