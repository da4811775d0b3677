"""The fact log as JSON lines in segments: scan, seal, verify, fault scan, quarantine, append, merge, export, import.

A log is a DataFrame `(file, line_no, line)`; facts have the columns of `FACT_SCHEMA`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.functions.constants import FACT_COLUMNS
from factlog.functions.values import canonical_body, sealed_line, tx_day
from factlog.session import written
from factlog.sources.versions import Version, Versions

_SCALARS = ", ".join(f"{c} string" for c in [*[c for c in FACT_COLUMNS if c != "v"], "checksum"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of segments: `(file, line_no, line, ended)`. Files are split and read like any text; a line's number is its rank by
    the offset of the block that it was read in and its place there. ended: whether the file's last sign is a line end.

    The numbers come from counts by block: a window ranks blocks, never lines of different tasks together.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("size"), (F.octet_length("value") + 1).alias("bytes"))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("bytes").alias("bytes"))
    by_file = Window.partitionBy("file")
    before = F.sum("n").over(by_file.orderBy("block")) - F.col("n")
    blocks = blocks.select("file", "block", "first", before.alias("before"), F.sum("bytes").over(by_file).alias("read"))
    number = (F.col("before") + F.col("at") - F.col("first")).cast("int")
    return raw.join(blocks, ["file", "block"]).select("file", number.alias("line_no"), "line", (F.col("read") <= F.col("size")).alias("ended"))


def scan(lines: DataFrame) -> DataFrame:
    """Parse lines into facts. `v` keeps its raw bytes: it stands between the keys "v" and "src" of the canonical order."""
    j = F.from_json("line", _SCALARS)
    raw = F.regexp_extract("line", r'(?s),"v":(.*),"src":"', 1)
    names = [c for c in lines.columns if c != "line"]
    return lines.select(*names, "line", j.alias("j"), raw.alias("raw")).select(*names, *[F.col("raw").alias("v") if c == "v" else F.col(f"j.{c}").alias(c) for c in FACT_COLUMNS], F.col("j.checksum").alias("checksum"))


def ordered(facts: DataFrame) -> DataFrame:
    """By tx; ties by file and line."""
    return facts.orderBy("tx", *[c for c in ("file", "line_no", "e", "a") if c in facts.columns])


def seal(facts: DataFrame) -> DataFrame:
    """S3: add `checksum`, the SHA-256 of the canonical JSON."""
    return facts.withColumn("body", canonical_body()).withColumn("checksum", F.sha2(F.col("body").cast("binary"), 256)).drop("body")


def to_lines(facts: DataFrame) -> DataFrame:
    """The facts' canonical JSON lines, sealed."""
    body = facts.withColumn("body", canonical_body())
    return body.withColumn("checksum", F.sha2(F.col("body").cast("binary"), 256)).withColumn("line", sealed_line())


def verify(lines: DataFrame) -> DataFrame:
    """`ok` per line: the checksum at its end is that of the rest."""
    rest = F.regexp_replace("line", r',"checksum":"[0-9a-f]{64}"\}$', "}")
    found = F.regexp_extract("line", r',"checksum":"([0-9a-f]{64})"\}$', 1)
    return lines.withColumn("ok", (found != "") & (F.sha2(rest.cast("binary"), 256) == found))


def faults(lines: DataFrame, block: int = 100_000) -> DataFrame:
    """The first fault of every segment: BAD_JSON, BAD_CHECKSUM, TX_ORDER or NO_NEWLINE (last line only).

    Lines are compared inside blocks of `block` numbers; the first line of a block is compared with the last one of the block before, so a segment
    of any length is many tasks.
    """
    ended = F.col("ended") if "ended" in lines.columns else F.lit(True)
    at = F.floor(F.col("line_no") / block)
    marked = verify(lines).select("file", "line_no", "ok", ended.alias("ended"), F.get_json_object("line", "$.tx").alias("tx"), at.alias("at"))
    marked = written(marked)  # read for the blocks' ends and for their lines: every line is made and checked once
    ends = marked.groupBy("file", "at").agg(F.max("line_no").alias("top"), F.max_by(F.struct("tx"), "line_no").alias("end"))
    by_file = Window.partitionBy("file").orderBy("at")  # a row a block
    ends = ends.select("file", "at", F.lag("end").over(by_file).alias("end"), F.when(F.lead("at").over(by_file).isNull(), F.col("top")).alias("last_line"))
    inside = F.lag(F.struct("tx")).over(Window.partitionBy("file", "at").orderBy("line_no"))
    marked = marked.withColumn("inside", inside).join(ends, ["file", "at"]).withColumn("before", F.coalesce("inside", "end")["tx"])
    fault = F.when(F.col("tx").isNull(), "BAD_JSON").when(~F.col("ok"), "BAD_CHECKSUM").when(F.col("tx") < F.col("before"), "TX_ORDER").when((F.col("line_no") == F.col("last_line")) & ~F.col("ended"), "NO_NEWLINE")
    return marked.withColumn("fault", fault).where("fault IS NOT NULL").groupBy("file").agg(F.min("line_no").alias("line_no"), F.min_by("fault", "line_no").alias("fault"))


def healthy(lines: DataFrame, found: DataFrame) -> DataFrame:
    """The lines of segments without a fault."""
    return lines.join(found, "file", "left_anti")


def collisions(facts: DataFrame) -> DataFrame:
    """Transactions that stand in more than one segment."""
    return facts.groupBy("tx").agg(F.array_sort(F.collect_set("file")).alias("files")).where(F.size("files") > 1)


def check_group(facts: DataFrame, last_tx: str | None, ranges: int = 64) -> DataFrame:
    """One row per tx group with the reason why it can't be appended, or null. A group is the rows of one `grp`; groups come in the order of their names.

    A group's tx must be greater than `last_tx` and than that of every sound group before it in the same batch. The greatest tx before a group is a prefix
    maximum: groups are sorted into ranges, each range gives one maximum, and a window runs inside a range only.
    """
    by = facts.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("tx").alias("txs"), F.count_if(F.col("checksum").isNull()).alias("unsealed"), F.min("tx").alias("tx"))
    shape = F.when(F.col("txs") > 1, "MIXED_TX").when(F.col("unsealed") > 0, "UNSEALED")
    by = written(by.select("grp", "n", "tx", shape.alias("shape")).repartitionByRange(ranges, "grp").withColumn("range", F.spark_partition_id()))
    sound = F.when(F.col("shape").isNull(), F.col("tx"))
    tops = by.groupBy("range").agg(F.max(sound).alias("top"))  # one row a range
    earlier = tops.withColumn("above", F.max("top").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", "above")
    here = F.max(sound).over(Window.partitionBy("range").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest(here, "above", F.lit(last_tx).cast("string"))
    marked = by.join(F.broadcast(earlier), "range").withColumn("before", before)
    return marked.select("grp", "n", F.coalesce("shape", F.when(F.col("tx") <= F.col("before"), "TX_NOT_GREATER")).alias("error"))


class FactTable:
    """A log of facts as Parquet under `path`, appended batch by batch. A batch is one folder, there from the moment that its write was committed; its number
    makes an append repeatable: the same number again adds nothing, and one that failed half way is written anew."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 2_000_000):
        self.versions, self.rows_per_file = Versions(spark, path), rows_per_file

    def read(self) -> DataFrame:
        """All facts, with `tx_day` as the partition."""
        now = self.versions.current()
        if now is None:
            raise FileNotFoundError("nothing was appended yet")
        return self.versions.spark.read.option("basePath", f"{self.versions.path}/data").parquet(*now.folders("facts")).drop("batch")

    def last_tx(self) -> str | None:
        now = self.versions.current()
        return now.values["last_tx"] if now else None

    def append(self, facts: DataFrame, batch: int) -> DataFrame:
        """Append the sound groups of a batch `(grp, fact columns, checksum)` and return `check_group`'s rows: what was refused and why. Facts are clustered by entity
        within a day, and a day is dealt over as many files as its rows need, so a batch of one day uses many tasks."""
        now = self.versions.current() or Version(-1, {}, {"last_tx": None})
        if batch <= now.number:
            return check_group(facts, now.values["last_tx"])
        facts = written(facts)  # read for the check, for the days and for the write: every fact is sealed once
        report = written(check_group(facts, now.values["last_tx"]))
        good = facts.join(report.where("error IS NULL").select("grp"), "grp", "left_semi").drop("grp").withColumn("tx_day", tx_day("tx"))
        days = good.groupBy("tx_day").agg(F.ceil(F.count("*") / self.rows_per_file).cast("int").alias("files"), F.max("tx").alias("last")).collect()  # a row a day
        last = max((r["last"] for r in days), default=None)
        places = dict(now.places)
        if days:
            folder = f"{self.versions.path}/data/batch={batch}-{uuid.uuid4().hex}"
            files = self.versions.spark.createDataFrame([(r["tx_day"], r["files"]) for r in days], "tx_day date, files int")
            dealt = good.join(F.broadcast(files), "tx_day").withColumn("file", F.pmod(F.xxhash64("e"), F.col("files")))
            dealt = dealt.repartition(min(sum(r["files"] for r in days), 20_000), "tx_day", "file").drop("file", "files")
            dealt.sortWithinPartitions("tx_day", "e", "tx").write.partitionBy("tx_day").parquet(folder)
            places["facts", batch] = folder
        self.versions.publish(Version(batch, places, {"last_tx": max(filter(None, (last, now.values["last_tx"])), default=None)}))
        return report


def merge_new(external: DataFrame, own: DataFrame) -> DataFrame:
    """The external facts whose tx is not there yet; a repeated import adds nothing."""
    return external.join(own.select("tx").distinct(), "tx", "left_anti").select(external.columns)


def import_counts(facts: DataFrame) -> DataFrame:
    """How many facts and transactions an import would add."""
    return facts.agg(F.count("*").alias("datoms"), F.countDistinct("tx").alias("txs"))


def export(facts: DataFrame, since: str | None = None) -> DataFrame:
    """All facts as canonical lines in the order of tx, optionally those after a tx only."""
    some = facts if since is None else facts.where(F.col("tx") > since)
    return ordered(to_lines(some)).select("line")


def write_export(facts: DataFrame, path: str, partitions: int = 32) -> None:
    """S11 as a sink: ranges of tx, each sorted, so the files in the order of their names are one sorted stream."""
    to_lines(facts).repartitionByRange(partitions, "tx").sortWithinPartitions("tx", "e", "a").select("line").write.text(path)


def import_records(lines: DataFrame, domain: str = "migrated", project: str = "imported", system: str = "external", trail: str | None = None) -> DataFrame:
    """External records (drawer, diary) as observe requests, with a `reason` for those that are skipped.

    Tags never override the four reserved facets.
    """
    schema = "kind string, id string, body string, subject string, trail_id string, domain string, project string, tags map<string,string>, _bad string"
    r = F.from_json("line", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    df = lines.where("line <> ''").withColumn("r", r)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reserved = F.create_map(F.lit("domain"), F.when(blank(F.col("r.domain")), domain).otherwise(F.col("r.domain")), F.lit("project"), F.when(blank(F.col("r.project")), project).otherwise(F.col("r.project")), F.lit("migrated"), F.lit("true"), F.lit("source_system"), F.lit(system))
    tags = F.map_filter(F.coalesce("r.tags", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("domain", "project", "migrated", "source_system"))
    reason = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "PARSE").when(~F.coalesce("r.kind", F.lit("")).isin("drawer", "diary"), "UNKNOWN_KIND").when(blank(F.col("r.body")), "EMPTY_BODY")
    return df.select(
        "line_no", F.col("r.id").alias("id"), F.col("r.body").alias("body"), F.when(F.col("r.kind") == "drawer", "Observation").when(F.col("r.kind") == "diary", "SessionReflection").alias("kind"),
        F.map_concat(tags, reserved).alias("facets"), F.col("r.subject").alias("subject"), F.when((F.col("r.kind") == "diary") & F.lit(trail is not None), F.lit(trail)).otherwise(F.col("r.trail_id")).alias("trail"), reason.alias("reason"),
    )


def fetch_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors of the given entities."""
    return vectors.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
