"""Streaming forms: a continuous state view, activation per entity, validation of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from factlog.functions.constants import SECRET_RULES
from factlog.operators import activation
from factlog.operators.projection import Projection
from factlog.operators.write import request_error


def facts_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class StateView:
    """ST1: latest values and edges under a folder, kept up by a stream: every batch is a version of a `Projection`, which rewrites the buckets that the batch
    touches and then moves the pointer. A late fact needs no watermark: the greater tx stays. A batch that is replayed after a failure is made again;
    one whose version is there is not. Versions but for the last `keep` are deleted."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, keep: int = 2):
        self.projection, self.keep = Projection(spark, path, buckets), keep

    def upsert(self, facts: DataFrame, batch: int) -> None:
        facts.persist()
        self.projection.apply(facts, batch)
        facts.unpersist()
        self.projection.versions.vacuum(self.keep)

    def start(self, facts: DataFrame, checkpoint: str):
        return facts.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def state(self) -> DataFrame:
        """`(e, a, op, v, tx)`, retractions included."""
        return self.projection.table("state")

    def edges(self) -> DataFrame:
        return self.projection.edges()


def latest_stream(facts: DataFrame) -> DataFrame:
    """ST2: the last value of every (e, a) as a stateful aggregate of the stream itself, for sinks in complete or update mode."""
    return facts.groupBy("e", "a").agg(F.max_by(F.struct("op", "v"), "tx").alias("last"), F.max("tx").alias("tx")).select("e", "a", "last.op", "last.v", "tx")


class ActivationProcessor(StatefulProcessor):
    """The last write of each activation attribute of an entity, held as one value of keyed state. A timer stands at the moment when the entity will have
    decayed under `threshold`; it fires when the clock passes it and reports that the entity faded. The state itself stays: a later
    retrieval reads the old count, and the entity is visible again."""

    def __init__(self, threshold: float, exponent: float):
        self.threshold, self.exponent = threshold, exponent

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"{a}_tx string, {a}_v string" for a in activation.STATE_ATTRIBUTES) + ", timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get() if self.last.exists() else (None,) * (2 * len(activation.STATE_ATTRIBUTES) + 1)
        last = {a: (held[2 * i], held[2 * i + 1]) for i, a in enumerate(activation.STATE_ATTRIBUTES)}
        for r in rows:
            if r.op == "add" and r.a in last and (last[r.a][0] is None or r.tx > last[r.a][0]):
                last[r.a] = (r.tx, r.v)
        if all(tx is None for tx, _ in last.values()):
            return
        now, due = timerValues.getCurrentProcessingTimeInMs(), self._due(last)
        if held[-1] is not None and held[-1] != due:
            self.handle.deleteTimer(held[-1])
        timer = due if due is not None and due > now else None
        if timer is not None and timer != held[-1]:
            self.handle.registerTimer(timer)
        self.last.update((*(x for a in activation.STATE_ATTRIBUTES for x in last[a]), timer))
        yield self._row(key, last, due is not None and due <= now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.last.get()
        self.last.update((*held[:-1], None))
        yield self._row(key, {a: (held[2 * i], held[2 * i + 1]) for i, a in enumerate(activation.STATE_ATTRIBUTES)}, True)

    def close(self) -> None:
        pass

    def _row(self, key, last: dict, faded: bool) -> Row:
        return Row(e=key[0], tx=max(tx for tx, _ in last.values() if tx is not None), faded=faded, **{a: v for a, (_, v) in last.items()})

    def _due(self, last: dict) -> int | None:
        """When base * (1 + age)^-d falls under the threshold, in ms; null while nothing decays (evicted, pinned at or over the threshold, or without a time)."""
        text = {a: (v or "").strip('"') for a, (_, v) in last.items()}
        if text["evicted_at"] > text["evicted_at_retracted"] or (text["pinned"] == "true" and float(text["pin_activation"] or 0) >= self.threshold):
            return None
        times = [datetime.fromisoformat(text[a].replace("Z", "+00:00")) for a in ("encoding_at", "last_retrieved_at") if text[a]]
        base = float(text["base_activation"] or 0)
        if not times or base < self.threshold:
            return None
        age = (base / self.threshold) ** (1 / self.exponent) - 1
        return min(int(max(times).timestamp() * 1000 + age * 1000) + 1, 1 << 62)


def activation_stream(facts: DataFrame, threshold: float = 0.0005, exponent: float = 0.5) -> DataFrame:
    """ST2: for every batch the attributes of the entities that it touched, `(e, tx, faded, attributes...)`, and of those whose activation fell under the threshold
    since, by the clock. The last row of an entity, by the batches, is its state; facts that come late count by their tx like any other, so
    no watermark drops them. `state_of` reads the attributes as A1 does."""
    facts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # value state and timers need it
    out = "e string, tx string, faded boolean, " + ", ".join(f"{a} string" for a in activation.STATE_ATTRIBUTES)
    wanted = facts.where(F.col("a").isin(activation.STATE_ATTRIBUTES)).select("e", "tx", "op", "a", "v")
    return wanted.groupBy("e").transformWithState(ActivationProcessor(threshold, exponent), out, "Update", "ProcessingTime")


def run_activation(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give the rows of `activation_stream` for all data that is there to `sink`, batch by batch, and end. Empty batches are switched off: with timers by the
    clock they would go on for ever; a timer that is due fires with the next data."""
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, was)


def state_of(rows: DataFrame) -> DataFrame:
    """A1 from rows of `activation_stream`, one an entity."""
    long = rows.select("e", "tx", F.lit("add").alias("op"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).alias("v")) for a in activation.STATE_ATTRIBUTES])).alias("x"))
    return activation.state(long.select("e", "tx", "op", "x.a", "x.v").where("v IS NOT NULL"))


def validated(requests: DataFrame, rules=SECRET_RULES, watermark: str = "1 hour") -> DataFrame:
    """ST3: requests `(tx, e, at, kind, body, facets)` with `error`: the first rule broken, or SECRET_DETECTED. Repeats of
    (tx, e) within the watermark are dropped, so a replayed source writes nothing twice. Rules with an entropy floor count by their shape here."""
    secret = F.lit(False)
    for _, pattern, _, _ in rules:
        secret = secret | F.col("body").rlike(pattern)
    once = requests.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["tx", "e"]) if requests.isStreaming else requests.dropDuplicates(["tx", "e"])
    return once.withColumn("error", F.coalesce(request_error(), F.when(secret, "SECRET_DETECTED")))


def split_to(requests: DataFrame, accepted: str, rejected: str, checkpoint: str):
    """ST3: accepted and rejected requests to two places; a batch overwrites its own folder, so a retry is harmless."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{accepted}/batch={n}")
        batch.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{rejected}/batch={n}")
        batch.unpersist()

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
