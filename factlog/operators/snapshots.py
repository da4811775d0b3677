"""H3 on a long log: state snapshots every so many transactions, and the facts between them, so that an as-of read folds a bounded stretch of the log."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlog.operators import state
from factlog.session import written
from factlog.sources.versions import Version, Versions

STATE = "e string, a string, op string, v string, tx string"


class Snapshots:
    """The facts `(tx, e, a, op, v)` of a log under `path` in segments of `every` transactions; at the end of each segment stands the state. What comes after the last
    full segment is the open one, without a state. A version names all folders, so readers see a segment with its state or neither."""

    def __init__(self, spark: SparkSession, path: str, every: int = 10_000):
        self.versions, self.every = Versions(spark, path), every

    def extend(self, facts: DataFrame) -> Version:
        """Add the facts after the last one that is there; late ones are ignored, as the log's order is that of tx. Only the open segment is read again."""
        old = self.versions.current() or Version(-1, {}, {})
        last, full = old.values.get("last"), old.values.get("full")
        fresh = facts.select("tx", "e", "a", "op", "v").where(F.lit(True) if last is None else F.col("tx") > last)
        fresh = written(self._segment(old, full, None).union(fresh))
        top = fresh.agg(F.max("tx")).first()[0]
        if top is None or top == last:
            return old
        places = {k: f for k, f in old.places.items() if k != ("open", 0)}
        values = {k: x for k, x in old.values.items() if k not in ("last", "full")}
        number = 1 + max((b for t, b in places if t == "state"), default=-1)
        base = self.versions.table(old, "state", STATE, {number - 1})
        for upto in self._cuts(fresh):
            part = fresh.where((F.col("tx") <= upto) if full is None else (F.col("tx") > full) & (F.col("tx") <= upto))
            places["facts", number], places["state", number] = self._write(part.sort("tx")), self._write(state.merge_latest(base, state.fold(part)))
            values[f"upto:{number}"] = full = upto
            base = self.versions.spark.read.schema(STATE).parquet(places["state", number])
            number += 1
        places["open", 0] = self._write(fresh if full is None else fresh.where(F.col("tx") > full))
        return self.versions.publish(Version(old.number + 1, places, values | {"last": top} | ({"full": full} if full is not None else {})))

    def _cuts(self, facts: DataFrame) -> list[str]:
        """The last tx of every full segment: the places of the transactions come from counts by ranges, so none is a window over all of them."""
        tx = written(facts.select("tx").distinct().repartitionByRange("tx").sortWithinPartitions("tx").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
        before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
        starts = tx.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).select("part", "first", F.coalesce(before, F.lit(0)).alias("before"))
        place = F.col("before") + F.col("at") - F.col("first") + 1
        return [r["tx"] for r in tx.join(F.broadcast(starts), "part").where(place % self.every == 0).select("tx").sort("tx").collect()]  # a row a segment

    def _write(self, df: DataFrame) -> str:
        folder = self.versions.new_folder() + "/all"
        df.write.parquet(folder)
        return folder

    def _segment(self, version: Version, after: str | None, upto: str | None) -> DataFrame:
        """The facts with after < tx <= upto, from the segments that can hold them alone."""
        ends = sorted((x, int(k[5:])) for k, x in version.values.items() if k.startswith("upto:"))
        names = [e for e, _ in ends]
        low = 0 if after is None else bisect_right(names, after)
        high = len(ends) if upto is None else min(bisect_right(names, upto) + 1, len(ends))
        folders = [version.places["facts", k] for _, k in ends[low:high]]
        if ("open", 0) in version.places and (upto is None or not ends or upto > names[-1]):
            folders.append(version.places["open", 0])
        schema = "tx string, e string, a string, op string, v string"
        out = self.versions.spark.read.schema(schema).parquet(*folders) if folders else self.versions.spark.createDataFrame([], schema)
        out = out if after is None else out.where(F.col("tx") > after)
        return out if upto is None else out.where(F.col("tx") <= upto)

    def as_of(self, tx: str) -> DataFrame:
        """`(e, a, v, tx)`: the latest values up to a tx (P1 of H3), from the nearest state before it and the facts since."""
        now = self.versions.current() or Version(-1, {}, {})
        ends = sorted((x, int(k[5:])) for k, x in now.values.items() if k.startswith("upto:") and ("state", int(k[5:])) in now.places and x <= tx)
        after, base = (ends[-1][0], self.versions.table(now, "state", STATE, {ends[-1][1]})) if ends else (None, None)
        fold = state.fold(self._segment(now, after, tx))
        both = fold if base is None else state.merge_latest(base, fold)
        return both.where("op <> 'retract'").select("e", "a", "v", "tx")

    def compact(self, keep: int = 8) -> Version | None:
        """Drop every second state of all segments but the last `keep`: old reads fold two segments more for each time, and the states take a half of the room. The
        facts stay as they are."""
        old = self.versions.current()
        if old is None:
            return None
        numbers = sorted(b for t, b in old.places if t == "state")
        gone = {("state", b) for b in numbers[: max(0, len(numbers) - keep)][::2]}
        if not gone:
            return old
        return self.versions.publish(Version(old.number + 1, {k: f for k, f in old.places.items() if k not in gone}, old.values))
