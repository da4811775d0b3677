"""Versions of tables in a folder. A version is a manifest: which folder holds each bucket of each table, and a few named values. It counts from the moment that
its manifest is whole, so data are written first, checked, and then one step makes all tables and values of a version current together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "tab string, bucket int, folder string, name string, value string"


@dataclass(frozen=True)
class Version:
    number: int
    places: dict[tuple[str, int], str] = field(default_factory=dict)
    """Folder of (table, bucket)."""
    values: dict[str, str | None] = field(default_factory=dict)

    def folders(self, tab: str, buckets: set[int] | None = None) -> list[str]:
        return sorted(f for (t, b), f in self.places.items() if t == tab and (buckets is None or b in buckets))


class Versions:
    """The manifests under `path`. One writer at a time, as a stream's batches or a rebuild are; readers need no lock."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def numbers(self) -> list[int]:
        """The whole versions, ascending: those whose manifest was committed."""
        at = self._fs_path(f"{self.path}/manifest/*/_SUCCESS")
        found = at.getFileSystem(self._conf).globStatus(at)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def read(self, number: int) -> Version:
        rows = self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/manifest/{number:020d}").collect()  # one row a bucket
        return Version(number, {(r["tab"], r["bucket"]): r["folder"] for r in rows if r["tab"] is not None}, {r["name"]: r["value"] for r in rows if r["name"] is not None})

    def current(self) -> Version | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def new_folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def publish(self, version: Version) -> Version:
        rows = [(t, b, f, None, None) for (t, b), f in sorted(version.places.items())] + [(None, None, None, k, v) for k, v in sorted(version.values.items())]
        self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version.number:020d}")
        return version

    def table(self, version: Version, tab: str, schema: str, buckets: set[int] | None = None) -> DataFrame:
        folders = version.folders(tab, buckets)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last `keep` versions and the folders that none of these names; what failed writes left goes too. Returns how many folders went."""
        numbers = self.numbers()
        kept = [self.read(n) for n in numbers[-keep:]]
        named = {f for v in kept for f in v.places.values()}
        data, gone = self._fs_path(f"{self.path}/data"), 0
        fs = data.getFileSystem(self._conf)
        for n in numbers[:-keep]:
            fs.delete(self._fs_path(f"{self.path}/manifest/{n:020d}"), True)
        for top in fs.listStatus(data) if fs.exists(data) else []:
            whole = f"{self.path}/data/{top.getPath().getName()}"
            if not any(f == whole or f.startswith(f"{whole}/") for f in named):
                gone += fs.delete(top.getPath(), True)
                continue
            for part in fs.listStatus(top.getPath()) if whole not in named else []:
                if part.isDirectory() and f"{whole}/{part.getPath().getName()}" not in named:
                    gone += fs.delete(part.getPath(), True)
        return gone
