"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that are whole texts are wide: hand them to Python in Arrow batches of `rows` rows, so that a task's buffers on
    either side stay at a few MB. A setting of the session that is smaller already stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def fold(remainder: int, modulus: int, column: str = "doc_id"):
    """Whether crc32 of the id's text leaves `remainder`: the fixed hold-out rule. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def share_of(share: float, *columns: str):
    """Whether the 64-bit hash of the columns lies in the first `share` of its range. No share is too small for the bound."""
    return F.lit(True) if share >= 1 else F.xxhash64(*columns) < F.lit(-(1 << 63) + int(share * (1 << 64)))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `rows` rows, which bounds the Python objects that a task holds at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts; null counts as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply `each` to every Arrow batch inside the tasks; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, wanted: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of `docs`, all columns as they are, for which `wanted` holds; decided batch by batch inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if batch.num_rows:
                yield batch.filter(pa.array(wanted(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """`docs` less the rows whose doc_id is in `ids`. Up to `most` ids (16 MB) are broadcast; more are joined by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_anti")
