"""Session helpers: a local session for tests, and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PREFIX = "factlog-"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int = 8, name: str = "factlog") -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset, a temporary one serves a local master only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that every executor sees")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no earlier round."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write `df` as Parquet (compressed) to the shared folder and read it back: the cut for wide intermediate tables. Plans on
    top start from a scan, so they stay small however many rounds came before. by: a column whose values get folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # once the table is there, nothing reads the shuffles that made it
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def discard(*tables: DataFrame, parts: list[str] | None = None) -> None:
    """Delete tables of `written` that nothing reads any more; with `parts`, only these folders of them. Only folders that `written` made are touched."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {_root(f) for f in table.inputFiles()} - {None}:
            for x in [f"{folder}/{p}" for p in parts] if parts else [folder]:
                path = jvm.org.apache.hadoop.fs.Path(x)
                path.getFileSystem(conf).delete(path, True)


def _root(file: str) -> str | None:
    """The folder of `written` that a file belongs to."""
    steps = file.split("/")
    at = next((i for i, x in enumerate(steps) if x.startswith(PREFIX)), None)
    return None if at is None else "/".join(steps[: at + 1])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan over at least as many tasks as run at a time: a small or single file is read by one or two, whatever is computed on its rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
