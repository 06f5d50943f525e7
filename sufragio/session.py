"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sufragio")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary folder of its own; a cluster without it is an error, as its executors share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="sufragio-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str = "table", sort: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later plans start from
    files that survive the loss of any executor. Zstandard keeps the disk share small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove the tables that materialize() wrote for this session; to be called when every result
    that may read them has been written."""
    for path in _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.clear()


def measured(df: DataFrame, max_mb: float = 48.0) -> tuple[DataFrame, bool]:
    """For a table that was materialised: with a broadcast hint if its measured size (rows and
    string lengths, times four for the row overhead) is within max_mb, else as it is."""
    text = [c for c, t in df.dtypes if t == "string"]
    size = F.lit(8 * len(df.columns) + 16)
    for c in text:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    total = df.agg(F.sum(size).alias("b")).first()["b"] or 0
    small = total * 4 <= max_mb * 1e6
    return (F.broadcast(df) if small else df), small


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
