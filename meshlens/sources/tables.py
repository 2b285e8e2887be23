"""SRC-01 / SRC-02: read the entity tables.

Parquet is read lazily; Catalyst prunes columns and pushes filters into the scan,
so loading "all tables" costs nothing until a query touches them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` is a parquet DataFrame."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._cache[name]


def load_tables(spark: SparkSession, root: str) -> Tables:
    """SRC-02: every entity table of a snapshot directory."""
    return Tables(spark, root)


def spread(rows: DataFrame, per_task: int = 5_000) -> DataFrame:
    """``rows`` dealt evenly over tasks of about ``per_task`` rows, for costly work on each row of a table whose files
    are too small or too few to be read by many tasks."""
    return rows.repartition(rows.count() // per_task + 1)


def scan_corpus(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SRC-01: recursive file listing with content, filtered by a file-name glob.

    ``binaryFile`` lists files in parallel on the executors (one task per split),
    so a corpus of millions of files never passes through the driver.
    """
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .load(root)
            .select(F.col("path"), F.col("length").alias("size"),
                    F.decode(F.col("content"), "UTF-8").alias("content")))
