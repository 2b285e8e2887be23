"""Joins of few keys with many rows on both sides, dealt over tasks by their pairs.

Such a join reads little and makes much: by its input it would be put into a few tasks, one key into one of them.  Here
the rows of a key are dealt into runs of about ``RUN`` rows on either side, and every two runs of a key meet in one cell.
A pair is made once, in one cell; a row crosses the shuffle once per run of the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a cell takes from either side, about.  It moves work only, as does ``CELL_PAIRS``.
RUN = 1_000
#: Pairs per task, about.
CELL_PAIRS = 1_000_000
MOST_TASKS = 20_000


def dealt_join(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str) -> DataFrame:
    """``left.join(right, key)`` in many tasks of about ``CELL_PAIRS`` pairs each.

    The key has one type on both sides.  ``left_by`` and ``right_by`` are the columns by which the rows of a key are dealt, such as an id."""
    spark = left.sparkSession
    sizes = (left.groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
             .join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key))
    pairs = sizes.agg(F.sum(F.col("_m").cast("double") * F.col("_n"))).first()[0] or 0
    tasks = int(min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // CELL_PAIRS + 1)))
    runs = sizes.select(key, F.ceil(F.col("_m") / RUN).alias("_left"), F.ceil(F.col("_n") / RUN).alias("_right"))

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        cells = rows.join(runs, key).withColumn(own, F.pmod(F.xxhash64(by), own))
        return cells.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).repartition(
            tasks, key, "_left", "_right")
    cell = [key, "_left", "_right"]
    return (dealt(left, left_by, "_left", "_right").join(dealt(right, right_by, "_right", "_left"), cell)
            .drop("_left", "_right"))
