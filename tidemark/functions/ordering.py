"""Global row numbers of an ordered table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_table

_IN_TASK = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str = "numbered") -> DataFrame:
    """``df`` with ``row_number`` (from 0) in the given order; rows that are equal
    in it follow each other in any order.

    Rows are sorted by range partitions, each partition numbers its own rows, and
    the sums of the counts of the partitions before are added. The place of a row in
    the input ends the sort key, so equal rows do not have to share a partition. The
    driver gets one count per partition.
    """
    placed = df.withColumn("__from", F.monotonically_increasing_id()).orderBy(*order, "__from").drop("__from")
    held = shared_table(placed.withColumn("__at", F.monotonically_increasing_id()), name)
    task = F.shiftright("__at", 33)
    starts, total = [], 0
    for row in held.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():
        starts.append((row["task"], total))
        total += row["n"]
    # one row per written partition
    firsts = F.broadcast(df.sparkSession.createDataFrame(starts, "__task long, __first long"))
    return held.join(firsts, task == F.col("__task")).withColumn(
        "row_number", F.col("__first") + F.col("__at").bitwiseAND(F.lit(_IN_TASK))).drop("__task", "__first", "__at")
