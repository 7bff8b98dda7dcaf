"""Positions in a global order without one task that holds all rows, and rows dealt to as many tasks as they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a task at most, in the mean, where rows are dealt by their count.
ROWS = 500_000


def spread(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session's shuffles have (two for each core, and ``least``, at least).

    Unlike those of other shuffles these tasks are not merged because they are few bytes.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, least)
    return df.repartition(n, *keys)


def bounded(df: DataFrame, *keys: str, rows: int = ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Rows dealt by keys to more tasks than the session's shuffles have if those would hold too many, else left as they are.

    ``counted`` is a table of as many rows, if one is at hand that is counted with less work.
    """
    n = -(-(df if counted is None else counted).count() // rows)
    return spread(df, *keys, least=n) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def places(df: DataFrame, order: list[str], path: str, out: str = "place") -> DataFrame:
    """Adds the position (from 1) in the order of some columns; rows that tie in all of them are numbered in any order.

    Ranges of the order are sorted apart and written to ``path``, a new scratch folder, so that a range is the same in both
    passes; a row for each range tells how many rows come before it.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    x = df.sparkSession.read.schema(ranged.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as the shuffle has partitions
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = x.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    placed = inside.join(F.broadcast(sizes), "_part")
    return placed.withColumn(out, F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")
