"""Frames: the latest version of a row, calendars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, *keys: str, at: str = "_ingested_at") -> DataFrame:
    """The row of each key that came last; of those that came together, the one of greatest content hash. Catalyst cuts each task's rows to one a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*[F.col(c) for c in df.columns]).desc())
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def daily_dates(spark: SparkSession, first: date, last: date, name: str = "date_day") -> DataFrame:
    """Every day from first to last, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name))


def in_time_blocks(df: DataFrame, before: int, after: int, second: str = "_second", spans: int = 16) -> DataFrame:
    """df with _block and _home for windows that reach `before` seconds back and `after` ahead, so that no key's whole history is one window partition.

    A block is `spans` reaches long. A row is in the block of its own second, where _home is true, and as a visitor in the block beside it if a row there can reach it. A window
    by key and _block then sees for each row at home all that one by key alone would; about one row in `spans` over two is there twice. Rows without a second share a block.
    """
    size = spans * max(before, after, 1)

    def block(shift: int):
        return F.floor((F.col(second) + shift) / size)

    dealt = df.withColumn("_block", F.explode(F.array_distinct(F.array(block(-after), block(0), block(before)))))
    return dealt.withColumn("_home", F.col("_block").eqNullSafe(block(0)))
