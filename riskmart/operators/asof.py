"""As-of joins: each row with the last known one of another table, at or before its own time.

Both sides go into one union, by key and block of time, and a running last value over it is the match: no pairs, and no range condition that a join has to test. A block also gets the
last row before it, from an aggregation of blocks (one row for each key and block), so a value holds on through blocks without any, and no key's whole history is one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.functions.columns import seconds

#: Seconds of a block.
BLOCK = 7 * 86400


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, tolerance: int | None = None, block: int = BLOCK) -> DataFrame:
    """left's rows, each with right's other columns of the last row of equal keys at or before it (null without one, or with one that is more than `tolerance` seconds older).

    Of right's rows at one moment the one of greatest content hash counts. Rows without a time or with a null key match nothing; those of left are kept. Repeated rows of left are kept.
    Columns of right that left has by name too are to be renamed before; right_at comes along like the others.
    """
    taken = [c for c in right.columns if c not in on]
    if clash := sorted(set(taken) & set(left.columns)):
        raise ValueError(f"in both tables: {clash}")
    usable = F.lit(True)
    for k in on:
        usable = usable & F.col(k).isNotNull()
    where = F.floor(seconds("_at") / block)
    known = right.where(usable & F.col(right_at).isNotNull()).select(*on, F.col(right_at).alias("_at"), F.struct(*taken).alias("_value"), F.xxhash64(*taken).alias("_tie")).withColumn("_block", where)
    asked = left.select(*on, F.col(left_at).alias("_at"), F.struct(*left.columns).alias("_row")).where(usable & F.col("_at").isNotNull()).withColumn("_block", where)
    # What a block starts with: the last row of the last block before it that has any.
    ends = known.groupBy(*on, "_block").agg(F.max_by(F.struct("_at", "_tie", "_value"), F.struct("_at", "_tie")).alias("_end"))
    blocks = ends.unionByName(asked.select(*on, "_block"), allowMissingColumns=True).groupBy(*on, "_block").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(*on).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = blocks.withColumn("_last", F.last("_end", ignorenulls=True).over(before)).where("_last is not null").select(*on, "_block", "_last.*")
    both = known.unionByName(carried).withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*on, "_block").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_match", F.last("_value", ignorenulls=True).over(upto)).where("_side = 1")
    if tolerance is not None:
        old = F.col("_at") > F.col(f"_match.{right_at}") + F.expr(f"INTERVAL '{tolerance}' SECOND")
        found = found.withColumn("_match", F.when(~F.coalesce(old, F.lit(True)), F.col("_match")))
    found = found.select("_row.*", *[F.col(f"_match.{c}").alias(c) for c in taken])
    rest = left.where(~(usable & F.col(left_at).isNotNull()))
    return found.unionByName(rest.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in taken]))
