"""Velocity features of a user's transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import TOTAL, seconds
from riskmart.functions.frames import in_time_blocks
from riskmart.operators.asof import as_of_join


def velocity(transactions: DataFrame, config: Config) -> DataFrame:
    """Attempts and amount of the user in the seconds before, without the transaction itself; others of the same second count. A user's rows are dealt over blocks of time."""
    by = Window.partitionBy("user_id", "_block").orderBy("_second")
    out = in_time_blocks(transactions.select("transaction_id", "user_id", "transaction_at", "amount", seconds("transaction_at").alias("_second")), max(config.velocity_seconds), 0)
    made = []
    for name, n in zip(("10m", "24h"), config.velocity_seconds, strict=True):
        before = by.rangeBetween(-n, 0)
        made += [(F.count("*").over(before) - 1).alias(f"user_attempts_{name}"), (F.sum("amount").over(before) - F.col("amount")).cast(TOTAL).alias(f"user_amount_{name}")]
    return out.select("transaction_id", "user_id", "transaction_at", "_home", *made).where("_home").drop("_home")


#: Seconds of the partial sums' blocks.
_SUMS_BLOCK = 3600


def velocity_from_sums(transactions: DataFrame, config: Config) -> DataFrame:
    """The same as velocity(), for users with very many attempts: no window holds a user's attempts.

    Attempts are first summed by user and second (on the map side too), so equal seconds are one row. A running total up to each second is the total of the user's hours before, from
    sums by hour, and that within the hour. What a window holds is the total at its end less that just before its start, which an as-of join of the totals with themselves finds.
    The largest group sorted is an hour of seconds, a user's hours, or a day of totals, however many attempts there are.
    """
    second = seconds("transaction_at")
    rows = transactions.select("transaction_id", "user_id", "transaction_at", "amount", second.alias("_second"), F.coalesce(F.concat(F.lit("u"), "user_id"), F.lit("")).alias("_user"))
    sums = rows.groupBy("_user", "_second").agg(F.count("*").alias("_n"), F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("_a"))
    timed = sums.where("_second is not null").withColumn("_hour", F.floor(F.col("_second") / _SUMS_BLOCK))
    hours = timed.groupBy("_user", "_hour").agg(F.sum("_n").alias("_n"), F.sum("_a").alias("_a"))
    earlier = Window.partitionBy("_user").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_user", "_hour", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_a")])
    upto = Window.partitionBy("_user", "_hour").orderBy("_second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = timed.withColumns({"_n_upto": F.sum("_n").over(upto), "_a_upto": F.sum("_a").over(upto)})
    totals = inside.join(hours, ["_user", "_hour"]).select("_user", "_second", (F.col("_n_before") + F.col("_n_upto")).alias("_n"), (F.col("_a_before") + F.col("_a_upto")).cast(TOTAL).alias("_a"))

    def moment(s: Column) -> Column:
        return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=s)

    known = totals.select("_user", moment(F.col("_second")).alias("_since"), F.col("_n").alias("_n_0"), F.col("_a").alias("_a_0"))
    # Attempts without a time are each other's peers, as in a window.
    found = totals.unionByName(sums.where("_second is null"))
    for name, n in zip(("10m", "24h"), config.velocity_seconds, strict=True):
        asked = found.withColumn("_before", moment(F.col("_second") - n - 1))
        found = as_of_join(asked, known, ["_user"], "_before", "_since", block=86400)
        found = found.withColumns({f"_n_{name}": F.col("_n") - F.coalesce("_n_0", F.lit(0)), f"_a_{name}": F.col("_a") - F.coalesce("_a_0", F.lit(0))}).drop("_n_0", "_a_0", "_since", "_before")
    back = rows.alias("r").join(found.alias("f"), (F.col("r._user") == F.col("f._user")) & F.col("r._second").eqNullSafe(F.col("f._second")))
    made = [c for name in ("10m", "24h") for c in ((F.col(f"_n_{name}") - 1).alias(f"user_attempts_{name}"), (F.col(f"_a_{name}") - F.col("amount")).cast(TOTAL).alias(f"user_amount_{name}"))]
    return back.select("transaction_id", "user_id", "transaction_at", *made)


def velocity_job(transactions: DataFrame, now, config: Config, history_hours: int = 48, emit_hours: int = 24) -> DataFrame:
    """Features of the last `emit_hours` before now, from the history that they need. now: a timestamp column or literal without zone."""
    now = F.lit(now).cast("timestamp_ntz")

    def ago(hours: int):
        return now - F.expr(f"INTERVAL '{hours}' HOUR")

    recent = transactions.where(F.col("transaction_at") >= ago(history_hours))
    return velocity(recent, config).where(F.col("transaction_at") >= ago(emit_hours))
