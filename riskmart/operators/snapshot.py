"""As-reported history: a new version of a row whenever one of the checked columns changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.functions.columns import ratio

COHORT_KEYS = ["cohort_date", "payment_method"]
COHORT_CHECKED = ["approved_count", "approved_amount", "chargeback_transaction_count", "chargeback_amount", "fraud_chargeback_amount", "fraud_labeled_count", "fraud_labeled_amount"]


def start(current: DataFrame, at) -> DataFrame:
    """The first snapshot: every row is open."""
    return current.withColumns({"valid_from": F.lit(at).cast("timestamp_ntz"), "valid_to": F.lit(None).cast("timestamp_ntz")})


def advance(history: DataFrame, current: DataFrame, at, keys: list[str] = COHORT_KEYS, checked: list[str] = COHORT_CHECKED) -> DataFrame:
    """history with open versions closed where a checked column differs now, and new versions of changed and new rows. Rows that are gone stay open. Closed versions are not joined."""
    at = F.lit(at).cast("timestamp_ntz")
    open_, closed = history.where("valid_to is null"), history.where("valid_to is not null")
    h, c = open_.alias("h"), current.alias("c")
    same_key = F.lit(True)
    for k in keys:
        same_key = same_key & F.col(f"h.{k}").eqNullSafe(F.col(f"c.{k}"))
    differs = F.lit(False)
    for k in checked:
        differs = differs | ~F.col(f"h.{k}").eqNullSafe(F.col(f"c.{k}"))
    both = h.withColumn("_h", F.lit(True)).alias("h").join(c.withColumn("_c", F.lit(True)).alias("c"), same_key, "full").withColumn("_new", F.col("h._h").isNull() | (F.col("c._c").isNotNull() & differs))
    was = both.where("h._h").select(*[F.col(f"h.{k}").alias(k) for k in history.columns if k != "valid_to"], F.when(F.col("_new"), at).alias("valid_to"))
    now = both.where("_new").select(*[F.col(f"c.{k}").alias(k) for k in current.columns], at.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return closed.unionByName(was).unionByName(now)


def as_reported(history: DataFrame, moments: list) -> DataFrame:
    """The history as it was reported at each of the moments (`reported_at`): the versions that held then. A version is looked at once, wherever it is: there is no join and no row for each day."""
    asked = F.array(*[F.lit(m).cast("timestamp_ntz") for m in moments])
    held = F.filter(asked, lambda m: (F.col("valid_from") <= m) & (F.col("valid_to").isNull() | (m < F.col("valid_to"))))
    return history.select(F.explode(F.array_distinct(held)).alias("reported_at"), *[c for c in history.columns if c not in ("valid_from", "valid_to")])


def reported_rates(history: DataFrame, moments: list, grain: str = "month") -> DataFrame:
    """Chargeback rates of cohorts by period of sale, as they were reported at each of the moments."""
    keys = ["reported_at", F.trunc("cohort_date", grain).alias("cohort_period")]
    sums = as_reported(history, moments).groupBy(*keys).agg(*[F.sum(c).cast("bigint" if c.endswith("count") else "decimal(38,2)").alias(c) for c in ("approved_count", "approved_amount", "chargeback_transaction_count", "chargeback_amount")])
    return sums.select("*", ratio("chargeback_amount", "approved_amount").alias("chargeback_rate_amount"), ratio("chargeback_transaction_count", "approved_count").alias("chargeback_rate_qty"))
