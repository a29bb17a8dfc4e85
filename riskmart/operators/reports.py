"""Reports: made at read, as they depend on the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import as_of, days_between, ratio, total, total0

SCENARIOS = [
    (1, "Contrato literal (todos os métodos, com duplicidade)", True, True),
    (2, "Sem candidatos a duplicidade", True, False),
    (3, "Só métodos elegíveis a chargeback (cartão)", False, True),
    (4, "Cartão e sem duplicidade", False, False),
]


def cohort_maturity(cohorts: DataFrame, config: Config) -> DataFrame:
    age = days_between("cohort_date", as_of(config.as_of))
    return cohorts.withColumns({
        "cohort_age_days": age,
        "is_mature": age >= config.maturity_days,
        "chargeback_rate_amount": ratio("chargeback_amount", "approved_amount"),
        "chargeback_rate_qty": ratio("chargeback_transaction_count", "approved_count"),
        "fraud_bps": 10000 * ratio("fraud_labeled_amount", "approved_amount"),
    })


def open_exposure(attempts: DataFrame, config: Config) -> DataFrame:
    """Merchant: sales that can still be disputed, those of them already paid out, and what is to be expected on them at the rate of the merchant's closed sales (else that of all). One pass over the attempts."""
    age = days_between("cohort_date", as_of(config.as_of))
    sales = attempts.where("is_approved and is_chargeback_eligible and merchant_id is not null").select("merchant_id", "amount", "chargeback_amount", age.alias("age"), F.coalesce("payout_term_days", F.lit(config.default_payout_days)).alias("term"))
    open_, closed = F.col("age") < config.dispute_window_days, F.col("age") >= config.dispute_window_days
    merchants = sales.groupBy("merchant_id").agg(
        total0("amount", open_).alias("open_window_amount"),
        total0("amount", open_ & (F.col("age") >= F.col("term"))).alias("released_open_window_amount"),
        total0("chargeback_amount", open_).alias("open_window_chargeback_amount"),
        total("chargeback_amount", closed).alias("_lost"),
        total("amount", closed).alias("_sold"),
    )
    everyone = merchants.agg(ratio(F.sum("_lost"), F.sum("_sold")).alias("_rate"))  # one row
    rate = F.coalesce(ratio("_lost", "_sold"), F.col("_rate"))
    return merchants.crossJoin(F.broadcast(everyone)).select(
        "merchant_id", "open_window_amount", "released_open_window_amount", "open_window_chargeback_amount", rate.alias("expected_cb_rate"),
        (F.col("released_open_window_amount").cast("double") * F.coalesce(rate, F.lit(0.0))).alias("expected_chargeback_on_released"),
    )


def metric_sensitivity(attempts: DataFrame) -> DataFrame:
    """One metric under four definitions. Attempts are summed once by what the definitions look at; those few rows are then dealt to the scenarios."""
    ok = F.col("is_approved")
    parts = attempts.groupBy("is_chargeback_eligible", "is_duplicate_candidate").agg(
        F.count("*").alias("attempt_count"), F.count_if(ok).alias("approved_count"), F.count_if(ok & F.col("has_chargeback")).alias("chargeback_transaction_count"),
        total("amount", ok).alias("approved_amount"), total("chargeback_amount", ok).alias("chargeback_amount"),
    )
    scenario = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"), F.lit(cards).alias("any_method"), F.lit(twice).alias("duplicates")) for n, name, cards, twice in SCENARIOS])).alias("s")
    dealt = parts.select("*", scenario).where((F.col("s.any_method") | F.col("is_chargeback_eligible")) & (F.col("s.duplicates") | ~F.col("is_duplicate_candidate")))
    summed = dealt.groupBy(F.col("s.n").alias("scenario_order"), F.col("s.name").alias("scenario")).agg(*[F.sum(c).alias(c) for c in ("attempt_count", "approved_count", "chargeback_transaction_count")], total("approved_amount").alias("approved_amount"), total("chargeback_amount").alias("chargeback_amount"))

    def percent(a: str, b: str) -> Column:
        return F.round(100 * ratio(a, b), 2)

    return summed.select(
        "scenario_order", "scenario", "attempt_count", "approved_count", percent("approved_count", "attempt_count").alias("approval_rate_pct"), "chargeback_transaction_count",
        percent("chargeback_transaction_count", "approved_count").alias("chargeback_rate_qty_pct"), "approved_amount", "chargeback_amount", percent("chargeback_amount", "approved_amount").alias("chargeback_rate_amount_pct"),
    ).orderBy("scenario_order")
