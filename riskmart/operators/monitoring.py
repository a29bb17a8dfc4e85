"""Monitoring: what changed although every row is valid."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import ratio, total


def _z(x: str, w) -> Column:
    """Deviations from the mean of the rows before; null without a spread."""
    return (F.col(x) - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))


def daily_risk_health(attempts: DataFrame, config: Config) -> DataFrame:
    """Day: rates and how far they are from the 28 days with attempts before. The window is over one row a day."""
    daily = attempts.groupBy(F.col("cohort_date").alias("metric_date")).agg(
        F.count("*").alias("attempt_count"),
        F.count_if("is_approved").alias("_approved"),
        F.count_if(F.col("decline_source") == "risk_engine").alias("_rejected"),
        F.count_if("is_approved_without_risk_evaluation").alias("_blind"),
        F.count_if("is_duplicate_candidate").alias("duplicate_candidate_count"),
        F.count_if(F.col("decline_source") == "technical_error").alias("technical_error_count"),
        F.avg("risk_score").alias("avg_risk_score"),
    )
    rated = daily.withColumns({"approval_rate": ratio("_approved", "attempt_count"), "risk_reject_rate": ratio("_rejected", "attempt_count"), "approved_without_evaluation_rate": ratio("_blind", "_approved")})
    w = Window.orderBy("metric_date").rowsBetween(-config.baseline_days, -1)
    scored = rated.withColumns({"zscore_attempts": _z("attempt_count", w), "zscore_approval_rate": _z("approval_rate", w), "zscore_risk_reject_rate": _z("risk_reject_rate", w)})
    status = (
        F.when(F.col("approved_without_evaluation_rate") > config.fail_open_rate, "P1_fail_open_motor")
        .when(F.abs("zscore_risk_reject_rate") > config.z_limit, "P2_regra_disparando_fora_do_padrao")
        .when(F.abs("zscore_attempts") > config.z_limit, "P2_volume_anomalo")
        .when(F.col("duplicate_candidate_count") > 0, "P3_duplicidade")
        .otherwise("ok")
    )
    return scored.select("metric_date", "attempt_count", "approval_rate", "risk_reject_rate", "approved_without_evaluation_rate", "duplicate_candidate_count", "technical_error_count", "avg_risk_score", "zscore_attempts", "zscore_approval_rate", "zscore_risk_reject_rate", status.alias("alert_status"))


def score_psi(attempts: DataFrame, config: Config) -> DataFrame:
    """Day: population stability of the score against the 28 calendar days before. On the dense grid of days and ten buckets a range window over day numbers takes the place of a range join."""
    bucket = F.least(F.floor(F.col("risk_score") / 10), F.lit(9)).cast("int")
    found = attempts.where("risk_score is not null").groupBy(F.col("cohort_date").alias("metric_date"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # One row a day with the counts of all ten buckets, then one row for each: no join for the grid.
    counts = found.groupBy("metric_date").agg(*[F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(f"_{b}") for b in range(10)])
    grid = counts.select("metric_date", F.posexplode(F.array(*[F.col(f"_{b}") for b in range(10)])).alias("bucket", "n"))
    day = F.datediff("metric_date", F.lit(date(1970, 1, 1)))
    before = Window.partitionBy("bucket").orderBy(day).rangeBetween(-config.baseline_days, -1)
    seen = F.sum("n").over(before)
    grid = grid.withColumn("expected", F.when(seen > 0, seen))
    of_day = Window.partitionBy("metric_date")
    shares = grid.select(
        "metric_date",
        F.greatest(ratio("n", F.sum("n").over(of_day)), F.lit(config.psi_floor)).alias("a"),
        F.greatest(F.coalesce(ratio("expected", F.sum("expected").over(of_day)), F.lit(0.0)), F.lit(config.psi_floor)).alias("e"),
        F.col("expected").isNotNull().alias("based"),
    )
    summed = shares.groupBy("metric_date").agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"), F.bool_or("based").alias("based"))
    status = F.when(~F.col("based"), "sem_base_historica").when(F.col("psi") > config.psi_severe, "P1_drift_severo").when(F.col("psi") > config.psi_moderate, "P2_drift_moderado").otherwise("ok")
    return summed.select("metric_date", F.when(F.col("based"), F.col("psi")).alias("psi"), status.alias("alert_status"))


def rule_trigger_health(hits: DataFrame, evaluations: DataFrame, attempts: DataFrame, config: Config) -> DataFrame:
    """Day and rule that decides: its share of evaluated attempts, against the rule's own 28 observed days before."""
    paid = attempts.select("transaction_id", F.col("cohort_date").alias("metric_date"))
    hit = hits.where("not is_shadow").select("evaluation_id", "rule_id").join(evaluations.select("evaluation_id", "transaction_id"), "evaluation_id").join(paid, "transaction_id")
    volume = attempts.where("evaluation_id is not null").groupBy(F.col("cohort_date").alias("metric_date")).agg(F.count("*").alias("evaluated"))
    daily = hit.groupBy("metric_date", "rule_id").agg(F.count("*").alias("n")).join(volume, "metric_date").select("metric_date", "rule_id", ratio("n", "evaluated").alias("hit_rate"))
    w = Window.partitionBy("rule_id").orderBy("metric_date").rowsBetween(-config.baseline_days, -1)
    scored = daily.withColumns({"baseline_hit_rate": F.avg("hit_rate").over(w), "zscore_hit_rate": _z("hit_rate", w)})
    status = F.when(F.abs("zscore_hit_rate") > config.z_limit, "P2_regra_fora_do_padrao").when(F.col("baseline_hit_rate").isNull(), "sem_base_historica").otherwise("ok")
    return scored.withColumn("alert_status", status)


def maturation_curve(chargebacks: DataFrame, config: Config) -> DataFrame:
    """How much of the chargeback amount has come after so many days; at most seven rows."""
    bucket = F.when(F.lit(False), 0)
    for d in config.maturation_days:
        bucket = bucket.when(F.col("days_to_chargeback") <= d, d)
    buckets = chargebacks.where("not is_orphan").groupBy(bucket.otherwise(999).alias("days_bucket")).agg(F.count("*").alias("cb_count"), total("cb_amount").alias("cb_amount"))
    so_far, all_ = F.sum("cb_amount").over(Window.orderBy("days_bucket")), F.sum("cb_amount").over(Window.partitionBy())
    return buckets.select("days_bucket", "cb_count", "cb_amount", ratio(so_far, all_).alias("cumulative_share_amount"), (F.col("days_bucket") > config.maturity_days).alias("is_beyond_agreed_window")).orderBy("days_bucket")
