"""Facts: payment attempts, chargebacks, fraud evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart import schemas
from riskmart.config import Config
from riskmart.functions.columns import MONEY, days_between, total, zero


def _decline_source() -> Column:
    action, human = F.col("risk_action"), F.col("decision_source").isin("manual_review", "partner_review")
    return (
        F.when(F.col("status") == "approved", None)
        .when(F.col("status") == "error", "technical_error")
        .when((action == "reject") & human, "manual_review")
        .when(action == "reject", "risk_engine")
        .when(action == "review", "manual_review")
        .when(~F.col("_evaluated"), "unknown_no_risk_evaluation")
        .otherwise("issuer_or_acquirer")
    )


def _issuer_decline_type() -> Column:
    return F.when(F.col("status") != "declined", None).when(F.col("risk_action").isin("reject", "review"), None).otherwise(F.coalesce("decline_type", F.lit("unknown")))


def watermarks(sources: dict[str, DataFrame]) -> DataFrame:
    """One row: for each column name the latest stamp of its source, 1900-01-01 for an empty one."""
    epoch = F.lit("1900-01-01").cast("timestamp_ntz")
    rows = [df.agg(F.coalesce(F.max("_ingested_at"), epoch).alias(name)) for name, df in sources.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # one row each
    return out


def _joined(transactions: DataFrame, chargebacks: DataFrame, duplicates: DataFrame, labels: DataFrame, refunds: DataFrame, *more: DataFrame) -> DataFrame:
    """Transactions with what came of them, and more sides with a row for a transaction. All joins are on transaction_id: one partitioning serves them."""
    refunded = refunds.groupBy("transaction_id").agg(total("refund_amount").alias("_refund"), total("refund_amount", F.col("is_fraud_refund")).alias("_fraud_refund"))
    cb = chargebacks.select("transaction_id", "has_fraud_chargeback", "chargeback_count", "chargeback_amount", "fraud_chargeback_amount", "first_chargeback_at", F.lit(True).alias("_charged"))
    label = labels.select("transaction_id", "first_fraud_label_at", "first_fraud_label_source", "fraud_label_sources", F.lit(True).alias("_labeled"))
    dup = duplicates.select("transaction_id", "is_duplicate_candidate", F.col("first_transaction_id_in_group").alias("duplicate_of_transaction_id"))
    joined = transactions.drop("_ingested_at")
    for side in (*more, cb, dup, label, refunded):
        joined = joined.join(side, "transaction_id", "left")
    false = F.lit(False)
    return joined.withColumns({
        "cohort_date": F.col("transaction_date"),
        "has_chargeback": F.coalesce("_charged", false),
        "has_fraud_chargeback": F.coalesce("has_fraud_chargeback", false),
        "chargeback_count": zero("chargeback_count", "bigint"),
        "chargeback_amount": zero("chargeback_amount"),
        "fraud_chargeback_amount": zero("fraud_chargeback_amount"),
        "days_to_first_chargeback": days_between("transaction_at", "first_chargeback_at"),
        "is_fraud_labeled": F.coalesce("_labeled", false),
        "days_to_fraud_label": days_between("transaction_at", "first_fraud_label_at"),
        "refund_amount": zero("_refund"),
        "fraud_refund_amount": zero("_fraud_refund"),
        "is_duplicate_candidate": F.coalesce("is_duplicate_candidate", false),
        "_updated_at": F.current_timestamp(),
    })


def _typed(joined: DataFrame) -> DataFrame:
    have = set(joined.columns)
    return joined.select(*[F.col(c).cast(kind).alias(c) for c, kind in schemas.ATTEMPTS.items() if c in have])


def sales(transactions: DataFrame, chargebacks: DataFrame, duplicates: DataFrame, labels: DataFrame, refunds: DataFrame) -> DataFrame:
    """The rows of payment_attempts with the columns that need neither evaluations nor enrichment, of which each transaction has one row at most: all that cohorts sum."""
    return _typed(_joined(transactions, chargebacks, duplicates, labels, refunds))


def payment_attempts(
    transactions: DataFrame, risk: DataFrame, chargebacks: DataFrame, duplicates: DataFrame, enrichment: DataFrame, response_codes: DataFrame, labels: DataFrame, refunds: DataFrame
) -> DataFrame:
    """One row for each transaction with all that is known of it; nothing is filtered, oddities are flags."""
    risk_ = risk.select("transaction_id", "evaluation_id", "risk_score", "risk_action", "rule_triggered", "decision_source", "evaluation_count", F.lit(True).alias("_evaluated"))
    joined = _joined(transactions, chargebacks, duplicates, labels, refunds, risk_, enrichment.drop("_ingested_at"))
    joined = joined.join(F.broadcast(response_codes.select("issuer_response_code", "decline_type")), "issuer_response_code", "left")  # 13 rows
    false = F.lit(False)
    joined = joined.withColumn("_evaluated", F.coalesce("_evaluated", false))
    return _typed(joined.withColumns({
        "is_3ds_authenticated": F.col("three_ds_result") == "authenticated",
        "decline_source": _decline_source(),
        "issuer_decline_type": _issuer_decline_type(),
        "is_settled": F.coalesce(F.col("capture_status") == "captured", false),
        "evaluation_count": zero("evaluation_count", "bigint"),
        "is_approved_without_risk_evaluation": F.col("is_approved") & ~F.col("_evaluated"),
        "is_approved_despite_risk_reject": F.coalesce(F.col("is_approved") & (F.col("risk_action") == "reject"), false),
    }))


def with_watermarks(attempts: DataFrame, marks: DataFrame) -> DataFrame:
    """The whole contract: attempts with the one row of watermarks."""
    return attempts.crossJoin(F.broadcast(marks)).select(*schemas.ATTEMPTS)


def chargebacks(staged: DataFrame, transactions: DataFrame, enrichment: DataFrame, outcomes: DataFrame, config: Config) -> DataFrame:
    """One row for each chargeback with its sale, its dispute and what was lost."""
    sale = transactions.select("transaction_id", "transaction_at", F.col("transaction_date").alias("cohort_date"), "payment_method", F.col("status").alias("transaction_status"), F.col("amount").alias("transaction_amount"), F.lit(True).alias("_sold"))
    extra = enrichment.select("transaction_id", "merchant_id", "card_network", "three_ds_result")
    dispute = outcomes.drop("_ingested_at")
    joined = staged.join(sale, "transaction_id", "left").join(extra, "transaction_id", "left").join(dispute, "chargeback_id", "left")
    lost = F.col("cb_amount") - F.coalesce("recovered_amount", F.lit(0))
    days, none = days_between("transaction_at", "chargeback_at"), F.lit(0)
    return joined.select(
        "chargeback_id", "transaction_id", "merchant_id", "card_network", "chargeback_at", F.col("chargeback_at").cast("date").alias("chargeback_date"),
        "cohort_date", "payment_method", "transaction_status", "transaction_amount", "reason_code_raw", "network_reason_code", "reason_category", "is_fraud_reason", "cb_amount",
        days.alias("days_to_chargeback"),
        F.coalesce(days > config.maturity_days, F.lit(False)).alias("is_beyond_maturity_window"),
        F.coalesce(F.col("three_ds_result") == "authenticated", F.lit(False)).alias("is_3ds_authenticated"),
        F.coalesce("dispute_stage", F.lit("first_chargeback")).alias("dispute_stage"),
        F.coalesce("outcome", F.lit("open")).alias("dispute_outcome"),
        "resolved_at",
        zero("recovered_amount", MONEY).alias("recovered_in_dispute_amount"),
        zero("recovered_from_merchant_amount", MONEY).alias("recovered_from_merchant_amount"),
        lost.cast(MONEY).alias("net_loss_amount"),
        F.greatest((lost - F.coalesce("recovered_from_merchant_amount", none)).cast(MONEY), none.cast(MONEY)).alias("platform_unrecovered_amount"),
        F.col("_sold").isNull().alias("is_orphan"),
        F.coalesce(F.col("transaction_status") != "approved", F.lit(True)).alias("is_on_non_approved_transaction"),
        F.coalesce(F.col("cb_amount") > F.col("transaction_amount"), F.lit(False)).alias("is_amount_above_transaction"),
        "_ingested_at",
    )


def fraud_labels(reports: DataFrame, staged_chargebacks: DataFrame, refunds: DataFrame, alerts: DataFrame, claims: DataFrame) -> DataFrame:
    """One row for each piece of evidence, of five sources. It reads staged chargebacks, not the fact: no cycle."""
    kinds = [
        ("issuer_fraud_report", reports, "report_id", "reported_at", None),
        ("chargeback_fraud", staged_chargebacks.where("is_fraud_reason"), "chargeback_id", "chargeback_at", "cb_amount"),
        ("fraud_refund", refunds.where("is_fraud_refund"), "refund_id", "refunded_at", "refund_amount"),
        ("dispute_alert", alerts.where(F.col("alert_type").contains("fraud")), "alert_id", "alerted_at", None),
        ("pix_med_claim", claims, "claim_id", "claimed_at", "claim_amount"),
    ]
    out = None
    for source, df, key, at, amount in kinds:
        part = df.select("transaction_id", F.col(key).alias("evidence_id"), F.lit(source).alias("label_source"), F.col(at).alias("label_at"), (F.col(amount) if amount else F.lit(None)).cast(MONEY).alias("evidence_amount"), "_ingested_at")
        out = part if out is None else out.unionByName(part)
    return out
