"""Typed, trimmed feeds with one row for each key: the version that came last.

A feed is declared as columns with the expression that makes each; `_stage` does what all feeds have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import code, filled, moment, money, text, whole
from riskmart.functions.frames import latest_by

#: Fixed values.
FRAUD_REFUND_REASONS = ["fraud_alert", "fraud_confirmed", "dispute_alert"]
REASON_CODE = r"^([0-9]+(\.[0-9]+)?)"


def _stage(raw: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    return latest_by(raw.select(*[c.alias(k) for k, c in columns.items()], "_ingested_at"), *keys)


def transactions(raw: DataFrame, config: Config) -> DataFrame:
    staged = _stage(raw, ["transaction_id"], {
        "transaction_id": text("transaction_id"), "user_id": text("user_id"), "transaction_at": moment("transaction_at"),
        "transaction_date": moment("transaction_at").cast("date"), "amount": money("amount"), "status": code("status"), "payment_method": code("payment_method"),
    })
    return staged.withColumns({"is_approved": F.col("status") == "approved", "is_chargeback_eligible": F.col("payment_method").isin(*config.eligible_methods)})


def evaluations(raw: DataFrame) -> DataFrame:
    staged = _stage(raw, ["evaluation_id"], {
        "evaluation_id": text("evaluation_id"), "transaction_id": text("transaction_id"), "evaluated_at": moment("evaluated_at"),
        "risk_score": whole("risk_score"), "risk_action": code("risk_action"), "rule_triggered": filled(code("rule_triggered")),
    })
    rule = F.col("rule_triggered")
    human = F.when(rule.startswith("rule_manual_review"), "manual_review").when(rule.startswith("rule_partner_review"), "partner_review")
    return staged.withColumn("decision_source", human.otherwise("automatic"))


def chargebacks(raw: DataFrame, reason_codes: DataFrame) -> DataFrame:
    """The category goes by the code alone, whatever network it is from; codes are unique in the lookup, which has 18 rows."""
    staged = _stage(raw, ["chargeback_id"], {
        "chargeback_id": text("chargeback_id"), "transaction_id": text("transaction_id"), "chargeback_at": moment("chargeback_at"),
        "reason_code_raw": text("reason_code"), "network_reason_code": F.regexp_extract(text("reason_code"), REASON_CODE, 1), "cb_amount": money("cb_amount"),
    })
    known = reason_codes.select(F.col("reason_code").alias("network_reason_code"), "reason_category")
    found = staged.join(F.broadcast(known), "network_reason_code", "left")
    category = F.coalesce("reason_category", F.lit("unmapped"))
    return found.select(*staged.columns, category.alias("reason_category"), (category == "fraud").alias("is_fraud_reason"))


def enrichment(raw: DataFrame) -> DataFrame:
    return _stage(raw, ["transaction_id"], {
        "transaction_id": text("transaction_id"), "merchant_id": text("merchant_id"), "order_id": text("order_id"), "country": F.upper(text("country")),
        "card_network": filled(code("card_network")), "card_fingerprint": filled(text("card_fingerprint")), "bin": filled(text("bin")),
        "three_ds_result": filled(code("three_ds_result")), "issuer_response_code": filled(text("issuer_response_code")), "capture_status": code("capture_status"),
        "settled_at": moment("settled_at"), "payout_term_days": whole("payout_term_days"), "currency": F.upper(text("currency")),
    })


def merchants(raw: DataFrame) -> DataFrame:
    return _stage(raw, ["merchant_id"], {"merchant_id": text("merchant_id"), "mcc": text("mcc"), "segment": code("segment"), "merchant_created_at": moment("created_at")})


def issuer_reports(raw: DataFrame) -> DataFrame:
    return _stage(raw, ["report_id"], {"report_id": text("report_id"), "transaction_id": text("transaction_id"), "card_network": code("card_network"), "reported_at": moment("reported_at"), "fraud_type": code("fraud_type")})


def refunds(raw: DataFrame) -> DataFrame:
    staged = _stage(raw, ["refund_id"], {"refund_id": text("refund_id"), "transaction_id": text("transaction_id"), "refunded_at": moment("refunded_at"), "refund_amount": money("refund_amount"), "refund_reason": code("refund_reason")})
    return staged.withColumn("is_fraud_refund", F.col("refund_reason").isin(FRAUD_REFUND_REASONS))


def alerts(raw: DataFrame) -> DataFrame:
    return _stage(raw, ["alert_id"], {"alert_id": text("alert_id"), "transaction_id": text("transaction_id"), "alert_provider": code("alert_provider"), "alerted_at": moment("alerted_at"), "alert_type": code("alert_type"), "action_taken": code("action_taken")})


def med_claims(raw: DataFrame) -> DataFrame:
    return _stage(raw, ["claim_id"], {"claim_id": text("claim_id"), "transaction_id": text("transaction_id"), "claimed_at": moment("claimed_at"), "claim_amount": money("claim_amount"), "claim_status": code("claim_status"), "returned_amount": _or_zero("returned_amount")})


def outcomes(raw: DataFrame) -> DataFrame:
    return _stage(raw, ["chargeback_id"], {
        "chargeback_id": text("chargeback_id"), "dispute_stage": code("dispute_stage"), "outcome": code("outcome"), "resolved_at": moment("resolved_at"),
        "recovered_amount": _or_zero("recovered_amount"), "recovered_from_merchant_amount": _or_zero("recovered_from_merchant_amount"),
    })


def rule_hits(raw: DataFrame) -> DataFrame:
    return _stage(raw, ["evaluation_id", "rule_id", "rule_version"], {"evaluation_id": text("evaluation_id"), "rule_id": text("rule_id"), "rule_version": whole("rule_version"), "is_shadow": code("is_shadow") == "true", "rule_decision": code("rule_decision")})


def _or_zero(c: str) -> Column:
    return F.coalesce(money(c), F.lit(0)).cast("decimal(18,2)")
