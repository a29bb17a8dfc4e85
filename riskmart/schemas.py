"""Declared schemas: raw feeds (all business fields are strings) and the contract of the attempts fact."""

from __future__ import annotations

_RAW = {
    "raw_transactions": "transaction_id user_id transaction_at amount status payment_method",
    "raw_risk_evaluations": "evaluation_id transaction_id evaluated_at risk_score risk_action rule_triggered",
    "raw_chargebacks": "chargeback_id transaction_id chargeback_at reason_code cb_amount",
    "raw_payment_enrichment": "transaction_id merchant_id order_id country card_network card_fingerprint bin three_ds_result issuer_response_code capture_status settled_at payout_term_days currency",
    "raw_merchants": "merchant_id mcc segment created_at",
    "raw_issuer_fraud_reports": "report_id transaction_id card_network reported_at fraud_type",
    "raw_refunds": "refund_id transaction_id refunded_at refund_amount refund_reason",
    "raw_dispute_alerts": "alert_id transaction_id alert_provider alerted_at alert_type action_taken",
    "raw_pix_med_claims": "claim_id transaction_id claimed_at claim_amount claim_status returned_amount",
    "raw_chargeback_outcomes": "chargeback_id dispute_stage outcome resolved_at recovered_amount recovered_from_merchant_amount",
    "raw_risk_rule_hits": "evaluation_id rule_id rule_version is_shadow rule_decision",
}
RAW_FIELDS: dict[str, list[str]] = {k: v.split() for k, v in _RAW.items()}
#: DDL of each raw table as it is kept.
RAW: dict[str, str] = {k: ", ".join(f"{c} string" for c in v) + ", _ingested_at timestamp_ntz" for k, v in RAW_FIELDS.items()}
#: DDL of what arrives on a feed, before it is stamped.
FEED: dict[str, str] = {k: ", ".join(f"{c} string" for c in v) for k, v in RAW_FIELDS.items()}

WATERMARKS = ["_tx_watermark", "_eval_watermark", "_cb_watermark", "_enrichment_watermark", "_label_watermark", "_refund_watermark"]
#: The contract of the attempts fact: columns with types, in order.
ATTEMPTS: dict[str, str] = {
    "transaction_id": "string", "user_id": "string", "merchant_id": "string", "order_id": "string", "country": "string",
    "transaction_at": "timestamp_ntz", "cohort_date": "date", "amount": "decimal(18,2)", "currency": "string", "status": "string",
    "payment_method": "string", "card_network": "string", "is_chargeback_eligible": "boolean", "three_ds_result": "string",
    "is_3ds_authenticated": "boolean", "is_approved": "boolean", "decline_source": "string", "issuer_decline_type": "string",
    "issuer_response_code": "string", "capture_status": "string", "settled_at": "timestamp_ntz", "payout_term_days": "int",
    "is_settled": "boolean", "evaluation_id": "string", "risk_score": "int", "risk_action": "string", "rule_triggered": "string",
    "decision_source": "string", "evaluation_count": "bigint", "has_chargeback": "boolean", "has_fraud_chargeback": "boolean",
    "chargeback_count": "bigint", "chargeback_amount": "decimal(38,2)", "fraud_chargeback_amount": "decimal(38,2)",
    "first_chargeback_at": "timestamp_ntz", "days_to_first_chargeback": "bigint", "is_fraud_labeled": "boolean",
    "first_fraud_label_at": "timestamp_ntz", "first_fraud_label_source": "string", "fraud_label_sources": "string",
    "days_to_fraud_label": "bigint", "refund_amount": "decimal(38,2)", "fraud_refund_amount": "decimal(38,2)",
    "is_approved_without_risk_evaluation": "boolean", "is_approved_despite_risk_reject": "boolean",
    "is_duplicate_candidate": "boolean", "duplicate_of_transaction_id": "string",
    **{c: "timestamp_ntz" for c in WATERMARKS}, "_updated_at": "timestamp",
}
