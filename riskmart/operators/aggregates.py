"""Aggregates. Only sums and counts are kept where rates are meant to be rolled up further."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import TOTAL, as_of, days_between, month, ratio, total, total0, zero


def approval_daily(attempts: DataFrame) -> DataFrame:
    """Day and method: attempts by where they were declined, and orders that any attempt got approved. One shuffle of partial sums by order, and the attempts' sums are added up from those."""
    origin, kind = F.col("decline_source"), F.col("issuer_decline_type")
    counts = {
        "attempt_count": F.lit(True), "approved_count": F.col("is_approved"), "declined_by_risk_count": origin == "risk_engine", "declined_by_manual_review_count": origin == "manual_review",
        "declined_by_issuer_count": origin == "issuer_or_acquirer", "issuer_soft_decline_count": kind == "soft", "issuer_hard_decline_count": kind == "hard", "technical_error_count": origin == "technical_error",
        "declined_unknown_count": origin == "unknown_no_risk_evaluation", "manual_review_count": F.col("decision_source") == "manual_review", "duplicate_candidate_count": F.col("is_duplicate_candidate"),
        "approved_without_risk_evaluation_count": F.col("is_approved_without_risk_evaluation"),
    }
    by_order = attempts.groupBy("cohort_date", "payment_method", "order_id").agg(
        *[F.count_if(c).alias(k) for k, c in counts.items()],
        total0("amount").alias("attempted_amount"),
        total0("amount", F.col("is_approved")).alias("approved_amount"),
    )
    is_order = F.col("order_id").isNotNull()
    return by_order.groupBy(F.col("cohort_date").alias("transaction_date"), "payment_method").agg(
        *[F.sum(k).alias(k) for k in counts],
        total0("attempted_amount").alias("attempted_amount"),
        total0("approved_amount").alias("approved_amount"),
        F.count_if(is_order).alias("order_count"),
        F.count_if(is_order & (F.col("approved_count") > 0)).alias("approved_order_count"),
    )


def cohort_daily(attempts: DataFrame) -> DataFrame:
    """Sale date and method; what a late chargeback changes. Nothing here depends on the day it is made."""
    ok, once, labeled = F.col("is_approved"), F.col("is_approved") & ~F.col("is_duplicate_candidate"), F.col("is_approved") & F.col("is_fraud_labeled")
    return attempts.groupBy("cohort_date", "payment_method").agg(
        F.bool_or("is_chargeback_eligible").alias("is_chargeback_eligible"),
        F.count("*").alias("attempt_count"),
        F.count_if(ok).alias("approved_count"),
        total0("amount", ok).alias("approved_amount"),
        F.count_if(ok & F.col("has_chargeback")).alias("chargeback_transaction_count"),
        F.count_if(ok & F.col("has_fraud_chargeback")).alias("fraud_chargeback_transaction_count"),
        total0("chargeback_amount", ok).alias("chargeback_amount"),
        total0("fraud_chargeback_amount", ok).alias("fraud_chargeback_amount"),
        F.count_if(once).alias("approved_count_dedup"),
        total0("amount", once).alias("approved_amount_dedup"),
        F.count_if(labeled).alias("fraud_labeled_count"),
        total0("amount", labeled).alias("fraud_labeled_amount"),
        total0("fraud_refund_amount", ok).alias("fraud_refund_amount"),
        F.max("_updated_at").alias("_updated_at"),
    )


def _band(score: Column, bounds: tuple[int, ...]) -> Column:
    """The band's label: its first and last score; scores end at 100."""
    label, low = F.when(score.isNull(), "sem_score"), 0
    for high in bounds:
        label = label.when(score < high, f"{low:02}-{high - 1}")
        low = high
    return label.otherwise(f"{low}-100")


def rule_performance(attempts: DataFrame, config: Config) -> DataFrame:
    let, blocked = F.col("risk_action") == "approve", F.col("risk_action") == "reject"
    missed = let & F.col("has_fraud_chargeback")
    keys = [
        F.col("cohort_date").alias("transaction_date"),
        F.coalesce("rule_triggered", F.lit("no_rule")).alias("rule_triggered"),
        F.coalesce("decision_source", F.lit("no_evaluation")).alias("decision_source"),
        _band(F.col("risk_score"), config.score_bands).alias("score_band"),
    ]
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("transaction_count"),
        F.count_if(let).alias("risk_approved_count"),
        F.count_if(blocked).alias("risk_rejected_count"),
        F.count_if(missed).alias("false_negative_count"),
        total0("amount", missed).alias("false_negative_amount"),
        total0("amount", blocked).alias("rejected_amount"),
        F.avg("risk_score").alias("avg_risk_score"),
    )


def rule_hits_on_attempts(hits: DataFrame, evaluations: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each hit of a rule with the attempt it was on, and how many hits that attempt had."""
    paid = attempts.select("transaction_id", "cohort_date", "amount", "is_approved", "is_fraud_labeled")
    of = evaluations.select("evaluation_id", "transaction_id")
    hit = hits.select("evaluation_id", "rule_id", "rule_version", "is_shadow", "rule_decision").join(of, "evaluation_id").join(paid, "transaction_id")
    return hit.withColumn("on_transaction", F.count("*").over(Window.partitionBy("transaction_id")))


_RULE = ["rule_id", "rule_version", "rule_mode"]


def rule_sums(hit: DataFrame, *by: str) -> DataFrame:
    """Additive counts of each version of a rule in each mode, by more columns if there are any."""
    fraud, blocks = F.col("is_fraud_labeled"), F.col("rule_decision") == "reject"
    return hit.groupBy(*by, "rule_id", "rule_version", F.when(F.col("is_shadow"), "shadow").otherwise("enforced").alias("rule_mode")).agg(
        F.count("*").alias("hit_count"),
        F.count_if(blocks).alias("would_reject_count"),
        F.count_if(fraud).alias("hits_on_fraud"),
        F.count_if(blocks & F.col("is_approved") & ~fraud).alias("good_approved_would_block_count"),
        total0("amount", blocks & fraud).alias("fraud_amount_would_block"),
        F.count_if(F.col("on_transaction") > 1).alias("shared_hit_count"),
    )


def rule_shares(summed: DataFrame, every: DataFrame) -> DataFrame:
    """Rates of a rule's sums; every has one row with the number of attempts labelled as fraud."""
    return summed.crossJoin(F.broadcast(every)).select(
        *_RULE, "hit_count", "would_reject_count", "hits_on_fraud",
        ratio("hits_on_fraud", "hit_count").alias("precision_on_labeled"), ratio("hits_on_fraud", "fraud_count").alias("fraud_coverage"),
        "good_approved_would_block_count", "fraud_amount_would_block", ratio("shared_hit_count", "hit_count").alias("overlap_share"),
    )


def rule_shares_of_days(daily: DataFrame, fraud_daily: DataFrame) -> DataFrame:
    """The same from sums kept by day."""
    sums = [F.sum(c).cast("bigint" if c.endswith("count") or c == "hits_on_fraud" else TOTAL).alias(c) for c in daily.columns if c not in (*_RULE, "cohort_date")]
    return rule_shares(daily.groupBy(*_RULE).agg(*sums), fraud_daily.agg(F.coalesce(F.sum("fraud_count"), F.lit(0)).alias("fraud_count")))


def rule_backtest(hits: DataFrame, evaluations: DataFrame, attempts: DataFrame) -> DataFrame:
    """What each version of a rule caught or would have caught, in each mode."""
    return rule_shares(rule_sums(rule_hits_on_attempts(hits, evaluations, attempts)), attempts.agg(F.count_if("is_fraud_labeled").alias("fraud_count")))  # one row


_SPINE = ["merchant_id", "card_network", "month_start"]


_NETWORK_COUNTS = ["settled_count", "settled_amount", "fraud_report_count", "dispute_count", "fraud_dispute_count", "fraud_dispute_amount"]


def _network_part(df: DataFrame, at: str, *by: str, **given: Column) -> DataFrame:
    columns = {c: F.lit(None if "amount" in c else 0) for c in _NETWORK_COUNTS} | given
    return df.select(*by, "merchant_id", "card_network", month(at).alias("month_start"), *[c.cast(TOTAL if "amount" in k else "bigint").alias(k) for k, c in columns.items()])


def settled(attempts: DataFrame, *by: str) -> DataFrame:
    """Settled card payments as rows of the programmes' counts."""
    return _network_part(attempts.where("is_chargeback_eligible and merchant_id is not null and is_settled"), "settled_at", *by, settled_count=F.lit(1), settled_amount=F.col("amount"))


def reported_frauds(attempts: DataFrame, reports: DataFrame) -> DataFrame:
    """Issuers' fraud reports with the merchant of the card payment."""
    card = attempts.where("is_chargeback_eligible and merchant_id is not null")
    return reports.select("report_id", "transaction_id", "card_network", "reported_at").join(card.select("transaction_id", "merchant_id"), "transaction_id")


def reported(frauds: DataFrame) -> DataFrame:
    return _network_part(frauds, "reported_at", fraud_report_count=F.lit(1))


def disputed(chargebacks: DataFrame) -> DataFrame:
    fraud = F.col("is_fraud_reason")
    return _network_part(chargebacks.where("merchant_id is not null"), "chargeback_at", dispute_count=F.lit(1), fraud_dispute_count=fraud.cast("int"), fraud_dispute_amount=F.when(fraud, F.col("cb_amount")))


def network_sums(parts: DataFrame, *by: str) -> DataFrame:
    """Counts of merchant, network and month."""
    return parts.groupBy(*by, *_SPINE).agg(*[zero(F.sum(c), TOTAL if "amount" in c else "bigint").alias(c) for c in _NETWORK_COUNTS])


def network_monitoring(attempts: DataFrame, reports: DataFrame, chargebacks: DataFrame, config: Config) -> DataFrame:
    """Merchant, network and calendar month of settlement, report and notification: the card schemes' programmes. Every count is a column of one union that is aggregated once; the month before is the settled count of a month, moved on by one."""
    return network_status(network_sums(settled(attempts).unionByName(reported(reported_frauds(attempts, reports))).unionByName(disputed(chargebacks))), config)


def network_status(summed: DataFrame, config: Config) -> DataFrame:
    """Ratios and states of the programmes from network_sums()."""
    # Rows without network or month are in the union, but meet no equality: their numbers are zero.
    full = F.col("card_network").isNotNull() & F.col("month_start").isNotNull()
    summed = summed.select(*_SPINE, *[F.when(full, F.col(c)).otherwise(F.lit(0)).cast(TOTAL if "amount" in c else "bigint").alias(c) for c in _NETWORK_COUNTS])
    before = summed.where("settled_count > 0").select("merchant_id", "card_network", F.add_months("month_start", 1).alias("month_start"), F.col("settled_count").alias("previous_month_settled_count"))
    monthly = summed.join(before, _SPINE, "left").withColumn("previous_month_settled_count", zero("previous_month_settled_count", "bigint"))
    today, next_month = as_of(config.as_of), F.add_months("month_start", 1)
    visa, mastercard = F.col("card_network") == "visa", F.col("card_network") == "mastercard"
    cases = F.col("fraud_report_count") + F.col("dispute_count")
    pace = days_between("month_start", next_month).cast("double") / F.greatest(days_between("month_start", today) + 1, F.lit(1)).cast("double")
    out = monthly.withColumns({
        "visa_vamp_ratio": F.when(visa, ratio(cases, "settled_count")),
        "mc_ecm_ratio": F.when(mastercard, ratio("dispute_count", "previous_month_settled_count")),
        "mc_efm_fraud_bps": F.when(mastercard, 10000 * ratio("fraud_dispute_amount", "settled_amount")),
        "projection_factor": F.when(F.col("month_start") == month(today), pace).otherwise(F.lit(1.0)),
    })
    pace, vamp, ecm, warn = F.col("projection_factor"), F.col("visa_vamp_ratio"), F.col("mc_ecm_ratio"), config.early_warning_share
    # These, and the two states by name below.
    over, early, fine = "acima_do_limite", "alerta_preventivo", "ok"
    return out.withColumns({
        "projected_dispute_count": F.round(F.col("dispute_count") * pace),
        "projected_settled_count": F.round(F.col("settled_count") * pace),
        "visa_vamp_status": F.when(visa & (cases * pace < config.vamp_min_cases), "abaixo_do_piso_de_volume").when(vamp >= config.vamp_ratio, over).when(vamp >= config.vamp_ratio * warn, early).when(visa, fine),
        "mc_ecm_status": F.when(mastercard & (F.col("previous_month_settled_count") == 0), "sem_base_mes_anterior").when((ecm >= config.ecm_ratio) & (F.col("dispute_count") * pace >= config.ecm_min_chargebacks), over).when(ecm >= config.ecm_ratio * warn, early).when(mastercard, fine),
        "mc_efm_status": F.when(F.col("mc_efm_fraud_bps") >= config.efm_bps, over).when(mastercard, fine),
    })


_LOSSES = {"gross_chargeback_amount": "cb_amount", "gross_fraud_chargeback_amount": "_fraud", "net_chargeback_loss_amount": "net_loss_amount", "recovered_from_merchant_amount": "recovered_from_merchant_amount", "platform_unrecovered_amount": "platform_unrecovered_amount", "pix_med_claim_amount": "_claim", "pix_med_returned_amount": "_returned"}


def claims_of_merchants(claims: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Instant-payment claims with the merchant of the payment."""
    return claims.select("claim_id", "transaction_id", "claimed_at", "claim_amount", "returned_amount").join(enrichment.select("transaction_id", "merchant_id"), "transaction_id")


def loss_sums(chargebacks: DataFrame, merchant_claims: DataFrame) -> DataFrame:
    """Losses of merchant and month of notification: chargebacks and claims in one union."""
    none = F.lit(None).cast(TOTAL)
    cb = chargebacks.where("merchant_id is not null").withColumns({"_fraud": F.when(F.col("is_fraud_reason"), F.col("cb_amount")), "_claim": none, "_returned": none})
    cb = cb.select("merchant_id", month("chargeback_at").alias("month_start"), F.lit(1).alias("_n"), *[F.col(c).cast(TOTAL).alias(k) for k, c in _LOSSES.items()])
    of = {"pix_med_claim_amount": F.col("claim_amount"), "pix_med_returned_amount": F.col("returned_amount")}
    med = merchant_claims.select("merchant_id", month("claimed_at").alias("month_start"), F.lit(0).alias("_n"), *[of.get(k, F.lit(None)).cast(TOTAL).alias(k) for k in _LOSSES])
    return cb.unionByName(med).groupBy("merchant_id", "month_start").agg(F.sum("_n").alias("chargeback_count"), *[zero(F.sum(k)).alias(k) for k in _LOSSES])


def losses_with_merchants(summed: DataFrame, merchants: DataFrame) -> DataFrame:
    """loss_sums() with what is known of the merchant."""
    # Keys that are null stand in the union but meet nothing.
    known = F.col("merchant_id").isNotNull() & F.col("month_start").isNotNull()
    summed = summed.withColumns({k: F.when(known, F.col(k)).otherwise(F.lit(0)).cast("bigint" if k == "chargeback_count" else TOTAL) for k in ["chargeback_count", *_LOSSES]})
    joined = summed.join(merchants.drop("_ingested_at"), "merchant_id", "left")
    return joined.select(
        "merchant_id", "segment", "mcc", days_between("merchant_created_at", "month_start").alias("merchant_age_days"), "month_start", "chargeback_count",
        *[k for k in _LOSSES if k != "pix_med_returned_amount"], (F.col("pix_med_claim_amount") - F.col("pix_med_returned_amount")).cast(TOTAL).alias("pix_med_net_loss_amount"),
    )


def merchant_loss(chargebacks: DataFrame, claims: DataFrame, enrichment: DataFrame, merchants: DataFrame) -> DataFrame:
    """Merchant and month of notification: chargebacks and instant-payment claims."""
    return losses_with_merchants(loss_sums(chargebacks, claims_of_merchants(claims, enrichment)), merchants)
