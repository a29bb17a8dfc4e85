"""The models in plain SQL, for another engine over the same tables: joins where the operators have windows, and windows where they have aggregates."""

from __future__ import annotations

import re

from riskmart.schemas import RAW_FIELDS
from riskmart.sources.adapter import CONFIGS, feed_sql
from riskmart.sources.lookups import REASON_CODES, RESPONSE_CODES

_D, _T = "decimal(18,2)", "decimal(38,2)"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(chr(39) + x + chr(39) for x in r) + ')' for r in rows)}) v({names})"


def _last(raw: str, keys: str, columns: str) -> str:
    """The last version of each key, typed."""
    return f"SELECT * EXCLUDE (nth) FROM (SELECT {columns}, _ingested_at, row_number() OVER (PARTITION BY {keys} ORDER BY _ingested_at DESC) AS nth FROM {raw}) WHERE nth = 1"


def _names(text: str, lower: str = "", upper: str = "", opt: str = "", optlower: str = "") -> str:
    parts = [f"trim({c}) AS {c}" for c in text.split()] + [f"lower(trim({c})) AS {c}" for c in lower.split()] + [f"upper(trim({c})) AS {c}" for c in upper.split()]
    return ", ".join(parts + [f"nullif(trim({c}), '') AS {c}" for c in opt.split()] + [f"nullif(lower(trim({c})), '') AS {c}" for c in optlower.split()])


def _cast(c: str, kind: str, name: str | None = None, default: str = "") -> str:
    e = f"try_cast({c} AS {kind})"
    return f"{f'CAST(coalesce({e}, {default}) AS {kind})' if default else e} AS {name or c}"


def _n(where: str) -> str:
    return f"CAST(count(CASE WHEN {where} THEN 1 END) AS bigint)"


def _sum(c: str, where: str = "true", zero: bool = True) -> str:
    e = f"sum(CASE WHEN {where} THEN {c} END)"
    return f"CAST({f'coalesce({e}, 0)' if zero else e} AS {_T})"


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS double) / nullif(CAST({b} AS double), 0))"


def _month(c: str) -> str:
    return f"CAST(date_trunc('month', {c}) AS date)"


def _days(a: str, b: str) -> str:
    return f"CAST(date_diff('day', CAST({a} AS date), CAST({b} AS date)) AS bigint)"


def _z(c: str) -> str:
    return f"(({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0))"


def _models(profile: str) -> dict[str, str]:
    c = CONFIGS[profile]
    today = f"DATE '{c.as_of}'"
    over = "'acima_do_limite'"
    early = "'alerta_preventivo'"
    spine = "merchant_id, card_network, month_start"
    on = "USING (merchant_id, card_network, month_start)"
    none = {name: f"SELECT {', '.join(f'CAST(NULL AS varchar) AS {c}' for c in fields)}, CAST(NULL AS timestamp) AS _ingested_at WHERE false" for name, fields in RAW_FIELDS.items()}
    return none | feed_sql(profile, "duckdb") | {
        "reasons": _values([(r[1], r[3]) for r in REASON_CODES], "reason_code, reason_category"),
        "responses": _values([(r[0], r[2]) for r in RESPONSE_CODES], "issuer_response_code, decline_type"),
        "stg_transactions": f"SELECT *, status = 'approved' AS is_approved, payment_method IN ('credit_card', 'debit_card') AS is_chargeback_eligible FROM ({_last('raw_transactions', 'trim(transaction_id)', _names('transaction_id user_id', 'status payment_method') + ', ' + _cast('transaction_at', 'timestamp') + ', ' + _cast('transaction_at', 'timestamp', 'x').replace(' AS x', '::date AS transaction_date') + ', ' + _cast('amount', _D))})",
        "stg_evaluations": f"SELECT *, CASE WHEN starts_with(rule_triggered, 'rule_manual_review') THEN 'manual_review' WHEN starts_with(rule_triggered, 'rule_partner_review') THEN 'partner_review' ELSE 'automatic' END AS decision_source FROM ({_last('raw_risk_evaluations', 'trim(evaluation_id)', _names('evaluation_id transaction_id', 'risk_action', optlower='rule_triggered') + ', ' + _cast('evaluated_at', 'timestamp') + ', ' + _cast('risk_score', 'integer'))})",
        "stg_chargebacks": f"SELECT s.*, coalesce(reason_category, 'unmapped') AS reason_category, coalesce(reason_category, 'unmapped') = 'fraud' AS is_fraud_reason FROM ({_last('raw_chargebacks', 'trim(chargeback_id)', _names('chargeback_id transaction_id') + ', ' + _cast('chargeback_at', 'timestamp') + ', trim(reason_code) AS reason_code_raw, regexp_extract(trim(reason_code), ' + chr(39) + '^([0-9]+([.][0-9]+)?)' + chr(39) + ', 1) AS network_reason_code, ' + _cast('cb_amount', _D))}) s LEFT JOIN reasons ON reason_code = network_reason_code",
        "stg_enrichment": _last("raw_payment_enrichment", "trim(transaction_id)", _names("transaction_id merchant_id order_id", "capture_status", "country currency", "card_fingerprint bin issuer_response_code", "card_network three_ds_result") + ", " + _cast("settled_at", "timestamp") + ", " + _cast("payout_term_days", "integer")),
        "stg_merchants": _last("raw_merchants", "trim(merchant_id)", _names("merchant_id mcc", "segment") + ", " + _cast("created_at", "timestamp", "merchant_created_at")),
        "stg_issuer_reports": _last("raw_issuer_fraud_reports", "trim(report_id)", _names("report_id transaction_id", "card_network fraud_type") + ", " + _cast("reported_at", "timestamp")),
        "stg_refunds": f"SELECT *, refund_reason IN ('fraud_alert', 'fraud_confirmed', 'dispute_alert') AS is_fraud_refund FROM ({_last('raw_refunds', 'trim(refund_id)', _names('refund_id transaction_id', 'refund_reason') + ', ' + _cast('refunded_at', 'timestamp') + ', ' + _cast('refund_amount', _D))})",
        "stg_alerts": _last("raw_dispute_alerts", "trim(alert_id)", _names("alert_id transaction_id", "alert_provider alert_type action_taken") + ", " + _cast("alerted_at", "timestamp")),
        "stg_med_claims": _last("raw_pix_med_claims", "trim(claim_id)", _names("claim_id transaction_id", "claim_status") + ", " + _cast("claimed_at", "timestamp") + ", " + _cast("claim_amount", _D) + ", " + _cast("returned_amount", _D, default="0")),
        "stg_outcomes": _last("raw_chargeback_outcomes", "trim(chargeback_id)", _names("chargeback_id", "dispute_stage outcome") + ", " + _cast("resolved_at", "timestamp") + ", " + _cast("recovered_amount", _D, default="0") + ", " + _cast("recovered_from_merchant_amount", _D, default="0")),
        "stg_rule_hits": _last("raw_risk_rule_hits", "trim(evaluation_id), trim(rule_id), rule_version", _names("evaluation_id rule_id", "rule_decision") + ", " + _cast("rule_version", "integer") + ", lower(trim(is_shadow)) = 'true' AS is_shadow"),
        "risk_decision": f"""SELECT transaction_id, evaluation_id, evaluated_at, risk_score, risk_action, rule_triggered, decision_source, pre AS is_pre_authorization, evaluation_count, post_authorization_evaluation_count FROM (
            SELECT e.*, pre, row_number() OVER (PARTITION BY e.transaction_id ORDER BY pre DESC, evaluated_at DESC, evaluation_id DESC) AS nth, count(*) OVER (PARTITION BY e.transaction_id) AS evaluation_count, count(CASE WHEN NOT pre THEN 1 END) OVER (PARTITION BY e.transaction_id) AS post_authorization_evaluation_count
            FROM (SELECT e.*, evaluated_at <= transaction_at + to_seconds({c.clock_skew_seconds}) AS pre FROM stg_evaluations e JOIN (SELECT transaction_id, transaction_at FROM stg_transactions) t USING (transaction_id)) e) WHERE nth = 1""",
        "chargebacks_per_tx": f"SELECT transaction_id, count(*) AS chargeback_count, {_sum('cb_amount', zero=False)} AS chargeback_amount, {_sum('cb_amount', 'is_fraud_reason', False)} AS fraud_chargeback_amount, bool_or(is_fraud_reason) AS has_fraud_chargeback, min(chargeback_at) AS first_chargeback_at, max(chargeback_at) AS last_chargeback_at, max(_ingested_at) AS last_chargeback_ingested_at FROM stg_chargebacks GROUP BY transaction_id",
        "fraud_labels": f"""SELECT transaction_id, report_id AS evidence_id, 'issuer_fraud_report' AS label_source, reported_at AS label_at, CAST(NULL AS {_D}) AS evidence_amount, _ingested_at FROM stg_issuer_reports
            UNION ALL SELECT transaction_id, chargeback_id, 'chargeback_fraud', chargeback_at, cb_amount, _ingested_at FROM stg_chargebacks WHERE reason_category = 'fraud'
            UNION ALL SELECT transaction_id, refund_id, 'fraud_refund', refunded_at, refund_amount, _ingested_at FROM stg_refunds WHERE refund_reason IN ('fraud_alert', 'fraud_confirmed', 'dispute_alert')
            UNION ALL SELECT transaction_id, alert_id, 'dispute_alert', alerted_at, NULL, _ingested_at FROM stg_alerts WHERE contains(alert_type, 'fraud')
            UNION ALL SELECT transaction_id, claim_id, 'pix_med_claim', claimed_at, claim_amount, _ingested_at FROM stg_med_claims""",
        "fraud_labels_per_tx": "SELECT transaction_id, min(label_at) AS first_fraud_label_at, first(label_source ORDER BY label_at, label_source) AS first_fraud_label_source, count(*) AS fraud_evidence_count, array_to_string(list_sort(list_distinct(list(label_source))), ',') AS fraud_label_sources FROM fraud_labels GROUP BY transaction_id",
        "duplicate_suspects": f"SELECT a.transaction_id, min(b.transaction_id) AS first_transaction_id_in_group, count(*) AS group_size, a.transaction_id <> min(b.transaction_id) AS is_duplicate_candidate FROM stg_transactions a JOIN stg_transactions b ON a.user_id = b.user_id AND a.amount = b.amount AND a.payment_method = b.payment_method AND abs(date_diff('second', a.transaction_at, b.transaction_at)) <= {c.duplicate_seconds} GROUP BY a.transaction_id HAVING count(*) > 1",
        "refunded": f"SELECT transaction_id, {_sum('refund_amount')} AS all_refunds, {_sum('refund_amount', 'is_fraud_refund')} AS fraud_refunds FROM stg_refunds GROUP BY transaction_id",
        "payment_attempts": f"""SELECT t.transaction_id, t.user_id, n.merchant_id, n.order_id, n.country, t.transaction_at, t.transaction_date AS cohort_date, t.amount, n.currency, t.status, t.payment_method, n.card_network, t.is_chargeback_eligible, n.three_ds_result,
            n.three_ds_result = 'authenticated' AS is_3ds_authenticated, t.is_approved,
            CASE WHEN t.is_approved THEN NULL WHEN t.status = 'error' THEN 'technical_error' WHEN r.transaction_id IS NULL THEN 'unknown_no_risk_evaluation' WHEN r.risk_action = 'review' OR (r.risk_action = 'reject' AND r.decision_source <> 'automatic') THEN 'manual_review' WHEN r.risk_action = 'reject' THEN 'risk_engine' ELSE 'issuer_or_acquirer' END AS decline_source,
            CASE WHEN t.status = 'declined' AND coalesce(r.risk_action, '-') NOT IN ('reject', 'review') THEN coalesce(s.decline_type, 'unknown') END AS issuer_decline_type,
            n.issuer_response_code, n.capture_status, n.settled_at, n.payout_term_days, coalesce(n.capture_status, '') = 'captured' AS is_settled, r.evaluation_id, r.risk_score, r.risk_action, r.rule_triggered, r.decision_source, coalesce(r.evaluation_count, 0) AS evaluation_count,
            b.transaction_id IS NOT NULL AS has_chargeback, coalesce(b.has_fraud_chargeback, false) AS has_fraud_chargeback, coalesce(b.chargeback_count, 0) AS chargeback_count, CAST(coalesce(b.chargeback_amount, 0) AS {_T}) AS chargeback_amount, CAST(coalesce(b.fraud_chargeback_amount, 0) AS {_T}) AS fraud_chargeback_amount, b.first_chargeback_at, {_days('t.transaction_at', 'b.first_chargeback_at')} AS days_to_first_chargeback,
            l.transaction_id IS NOT NULL AS is_fraud_labeled, l.first_fraud_label_at, l.first_fraud_label_source, l.fraud_label_sources, {_days('t.transaction_at', 'l.first_fraud_label_at')} AS days_to_fraud_label,
            CAST(coalesce(f.all_refunds, 0) AS {_T}) AS refund_amount, CAST(coalesce(f.fraud_refunds, 0) AS {_T}) AS fraud_refund_amount, t.is_approved AND r.transaction_id IS NULL AS is_approved_without_risk_evaluation, t.is_approved AND coalesce(r.risk_action, '') = 'reject' AS is_approved_despite_risk_reject, coalesce(d.is_duplicate_candidate, false) AS is_duplicate_candidate, d.first_transaction_id_in_group AS duplicate_of_transaction_id
            FROM stg_transactions t LEFT JOIN risk_decision r USING (transaction_id) LEFT JOIN chargebacks_per_tx b USING (transaction_id) LEFT JOIN duplicate_suspects d USING (transaction_id) LEFT JOIN stg_enrichment n USING (transaction_id) LEFT JOIN responses s ON s.issuer_response_code = n.issuer_response_code LEFT JOIN fraud_labels_per_tx l USING (transaction_id) LEFT JOIN refunded f USING (transaction_id)""",
        "fct_chargebacks": f"""SELECT b.chargeback_id, b.transaction_id, n.merchant_id, n.card_network, b.chargeback_at, b.chargeback_at::date AS chargeback_date, t.transaction_date AS cohort_date, t.payment_method, t.status AS transaction_status, t.amount AS transaction_amount, b.reason_code_raw, b.network_reason_code, b.reason_category, b.is_fraud_reason, b.cb_amount,
            {_days('t.transaction_at', 'b.chargeback_at')} AS days_to_chargeback, coalesce({_days('t.transaction_at', 'b.chargeback_at')}, 0) > {c.maturity_days} AS is_beyond_maturity_window, coalesce(n.three_ds_result, '') = 'authenticated' AS is_3ds_authenticated, coalesce(o.dispute_stage, 'first_chargeback') AS dispute_stage, coalesce(o.outcome, 'open') AS dispute_outcome, o.resolved_at,
            CAST(coalesce(o.recovered_amount, 0) AS {_D}) AS recovered_in_dispute_amount, CAST(coalesce(o.recovered_from_merchant_amount, 0) AS {_D}) AS recovered_from_merchant_amount, CAST(b.cb_amount - coalesce(o.recovered_amount, 0) AS {_D}) AS net_loss_amount,
            CAST(CASE WHEN b.cb_amount - coalesce(o.recovered_amount, 0) - coalesce(o.recovered_from_merchant_amount, 0) > 0 THEN b.cb_amount - coalesce(o.recovered_amount, 0) - coalesce(o.recovered_from_merchant_amount, 0) ELSE 0 END AS {_D}) AS platform_unrecovered_amount,
            t.transaction_id IS NULL AS is_orphan, coalesce(t.status, '') <> 'approved' AS is_on_non_approved_transaction, coalesce(b.cb_amount > t.amount, false) AS is_amount_above_transaction, b._ingested_at
            FROM stg_chargebacks b LEFT JOIN stg_transactions t ON t.transaction_id = b.transaction_id LEFT JOIN stg_enrichment n ON n.transaction_id = b.transaction_id LEFT JOIN stg_outcomes o ON o.chargeback_id = b.chargeback_id""",
        "time_spine": f"SELECT CAST(x AS date) AS date_day FROM generate_series(TIMESTAMP '{c.calendar[0]}', TIMESTAMP '{c.calendar[1]}', INTERVAL 1 DAY) s(x)",
        "dim_date": f"SELECT date_day, {_month('date_day')} AS month_start, CAST(year(date_day) AS integer) AS year_number, CAST(month(date_day) AS integer) AS month_number, CAST(isodow(date_day) AS integer) AS iso_day_of_week, isodow(date_day) > 5 AS is_weekend FROM time_spine",
        "dim_merchant": "SELECT merchant_id, segment, mcc, merchant_created_at FROM stg_merchants",
        "dim_risk_rule": "SELECT format('{}@v{}', rule_id, rule_version) AS rule_key, rule_id, rule_version, is_shadow FROM stg_rule_hits GROUP BY ALL",
        "approval_daily": f"""SELECT a.* EXCLUDE (day, method), day AS transaction_date, method AS payment_method, coalesce(order_count, 0) AS order_count, coalesce(approved_order_count, 0) AS approved_order_count FROM (
            SELECT cohort_date AS day, payment_method AS method, count(*) AS attempt_count, {_n('is_approved')} AS approved_count, {', '.join(f"{_n(f'{col} = {chr(39)}{v}{chr(39)}')} AS {name}" for name, col, v in (("declined_by_risk_count", "decline_source", "risk_engine"), ("declined_by_manual_review_count", "decline_source", "manual_review"), ("declined_by_issuer_count", "decline_source", "issuer_or_acquirer"), ("issuer_soft_decline_count", "issuer_decline_type", "soft"), ("issuer_hard_decline_count", "issuer_decline_type", "hard"), ("technical_error_count", "decline_source", "technical_error"), ("declined_unknown_count", "decline_source", "unknown_no_risk_evaluation"), ("manual_review_count", "decision_source", "manual_review")))},
            {_n('is_duplicate_candidate')} AS duplicate_candidate_count, {_n('is_approved_without_risk_evaluation')} AS approved_without_risk_evaluation_count, {_sum('amount')} AS attempted_amount, {_sum('amount', 'is_approved')} AS approved_amount FROM payment_attempts GROUP BY ALL) a
            LEFT JOIN (SELECT cohort_date AS day, payment_method AS method, count(DISTINCT order_id) AS order_count, count(DISTINCT CASE WHEN is_approved THEN order_id END) AS approved_order_count FROM payment_attempts WHERE order_id IS NOT NULL GROUP BY ALL) o USING (day, method)""",
        "cohort_daily": f"""SELECT cohort_date, payment_method, bool_or(is_chargeback_eligible) AS is_chargeback_eligible, count(*) AS attempt_count, {_n('is_approved')} AS approved_count, {_sum('amount', 'is_approved')} AS approved_amount, {_n('is_approved AND has_chargeback')} AS chargeback_transaction_count, {_n('is_approved AND has_fraud_chargeback')} AS fraud_chargeback_transaction_count, {_sum('chargeback_amount', 'is_approved')} AS chargeback_amount, {_sum('fraud_chargeback_amount', 'is_approved')} AS fraud_chargeback_amount,
            {_n('is_approved AND NOT is_duplicate_candidate')} AS approved_count_dedup, {_sum('amount', 'is_approved AND NOT is_duplicate_candidate')} AS approved_amount_dedup, {_n('is_approved AND is_fraud_labeled')} AS fraud_labeled_count, {_sum('amount', 'is_approved AND is_fraud_labeled')} AS fraud_labeled_amount, {_sum('fraud_refund_amount', 'is_approved')} AS fraud_refund_amount FROM payment_attempts GROUP BY ALL""",
        "rule_performance": f"""SELECT cohort_date AS transaction_date, coalesce(rule_triggered, 'no_rule') AS rule_triggered, coalesce(decision_source, 'no_evaluation') AS decision_source, CASE WHEN risk_score IS NULL THEN 'sem_score' WHEN risk_score >= 80 THEN '80-100' WHEN risk_score >= 60 THEN '60-79' WHEN risk_score >= 30 THEN '30-59' ELSE '00-29' END AS score_band,
            count(*) AS transaction_count, {_n("risk_action = 'approve'")} AS risk_approved_count, {_n("risk_action = 'reject'")} AS risk_rejected_count, {_n("risk_action = 'approve' AND has_fraud_chargeback")} AS false_negative_count, {_sum('amount', "risk_action = 'approve' AND has_fraud_chargeback")} AS false_negative_amount, {_sum('amount', "risk_action = 'reject'")} AS rejected_amount, avg(risk_score) AS avg_risk_score FROM payment_attempts GROUP BY ALL""",
        "hit_attempts": "SELECT h.rule_id, h.rule_version, h.is_shadow, h.rule_decision, a.transaction_id, a.cohort_date, a.amount, a.is_approved, a.is_fraud_labeled FROM stg_rule_hits h, stg_evaluations e, payment_attempts a WHERE h.evaluation_id = e.evaluation_id AND e.transaction_id = a.transaction_id",
        "rule_backtest": f"""SELECT rule_id, rule_version, CASE is_shadow WHEN true THEN 'shadow' ELSE 'enforced' END AS rule_mode, count(*) AS hit_count, {_n("rule_decision = 'reject'")} AS would_reject_count, {_n('is_fraud_labeled')} AS hits_on_fraud, {_div(_n('is_fraud_labeled'), 'count(*)')} AS precision_on_labeled, {_div(_n('is_fraud_labeled'), '(SELECT count(*) FROM payment_attempts WHERE is_fraud_labeled)')} AS fraud_coverage,
            {_n("rule_decision = 'reject' AND is_approved AND NOT is_fraud_labeled")} AS good_approved_would_block_count, {_sum('amount', "rule_decision = 'reject' AND is_fraud_labeled")} AS fraud_amount_would_block, {_div(_n('hits > 1'), 'count(*)')} AS overlap_share FROM hit_attempts JOIN (SELECT transaction_id, count(*) AS hits FROM hit_attempts GROUP BY 1) USING (transaction_id) GROUP BY ALL""",
        "settled_monthly": f"SELECT merchant_id, card_network, {_month('settled_at')} AS month_start, count(*) AS settled_count, sum(amount) AS settled_amount FROM payment_attempts WHERE is_settled AND is_chargeback_eligible AND merchant_id IS NOT NULL GROUP BY ALL",
        "reported_monthly": f"SELECT a.merchant_id, r.card_network, {_month('r.reported_at')} AS month_start, count(*) AS fraud_report_count FROM stg_issuer_reports r JOIN payment_attempts a USING (transaction_id) WHERE a.is_chargeback_eligible AND a.merchant_id IS NOT NULL GROUP BY ALL",
        "disputed_monthly": f"SELECT merchant_id, card_network, {_month('chargeback_at')} AS month_start, count(*) AS dispute_count, {_n('is_fraud_reason')} AS fraud_dispute_count, {_sum('cb_amount', 'is_fraud_reason')} AS fraud_dispute_amount FROM fct_chargebacks WHERE merchant_id IS NOT NULL GROUP BY ALL",
        "network_base": f"""SELECT {spine}, coalesce(s.settled_count, 0) AS settled_count, CAST(coalesce(s.settled_amount, 0) AS {_T}) AS settled_amount, coalesce(r.fraud_report_count, 0) AS fraud_report_count, coalesce(d.dispute_count, 0) AS dispute_count, coalesce(d.fraud_dispute_count, 0) AS fraud_dispute_count, CAST(coalesce(d.fraud_dispute_amount, 0) AS {_T}) AS fraud_dispute_amount,
            coalesce((SELECT max(p.settled_count) FROM settled_monthly p WHERE p.merchant_id = k.merchant_id AND p.card_network = k.card_network AND p.month_start + INTERVAL 1 MONTH = k.month_start), 0) AS previous_month_settled_count, CASE WHEN month_start = {_month(today)} THEN CAST(day(last_day(month_start)) AS double) / greatest(date_diff('day', month_start, {today}) + 1, 1) ELSE 1.0 END AS projection_factor
            FROM (SELECT {spine} FROM settled_monthly UNION SELECT {spine} FROM reported_monthly UNION SELECT {spine} FROM disputed_monthly) k LEFT JOIN settled_monthly s {on} LEFT JOIN reported_monthly r {on} LEFT JOIN disputed_monthly d {on}""",
        "network_monitoring": f"""SELECT *, CASE WHEN card_network = 'visa' THEN CASE WHEN (fraud_report_count + dispute_count) * projection_factor < {c.vamp_min_cases} THEN 'abaixo_do_piso_de_volume' WHEN visa_vamp_ratio >= {c.vamp_ratio} THEN {over} WHEN visa_vamp_ratio >= {c.vamp_ratio * c.early_warning_share} THEN {early} ELSE 'ok' END END AS visa_vamp_status,
            CASE WHEN card_network = 'mastercard' THEN CASE WHEN previous_month_settled_count = 0 THEN 'sem_base_mes_anterior' WHEN mc_ecm_ratio >= {c.ecm_ratio} AND dispute_count * projection_factor >= {c.ecm_min_chargebacks} THEN {over} WHEN mc_ecm_ratio >= {c.ecm_ratio * c.early_warning_share} THEN {early} ELSE 'ok' END END AS mc_ecm_status, CASE WHEN card_network = 'mastercard' THEN CASE WHEN mc_efm_fraud_bps >= {c.efm_bps} THEN {over} ELSE 'ok' END END AS mc_efm_status FROM (
            SELECT *, CASE card_network WHEN 'visa' THEN {_div('fraud_report_count + dispute_count', 'settled_count')} END AS visa_vamp_ratio, CASE card_network WHEN 'mastercard' THEN {_div('dispute_count', 'previous_month_settled_count')} END AS mc_ecm_ratio, CASE card_network WHEN 'mastercard' THEN 10000 * {_div('fraud_dispute_amount', 'settled_amount')} END AS mc_efm_fraud_bps, round(dispute_count * projection_factor) AS projected_dispute_count, round(settled_count * projection_factor) AS projected_settled_count FROM network_base)""",
        "merchant_loss": f"""WITH cb AS (SELECT merchant_id, {_month('chargeback_at')} AS month_start, count(*) AS n, sum(cb_amount) AS gross, {_sum('cb_amount', 'is_fraud_reason')} AS fraud, sum(net_loss_amount) AS net, sum(recovered_from_merchant_amount) AS back, sum(platform_unrecovered_amount) AS lost FROM fct_chargebacks WHERE merchant_id IS NOT NULL GROUP BY ALL),
            med AS (SELECT e.merchant_id, {_month('m.claimed_at')} AS month_start, sum(m.claim_amount) AS claimed, sum(m.returned_amount) AS returned FROM stg_med_claims m JOIN stg_enrichment e USING (transaction_id) GROUP BY ALL)
            SELECT merchant_id, segment, mcc, {_days('merchant_created_at', 'month_start')} AS merchant_age_days, month_start, coalesce(n, 0) AS chargeback_count, {', '.join(f'CAST(coalesce({a}, 0) AS {_T}) AS {b}' for a, b in (('gross', 'gross_chargeback_amount'), ('fraud', 'gross_fraud_chargeback_amount'), ('net', 'net_chargeback_loss_amount'), ('back', 'recovered_from_merchant_amount'), ('lost', 'platform_unrecovered_amount'), ('claimed', 'pix_med_claim_amount')))}, CAST(coalesce(claimed, 0) - coalesce(returned, 0) AS {_T}) AS pix_med_net_loss_amount
            FROM (cb FULL JOIN med USING (merchant_id, month_start)) LEFT JOIN stg_merchants USING (merchant_id)""",
        "cohort_maturity": f"SELECT *, {_days('cohort_date', today)} AS cohort_age_days, {_days('cohort_date', today)} >= {c.maturity_days} AS is_mature, {_div('chargeback_amount', 'approved_amount')} AS chargeback_rate_amount, {_div('chargeback_transaction_count', 'approved_count')} AS chargeback_rate_qty, 10000 * {_div('fraud_labeled_amount', 'approved_amount')} AS fraud_bps FROM cohort_daily",
        "open_exposure": f"""WITH s AS (SELECT merchant_id, amount, chargeback_amount AS cb, date_diff('day', cohort_date, {today}) AS age, coalesce(payout_term_days, {c.default_payout_days}) AS term FROM payment_attempts WHERE is_approved AND is_chargeback_eligible AND merchant_id IS NOT NULL),
            own AS (SELECT merchant_id, {_div('sum(cb)', 'sum(amount)')} AS rate FROM s WHERE age >= {c.dispute_window_days} GROUP BY 1), every AS (SELECT {_div('sum(cb)', 'sum(amount)')} AS rate FROM s WHERE age >= {c.dispute_window_days}),
            live AS (SELECT merchant_id, {_sum('amount', f'age < {c.dispute_window_days}')} AS open_window_amount, {_sum('amount', f'age < {c.dispute_window_days} AND age >= term')} AS released_open_window_amount, {_sum('cb', f'age < {c.dispute_window_days}')} AS open_window_chargeback_amount FROM s GROUP BY 1)
            SELECT live.*, coalesce(own.rate, every.rate) AS expected_cb_rate, CAST(released_open_window_amount AS double) * coalesce(own.rate, every.rate, 0) AS expected_chargeback_on_released FROM live LEFT JOIN own USING (merchant_id) CROSS JOIN every""",
        "metric_sensitivity": f"""SELECT n AS scenario_order, name AS scenario, count(*) AS attempt_count, {_n('is_approved')} AS approved_count, round(100 * {_div(_n('is_approved'), 'count(*)')}, 2) AS approval_rate_pct, {_n('is_approved AND has_chargeback')} AS chargeback_transaction_count, round(100 * {_div(_n('is_approved AND has_chargeback'), _n('is_approved'))}, 2) AS chargeback_rate_qty_pct, {_sum('amount', 'is_approved', False)} AS approved_amount, {_sum('chargeback_amount', 'is_approved', False)} AS chargeback_amount, round(100 * {_div(_sum('chargeback_amount', 'is_approved'), _sum('amount', 'is_approved'))}, 2) AS chargeback_rate_amount_pct
            FROM (VALUES (1, 'Contrato literal (todos os métodos, com duplicidade)', true, true), (2, 'Sem candidatos a duplicidade', true, false), (3, 'Só métodos elegíveis a chargeback (cartão)', false, true), (4, 'Cartão e sem duplicidade', false, false)) s(n, name, any_method, twice) JOIN payment_attempts a ON (any_method OR a.is_chargeback_eligible) AND (twice OR NOT a.is_duplicate_candidate) GROUP BY ALL""",
        "daily_risk_health": f"""WITH d AS (SELECT cohort_date AS metric_date, count(*) AS attempt_count, {_n('is_approved')} AS ok, {_div(_n('is_approved'), 'count(*)')} AS approval_rate, {_div(_n("decline_source = 'risk_engine'"), 'count(*)')} AS risk_reject_rate, {_div(_n('is_approved_without_risk_evaluation'), _n('is_approved'))} AS approved_without_evaluation_rate, {_n('is_duplicate_candidate')} AS duplicate_candidate_count, {_n("decline_source = 'technical_error'")} AS technical_error_count, avg(risk_score) AS avg_risk_score FROM payment_attempts GROUP BY 1),
            z AS (SELECT *, {_z('attempt_count')} AS zscore_attempts, {_z('approval_rate')} AS zscore_approval_rate, {_z('risk_reject_rate')} AS zscore_risk_reject_rate FROM d WINDOW w AS (ORDER BY metric_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
            SELECT * EXCLUDE (ok), CASE WHEN approved_without_evaluation_rate > {c.fail_open_rate} THEN 'P1_fail_open_motor' WHEN abs(zscore_risk_reject_rate) > 3 THEN 'P2_regra_disparando_fora_do_padrao' WHEN abs(zscore_attempts) > 3 THEN 'P2_volume_anomalo' WHEN duplicate_candidate_count > 0 THEN 'P3_duplicidade' ELSE 'ok' END AS alert_status FROM z""",
        "score_psi": f"""WITH d AS (SELECT cohort_date AS metric_date, CAST(least(risk_score // 10, 9) AS integer) AS b, count(*) AS n FROM payment_attempts WHERE risk_score IS NOT NULL GROUP BY ALL), days AS (SELECT DISTINCT metric_date FROM d),
            expected AS (SELECT days.metric_date, d.b, sum(d.n) AS n FROM days JOIN d ON d.metric_date < days.metric_date AND d.metric_date >= days.metric_date - 28 GROUP BY ALL), shares AS (SELECT metric_date, b, {_div('n', 'sum(n) OVER (PARTITION BY metric_date)')} AS e FROM expected), actual AS (SELECT metric_date, b, {_div('n', 'sum(n) OVER (PARTITION BY metric_date)')} AS a FROM d),
            cells AS (SELECT metric_date, greatest(coalesce(a, 0), {c.psi_floor}) AS a, greatest(coalesce(e, 0), {c.psi_floor}) AS e, e IS NOT NULL AS based FROM days CROSS JOIN range(10) r(b) LEFT JOIN actual USING (metric_date, b) LEFT JOIN shares USING (metric_date, b)),
            s AS (SELECT metric_date, sum((a - e) * ln(a / e)) AS psi, bool_or(based) AS based FROM cells GROUP BY 1)
            SELECT metric_date, CASE WHEN based THEN psi END AS psi, CASE WHEN NOT based THEN 'sem_base_historica' WHEN psi > 0.25 THEN 'P1_drift_severo' WHEN psi > 0.10 THEN 'P2_drift_moderado' ELSE 'ok' END AS alert_status FROM s""",
        "rule_trigger_health": f"""WITH v AS (SELECT cohort_date AS metric_date, count(*) AS n FROM payment_attempts WHERE evaluation_id IS NOT NULL GROUP BY 1), d AS (SELECT h.cohort_date AS metric_date, rule_id, {_div('count(*)', 'any_value(v.n)')} AS hit_rate FROM hit_attempts h JOIN v ON v.metric_date = h.cohort_date WHERE NOT is_shadow GROUP BY ALL),
            z AS (SELECT *, avg(hit_rate) OVER w AS baseline_hit_rate, {_z('hit_rate')} AS zscore_hit_rate FROM d WINDOW w AS (PARTITION BY rule_id ORDER BY metric_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
            SELECT *, CASE WHEN abs(zscore_hit_rate) > 3 THEN 'P2_regra_fora_do_padrao' WHEN baseline_hit_rate IS NULL THEN 'sem_base_historica' ELSE 'ok' END AS alert_status FROM z""",
        "maturation_curve": f"""WITH b AS (SELECT coalesce((SELECT min(x) FROM (VALUES (15), (30), (45), (60), (90), (120)) m(x) WHERE days_to_chargeback <= x), 999) AS days_bucket, cb_amount FROM fct_chargebacks WHERE NOT is_orphan), s AS (SELECT days_bucket, count(*) AS cb_count, {_sum('cb_amount', zero=False)} AS cb_amount FROM b GROUP BY 1)
            SELECT days_bucket, cb_count, cb_amount, {_div('(SELECT sum(cb_amount) FROM s t WHERE t.days_bucket <= s.days_bucket)', '(SELECT sum(cb_amount) FROM s)')} AS cumulative_share_amount, days_bucket > {c.maturity_days} AS is_beyond_agreed_window FROM s""",
        "velocity": f"""SELECT a.transaction_id, a.user_id, a.transaction_at, {', '.join(f"{_n(f'b.t >= a.t - {s}')} - 1 AS user_attempts_{name}, CAST({_sum('b.amount', f'b.t >= a.t - {s}')} - a.amount AS {_T}) AS user_amount_{name}" for name, s in (('10m', 600), ('24h', 86400)))}
            FROM (SELECT *, date_diff('second', TIMESTAMP '1970-01-01', transaction_at) AS t FROM stg_transactions) a JOIN (SELECT user_id, amount, date_diff('second', TIMESTAMP '1970-01-01', transaction_at) AS t FROM stg_transactions) b ON a.user_id = b.user_id AND b.t <= a.t AND b.t >= a.t - 86400 GROUP BY a.transaction_id, a.user_id, a.transaction_at, a.amount""",
    }


def sql(profile: str, query: str, extra: dict[str, str] | None = None) -> str:
    """query (a model's name or a SELECT over models) with all that it reads as common table expressions."""
    models = _models(profile) | (extra or {})
    out: dict[str, str] = {}

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\w+", text)):
            if name in models and name not in out:
                need(models[name])
                out[name] = models[name]

    query = f"SELECT * FROM {query}" if query in models else query
    need(query)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in out.items()) + "\n" + query
