"""The test tables as raw feeds of the domain.

Each feed is one query that two engines run, with the few functions that they name differently filled in; so both start from the same
rows. Profile `orders` has a long history with chargebacks, made from orders and lineitem; `events` has thirty days, made from events.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from riskmart.config import Config

CONFIGS = {
    "orders": Config(as_of=date(2001, 12, 31), calendar=(date(1995, 1, 1), date(2002, 12, 31))),
    "events": Config(as_of=date(2024, 12, 31)),
}
_DIALECTS = {
    "spark": {"seconds": "make_dt_interval(0, 0, 0, {0})", "days": "make_dt_interval({0}, 0, 0, 0)", "div": "({0} div {1})", "json": "get_json_object({0}, '$.{1}')"},
    "duckdb": {"seconds": "to_seconds({0})", "days": "to_days({0})", "div": "({0} // {1})", "json": "json_extract_string({0}, '$.{1}')"},
}


def _orders(f) -> dict[str, str]:
    sec, day, div = f["seconds"], f["days"], f["div"]
    base = f"""SELECT o_orderkey AS k, 'u_' || cast(o_custkey AS string) AS u, o_orderdate + {sec("cast((o_orderkey * 7919) % 86400 AS int)")} AS t, cast(o_totalprice AS decimal(18,2)) AS amount,
        CASE WHEN o_orderkey % 20 = 0 THEN 'error' WHEN o_orderstatus = 'P' THEN 'declined' ELSE 'approved' END AS status,
        CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'credit_card' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'debit_card' WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'pix' ELSE 'boleto' END AS method
        FROM orders"""
    tx = "'tx_' || cast(k AS string)"
    paid = f"(SELECT * FROM ({base}) p WHERE status = 'approved')"

    def row(key: str, at: str, arrived: str) -> str:
        return f"SELECT {key} AS transaction_id, u AS user_id, cast({at} AS string) AS transaction_at, cast(amount AS string) AS amount, status, method AS payment_method, {arrived} AS _ingested_at FROM ({base}) b"

    def evaluation(suffix: str, at: str) -> str:
        return f"""SELECT 'ev_' || cast(k AS string) || '{suffix}' AS evaluation_id, {tx} AS transaction_id, cast({at} AS string) AS evaluated_at,
        CASE WHEN s < 10 THEN '0' ELSE '' END || cast(s AS string) AS risk_score, CASE WHEN s >= 80 THEN 'reject' WHEN s >= 70 THEN 'review' ELSE 'approve' END AS risk_action,
        CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'rule_high_velocity' WHEN 2 THEN 'rule_manual_review_x' ELSE 'rule_partner_review_y' END AS rule_triggered, {at} + {sec("3")} AS _ingested_at
        FROM (SELECT *, (k * 37) % 101 AS s FROM ({base}) b WHERE k % 53 <> 0) e"""

    def evidence(m: int, kind: str, extra: str) -> str:
        return f"SELECT '{kind}_' || cast(k AS string) AS id, {tx} AS transaction_id, t, amount, k, {extra} AS x FROM {paid} p WHERE k % {m} = 0"

    disputed = f"""SELECT l.l_orderkey AS k, l.l_linenumber AS n, min(l.l_partkey) AS part, min(l.l_suppkey) AS supp, cast(min(l.l_extendedprice) AS decimal(18,2)) AS amount, min(b.t) AS t
        FROM lineitem l JOIN ({base}) b ON b.k = l.l_orderkey WHERE l.l_returnflag = 'R' AND l.l_partkey % 10 = 0 GROUP BY l.l_orderkey, l.l_linenumber"""
    cb = "'cb_' || cast(k AS string) || '_' || cast(n AS string)"
    at = f"t + {day('cast(part % 150 AS int)')}"
    return {
        "raw_transactions": f"{row(tx, 't', 't + ' + sec('5'))} UNION ALL {row(tx + ' || ' + chr(39) + '_r' + chr(39), 't + ' + sec('30'), 't + ' + sec('35'))} WHERE k % 97 = 0 UNION ALL {row(tx, 't', 't + ' + sec('3605'))} WHERE k % 89 = 0",
        "raw_risk_evaluations": f"{evaluation('', 't - ' + sec('2'))} UNION ALL {evaluation('_2', 't + ' + sec('600'))} WHERE k % 5 = 0",
        "raw_chargebacks": f"""SELECT {cb} AS chargeback_id, CASE WHEN supp % 41 = 0 THEN 'tx_none_' ELSE 'tx_' END || cast(k AS string) AS transaction_id, cast({at} AS string) AS chargeback_at,
            CASE supp % 5 WHEN 0 THEN '10.4_fraud' WHEN 1 THEN '13.1' WHEN 2 THEN '4837' WHEN 3 THEN '12.6' ELSE '99.9_new' END AS reason_code, cast(amount AS string) AS cb_amount, {at} + {sec("300")} AS _ingested_at FROM ({disputed}) d""",
        "raw_payment_enrichment": f"""SELECT {tx} AS transaction_id, CASE WHEN k % 50 = 0 THEN 'm_none' ELSE 'm_' || cast(k % (SELECT count(*) FROM supplier) AS string) END AS merchant_id, 'o_' || cast({div("k", "3")} AS string) AS order_id, CASE k % 3 WHEN 0 THEN 'br' WHEN 1 THEN 'ar' ELSE 'mx' END AS country,
            CASE k % 2 WHEN 0 THEN 'Visa' ELSE 'mastercard' END AS card_network, 'fp_' || cast(k % 50 AS string) AS card_fingerprint, '4' || cast(10000 + k % 100 AS string) AS bin, CASE k % 4 WHEN 0 THEN 'authenticated' WHEN 1 THEN 'not_authenticated' WHEN 2 THEN 'not_attempted' ELSE '' END AS three_ds_result,
            CASE k % 6 WHEN 0 THEN '00' WHEN 1 THEN '51' WHEN 2 THEN '14' WHEN 3 THEN '05' WHEN 4 THEN '' ELSE '98' END AS issuer_response_code, CASE WHEN status = 'approved' THEN 'captured' ELSE 'not_captured' END AS capture_status,
            cast(t + {day("1")} AS string) AS settled_at, CASE k % 3 WHEN 0 THEN '2' WHEN 1 THEN '14' ELSE '30' END AS payout_term_days, 'brl' AS currency, t + {sec("6")} AS _ingested_at FROM ({base}) b WHERE k % 43 <> 0""",
        "raw_merchants": f"SELECT 'm_' || cast(s_suppkey AS string) AS merchant_id, cast(5000 + s_suppkey % 100 AS string) AS mcc, CASE s_suppkey % 3 WHEN 0 THEN 'Retail' WHEN 1 THEN 'travel' ELSE 'digital' END AS segment, cast(cast('1994-01-01 00:00:00' AS timestamp) + {day('cast(s_suppkey % 700 AS int)')} AS string) AS created_at, cast('1994-01-01 00:00:00' AS timestamp) AS _ingested_at FROM supplier",
        "raw_issuer_fraud_reports": f"SELECT id AS report_id, transaction_id, x AS card_network, cast(t + {day('5')} AS string) AS reported_at, 'card_not_present' AS fraud_type, t + {day('6')} AS _ingested_at FROM ({evidence(61, 'rep', 'CASE k % 2 WHEN 0 THEN ' + chr(39) + 'visa' + chr(39) + ' ELSE ' + chr(39) + 'mastercard' + chr(39) + ' END')}) z",
        "raw_refunds": f"SELECT id AS refund_id, transaction_id, cast(t + {day('9')} AS string) AS refunded_at, cast(amount AS string) AS refund_amount, x AS refund_reason, t + {day('9')} AS _ingested_at FROM ({evidence(67, 'ref', 'CASE k % 5 WHEN 0 THEN ' + chr(39) + 'fraud_alert' + chr(39) + ' WHEN 2 THEN NULL WHEN 3 THEN ' + chr(39) + 'goodwill' + chr(39) + ' WHEN 1 THEN ' + chr(39) + 'customer_request' + chr(39) + ' ELSE ' + chr(39) + 'fraud_confirmed' + chr(39) + ' END')}) z",
        "raw_dispute_alerts": f"SELECT id AS alert_id, transaction_id, 'ethoca' AS alert_provider, cast(t + {day('3')} AS string) AS alerted_at, x AS alert_type, 'refunded' AS action_taken, t + {day('3')} AS _ingested_at FROM ({evidence(71, 'al', 'CASE k % 2 WHEN 0 THEN ' + chr(39) + 'confirmed_fraud' + chr(39) + ' ELSE ' + chr(39) + 'customer_dispute' + chr(39) + ' END')}) z",
        "raw_pix_med_claims": f"SELECT 'med_' || cast(k AS string) AS claim_id, {tx} AS transaction_id, cast(t + {day('2')} AS string) AS claimed_at, cast(amount AS string) AS claim_amount, 'accepted' AS claim_status, CASE k % 2 WHEN 0 THEN '10.00' ELSE '' END AS returned_amount, t + {day('2')} AS _ingested_at FROM {paid} p WHERE method = 'pix' AND k % 73 = 0",
        "raw_chargeback_outcomes": f"SELECT {cb} AS chargeback_id, 'second_presentment' AS dispute_stage, CASE k % 2 WHEN 0 THEN 'won' ELSE 'lost' END AS outcome, cast({at} + {day('20')} AS string) AS resolved_at, CASE k % 2 WHEN 0 THEN cast(amount AS string) ELSE '' END AS recovered_amount, CASE WHEN k % 2 = 1 AND n % 2 = 0 THEN '25.50' ELSE '0' END AS recovered_from_merchant_amount, {at} + {day('20')} AS _ingested_at FROM ({disputed}) d WHERE k % 3 = 0",
        "raw_risk_rule_hits": f"SELECT 'ev_' || cast(k AS string) AS evaluation_id, r.rule_id, cast(k % 2 + 1 AS string) AS rule_version, CASE WHEN k % 7 = 0 THEN 'true' ELSE 'false' END AS is_shadow, CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'review' END AS rule_decision, t AS _ingested_at FROM ({base}) b CROSS JOIN (SELECT 'r1' AS rule_id, 2 AS m UNION ALL SELECT 'r2', 3 UNION ALL SELECT 'r3', 5) r WHERE k % 53 <> 0 AND k % r.m = 0",
    }


def _events(f) -> dict[str, str]:
    sec = f["seconds"]
    base = f"SELECT event_id AS k, cast(user_id AS string) AS u, ts AS t, cast(value AS decimal(18,2)) AS amount, event_type AS kind, cast({f['json']('props', 'k')} AS int) AS s FROM events"
    tx = "'ev_' || cast(k AS string)"
    return {
        "raw_transactions": f"SELECT {tx} AS transaction_id, u AS user_id, cast(t AS string) AS transaction_at, cast(amount AS string) AS amount, CASE kind WHEN 'error' THEN 'error' WHEN 'signup' THEN 'declined' ELSE 'approved' END AS status, CASE k % 3 WHEN 0 THEN 'pix' ELSE 'credit_card' END AS payment_method, t + {sec('5')} AS _ingested_at FROM ({base}) b",
        "raw_risk_evaluations": f"SELECT 'e_' || cast(k AS string) AS evaluation_id, {tx} AS transaction_id, cast(t - {sec('1')} AS string) AS evaluated_at, cast(s AS string) AS risk_score, CASE WHEN s >= 80 THEN 'reject' WHEN s >= 70 THEN 'review' ELSE 'approve' END AS risk_action, '' AS rule_triggered, t AS _ingested_at FROM ({base}) b WHERE k % 53 <> 0",
        "raw_risk_rule_hits": f"SELECT 'e_' || cast(k AS string) AS evaluation_id, 'r' || cast(k % 4 AS string) AS rule_id, '1' AS rule_version, CASE WHEN k % 11 = 0 THEN 'true' ELSE 'false' END AS is_shadow, 'review' AS rule_decision, t AS _ingested_at FROM ({base}) b WHERE k % 53 <> 0 AND s % 3 = 0",
    }


def feed_sql(profile: str, dialect: str) -> dict[str, str]:
    """The query of each feed, over views named as the test tables."""
    functions = {k: v.format for k, v in _DIALECTS[dialect].items()}
    return {"orders": _orders, "events": _events}[profile](functions)


def feeds(spark: SparkSession, sf_dir: str, profile: str) -> dict[str, DataFrame]:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in {"orders": ["orders", "lineitem", "supplier"], "events": ["events"]}[profile]}
    out = {}
    for name, sql in feed_sql(profile, "spark").items():
        for t in tables:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        used = {t: df for t, df in tables.items() if "{" + t + "}" in sql}
        df = spark.sql(sql, **used)
        out[name] = df.withColumn("_ingested_at", df["_ingested_at"].cast("timestamp_ntz"))
    return out
