"""Data tests: each gives the rows that violate it; a suite counts them and judges by severity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart import schemas
from riskmart.config import Config
from riskmart.contracts import CONTRACTS, Contract
from riskmart.functions.columns import TOTAL, ratio


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once; null keys don't count."""
    known = df
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def unique_combination(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def relationship(df: DataFrame, column: str, to: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(to.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def expression_is_true(df: DataFrame, expression: str) -> DataFrame:
    """Null passes."""
    return df.where(f"not ({expression})")


def card_data_columns(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """Columns whose names tell of card data that must not be kept: a check of schemas, not rows."""
    # Fixed values.
    forbidden = {"pan", "card_number", "cardnumber", "cvv", "cvc", "card_cvv", "expiry", "expiration_date", "card_expiry"}
    return [(t, c) for t, df in tables.items() for c in df.columns if c.lower() in forbidden]


def contract_violations(df: DataFrame, contract: dict[str, str] | None = None) -> list[str]:
    """Columns of the contract that df lacks or has with another type."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c)} instead of {t}" for c, t in (contract or schemas.ATTEMPTS).items() if have.get(c) != t]


def chargeback_amount_reconciliation(raw: DataFrame, chargebacks: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row if raw amounts, those of the chargeback fact, and those on attempts plus those of orphans aren't the same."""

    def sum_of(df: DataFrame, c, name: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL).alias(name))  # one row

    orphans = sum_of(chargebacks.where("is_orphan"), "cb_amount", "orphan_amount")
    sums = sum_of(raw, F.col("cb_amount").try_cast("decimal(18,2)"), "raw_amount").crossJoin(sum_of(chargebacks, "cb_amount", "event_amount")).crossJoin(sum_of(attempts, "chargeback_amount", "attempt_amount")).crossJoin(orphans)
    return sums.where("raw_amount <> event_amount or event_amount <> attempt_amount + orphan_amount")


def chargebacks_above_amount(chargebacks: DataFrame) -> DataFrame:
    """Sales whose chargebacks together exceed them."""
    return chargebacks.where("not is_orphan").groupBy("transaction_id").agg(F.sum("cb_amount").cast(TOTAL).alias("total_cb_amount"), F.max("transaction_amount").alias("transaction_amount")).where("total_cb_amount > transaction_amount")


def cohort_reconciliation(cohorts: DataFrame, attempts: DataFrame) -> DataFrame:
    """Cohorts whose attempts or chargeback amount differ from the fact's, or that only one of both has."""
    fact = attempts.groupBy("cohort_date", "payment_method").agg(F.count("*").alias("fact_attempts"), F.coalesce(F.sum(F.when(F.col("is_approved"), F.col("chargeback_amount"))), F.lit(0)).cast(TOTAL).alias("fact_amount"))
    a, f = cohorts.alias("a"), fact.alias("f")
    joined = a.join(f, F.col("a.cohort_date").eqNullSafe(F.col("f.cohort_date")) & F.col("a.payment_method").eqNullSafe(F.col("f.payment_method")), "full")
    bad = ~F.col("attempt_count").eqNullSafe(F.col("fact_attempts")) | ~F.col("a.chargeback_amount").eqNullSafe(F.col("fact_amount"))
    return joined.where(bad).select(F.coalesce("a.cohort_date", "f.cohort_date").alias("cohort_date"), F.coalesce("a.payment_method", "f.payment_method").alias("payment_method"), "attempt_count", "fact_attempts", F.col("a.chargeback_amount").alias("cohort_amount"), "fact_amount")


def freshness(df: DataFrame, now, warn: timedelta, error: timedelta, at: str = "_ingested_at") -> DataFrame:
    """One row: the newest stamp, its age in seconds and pass, warn or error; error for an empty source."""
    from riskmart.functions.columns import seconds

    newest = df.agg(F.max(at).alias("newest"))
    age = seconds(F.lit(now).cast("timestamp_ntz")) - seconds("newest")
    status = F.when(age.isNull() | (age > int(error.total_seconds())), "error").when(age > int(warn.total_seconds()), "warn").otherwise("pass")
    return newest.select("newest", age.alias("age_seconds"), status.alias("status"))


def share_rules(df: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """rule, n_rows, n_bad, value, status of each rule (what is bad, among which rows, and the share that is too much), in one pass over df.

    A rule passes below its limit, and without any bad row also at a limit of zero; no rows pass, with a null share.
    """
    counts = [F.struct(F.lit(name).alias("rule"), F.count_if(F.expr(of)).alias("n_rows"), F.count_if(F.expr(f"({of}) and ({bad})")).alias("n_bad"), F.lit(limit).alias("limit")) for name, (bad, of, limit) in rules.items()]
    found = df.agg(F.array(*counts).alias("r")).select(F.inline("r")).withColumn("value", ratio("n_bad", "n_rows"))
    status = F.when((F.col("n_bad") > 0) & (F.col("value") >= F.col("limit")), "error").otherwise("pass")
    return found.select("rule", "n_rows", "n_bad", "value", status.alias("status"))


def business_days(start, end) -> Column:
    """Days from Monday to Friday after start, up to and with end; holidays aren't known. Null for a null."""
    start, end = start.cast("date"), end.cast("date")

    def before(d):  # days from Monday to Friday from Monday, 1970-01-05, to d
        n = F.datediff(d, F.lit(date(1970, 1, 5))) + 1
        weeks = F.floor(n / 7)
        return weeks * 5 + F.least(n - weeks * 7, F.lit(5))

    return (before(end) - before(start)).cast("long")


def business_day_rule(df: DataFrame, now, limit: int, at: str = "_ingested_at") -> DataFrame:
    """One row: the newest stamp, the business days since, and pass if they are at most the limit; an empty source is an error."""
    newest = df.agg(F.max(at).alias("newest")).withColumn("value", business_days(F.col("newest"), F.lit(now).cast("timestamp_ntz")))
    return newest.select("newest", "value", F.when(F.col("value") <= limit, "pass").otherwise("error").alias("status"))


def volume_anomalies(df: DataFrame, at: str, config: Config) -> DataFrame:
    """Day: rows, mean and deviation of the calendar days before (days without rows count as zero from the first one on), and an anomaly outside `z_limit` deviations.

    Days without rows are rows of their own, so a feed that stops is an anomaly too. Until there is a whole baseline there is no verdict. The window is over one row a day.
    """
    daily = df.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("date").alias("metric_date")).agg(F.count("*").alias("n"))
    days = daily.agg(F.min("metric_date").alias("a"), F.max("metric_date").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("metric_date"))
    every = days.join(daily, "metric_date", "left").select("metric_date", F.coalesce("n", F.lit(0)).cast("long").alias("row_count"))
    w = Window.orderBy("metric_date").rowsBetween(-config.baseline_days, -1)
    based = every.withColumns({"baseline_days": F.count("*").over(w), "baseline_mean": F.avg("row_count").over(w), "baseline_deviation": F.stddev_samp("row_count").over(w)})
    far = F.abs(F.col("row_count") - F.col("baseline_mean")) > config.z_limit * F.col("baseline_deviation")
    status = F.when(F.col("baseline_days") < config.baseline_days, "no_baseline").when(far, "anomaly").otherwise("ok")
    return based.withColumn("status", status)


def contract_rules(models: Callable[[str], DataFrame], config: Config, contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    """The contracts' rules on shares and drift: rule, n_rows, n_bad, value, status; limits are the contracts', not the config's. One pass a table, whatever the number of contracts that have rules about it."""
    shares: dict[str, dict[str, tuple[str, str, float]]] = {}
    for c in contracts.values():
        for model, rules in c.shares().items():
            shares.setdefault(model, {}).update(rules)
    parts = [share_rules(models(model), rules) for model, rules in shares.items()]
    for r in (r for c in contracts.values() for r in c.of_kind("distribution")):
        value = F.col(r["column"])
        found = models(r["model"]).agg(F.lit(r["name"]).alias("rule"), F.count(value).alias("n_rows"), F.count_if(value >= r["mustBeLessThan"]).alias("n_bad"), F.max(value).alias("value"))
        parts.append(found.withColumn("status", F.when(F.col("n_bad") > 0, "error").otherwise("pass")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Test:
    name: str
    rows: Callable[[], DataFrame]
    severity: str = "error"
    error_over: int = 0  # a warning up to so many rows, where severity is warn and this is set

    def status(self, n: int) -> str:
        if not n:
            return "pass"
        if self.severity == "warn" and not (self.error_over and n > self.error_over):
            return "warn"
        return "error"


def suite(models: Callable[[str], DataFrame]) -> list[Test]:
    """The tests of the marts; models gives a model by name."""
    fact, cb = (lambda: models("payment_attempts")), (lambda: models("fct_chargebacks"))
    tests = [
        Test("approved_without_evaluation", lambda: fact().where("is_approved_without_risk_evaluation"), "warn", 10),
        Test("approved_despite_reject", lambda: fact().where("is_approved_despite_risk_reject")),
        Test("duplicate_candidates", lambda: fact().where("is_duplicate_candidate"), "warn"),
        Test("orphan_chargebacks", lambda: cb().where("is_orphan"), "warn"),
        Test("chargeback_on_non_approved", lambda: cb().where("is_on_non_approved_transaction and not is_orphan"), "warn"),
        Test("chargeback_above_amount", lambda: chargebacks_above_amount(cb()), "warn"),
        Test("evaluated_after_authorization", lambda: models("risk_decision").where("not is_pre_authorization"), "warn"),
        Test("chargeback_amount_reconciles", lambda: chargeback_amount_reconciliation(models("raw_chargebacks"), cb(), fact())),
        Test("cohorts_reconcile", lambda: cohort_reconciliation(models("cohort_daily"), fact())),
        Test("attempts_grain", lambda: unique_combination(fact(), "transaction_id")),
        Test("chargebacks_grain", lambda: unique_combination(cb(), "chargeback_id")),
        Test("cohorts_grain", lambda: unique_combination(models("cohort_daily"), "cohort_date", "payment_method")),
        Test("status_values", lambda: accepted_values(fact(), "status", ["approved", "declined", "error"])),
        Test("method_values", lambda: accepted_values(fact(), "payment_method", ["credit_card", "debit_card", "pix", "boleto"]), "warn"),
        Test("action_values", lambda: accepted_values(fact(), "risk_action", ["approve", "reject", "review"])),
        Test("decline_source_values", lambda: accepted_values(fact(), "decline_source", ["technical_error", "manual_review", "risk_engine", "unknown_no_risk_evaluation", "issuer_or_acquirer"])),
        Test("issuer_decline_values", lambda: accepted_values(fact(), "issuer_decline_type", ["approved", "soft", "hard", "unknown"])),
        Test("label_source_values", lambda: accepted_values(models("fraud_labels"), "label_source", ["issuer_fraud_report", "chargeback_fraud", "fraud_refund", "dispute_alert", "pix_med_claim"])),
        Test("score_range", lambda: expression_is_true(fact(), "risk_score between 0 and 100")),
        Test("amount_positive", lambda: expression_is_true(fact(), "amount > 0")),
        Test("chargeback_amount_positive", lambda: expression_is_true(cb(), "cb_amount > 0")),
        Test("dedup_at_most_all", lambda: expression_is_true(models("cohort_daily"), "approved_count_dedup <= approved_count")),
        Test("evaluation_has_transaction", lambda: relationship(models("stg_evaluations"), "transaction_id", models("stg_transactions"), "transaction_id"), "warn"),
        Test("chargeback_has_transaction", lambda: relationship(models("stg_chargebacks"), "transaction_id", models("stg_transactions"), "transaction_id"), "warn"),
    ]
    keys = {"payment_attempts": ["transaction_id", "cohort_date", "status", "payment_method"], "fct_chargebacks": ["chargeback_id", "transaction_id"], "cohort_daily": ["cohort_date"], "stg_transactions": ["transaction_id", "user_id", "transaction_at"], "stg_evaluations": ["evaluation_id", "transaction_id"]}
    return tests + [Test(f"{m}_{c}_not_null", lambda m=m, c=c: not_null(models(m), c)) for m, cs in keys.items() for c in cs]


def run(tests: list[Test], audit_path: str | None = None) -> list[tuple[str, int, str]]:
    """(test, violations, status) of each test; violations are kept below audit_path."""
    out = []
    for t in tests:
        rows = t.rows()
        n = rows.count()
        if n and audit_path:
            rows.write.mode("overwrite").parquet(f"{audit_path}/{t.name}")
        out.append((t.name, n, t.status(n)))
    return out
