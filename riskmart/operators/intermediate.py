"""What is known of a transaction: the decision in force, chargebacks, fraud labels, suspected duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import seconds, total
from riskmart.functions.frames import in_time_blocks


def risk_decision(evaluations: DataFrame, transactions: DataFrame, config: Config) -> DataFrame:
    """The evaluation in force at authorisation: the last one up to the clock skew after it, else the last of all. One aggregation instead of a window: no sort of a transaction's evaluations."""
    when = transactions.select("transaction_id", "transaction_at")
    known = evaluations.join(when, "transaction_id").withColumn("is_pre_authorization", F.col("evaluated_at") <= F.col("transaction_at") + F.expr(f"INTERVAL '{config.clock_skew_seconds}' SECOND"))
    kept = ["evaluation_id", "evaluated_at", "risk_score", "risk_action", "rule_triggered", "decision_source", "is_pre_authorization"]
    # Nulls go last in a descending order; in a struct they are least, which is the same for max_by.
    order = F.struct("is_pre_authorization", "evaluated_at", "evaluation_id")
    best = known.groupBy("transaction_id").agg(
        F.max_by(F.struct(*kept), order).alias("best"),
        F.count("*").alias("evaluation_count"),
        F.count_if(~F.col("is_pre_authorization")).alias("post_authorization_evaluation_count"),
    )
    return best.select("transaction_id", "best.*", "evaluation_count", "post_authorization_evaluation_count")


def chargebacks_per_transaction(chargebacks: DataFrame) -> DataFrame:
    fraud = F.col("is_fraud_reason")
    return chargebacks.groupBy("transaction_id").agg(
        F.count("*").alias("chargeback_count"),
        total("cb_amount").alias("chargeback_amount"),
        total("cb_amount", fraud).alias("fraud_chargeback_amount"),
        (F.count_if(fraud) > 0).alias("has_fraud_chargeback"),
        F.min("chargeback_at").alias("first_chargeback_at"),
        F.max("chargeback_at").alias("last_chargeback_at"),
        F.max("_ingested_at").alias("last_chargeback_ingested_at"),
    )


def fraud_labels_per_transaction(labels: DataFrame) -> DataFrame:
    """The first evidence; of several at that moment, the source first in order."""
    return labels.groupBy("transaction_id").agg(
        F.min("label_at").alias("first_fraud_label_at"),
        F.min_by("label_source", F.when(F.col("label_at").isNotNull(), F.struct("label_at", "label_source"))).alias("first_fraud_label_source"),
        F.count("*").alias("fraud_evidence_count"),
        F.array_join(F.array_sort(F.collect_set("label_source")), ",").alias("fraud_label_sources"),
    )


def duplicate_suspects(transactions: DataFrame, config: Config) -> DataFrame:
    """Transactions with another of the same user, amount and method within the window. Pairwise, not transitive; the first of a group is that of least id. A range window over seconds, within blocks of time, finds the same rows as a self-join, without a row for each pair."""
    n = config.duplicate_seconds
    near = Window.partitionBy("user_id", "amount", "payment_method", "_block").orderBy("_second").rangeBetween(-n, n)
    keyed = transactions.where("user_id is not null and amount is not null and payment_method is not null and transaction_at is not null").withColumn("_second", seconds("transaction_at"))
    dealt = in_time_blocks(keyed.select("transaction_id", "user_id", "amount", "payment_method", "_second"), n, n)
    found = dealt.select("transaction_id", F.min("transaction_id").over(near).alias("first_transaction_id_in_group"), F.count("*").over(near).alias("group_size"), "_home")
    return found.where("_home and group_size > 1").drop("_home").withColumn("is_duplicate_candidate", F.col("transaction_id") != F.col("first_transaction_id_in_group"))
