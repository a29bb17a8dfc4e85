"""Command lines: `python -m riskmart build|refresh|velocity|late-chargeback --raw FOLDER --to FOLDER` (under spark-submit on a cluster).

build writes all models (or --select's) from the feeds, refresh brings the stored fact and cohorts up to them, velocity writes the last day's features, and late-chargeback shows a
cohort's rate before and after a chargeback 120 days after the sale. --form tells whether the feeds are CSV or Parquet. Lookup tables that the folder has as CSV files
(ref_reason_codes.csv, ref_response_codes.csv) take the place of those that are built in.
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.operators.features import velocity_job
from riskmart.plans import dag
from riskmart.sources import files, lookups


def late_chargeback(w: dag.Warehouse, transaction_id: str, amount: str) -> DataFrame:
    """moment, and the cohort of the transaction with its card chargeback rate, before and after the chargeback."""
    sale = w("stg_transactions").where(F.col("transaction_id") == transaction_id).agg(F.max("transaction_at")).first()[0]
    at = F.lit(sale).cast("timestamp_ntz") + F.expr("INTERVAL '120' DAY")
    raw = w("raw_chargebacks")
    given = {"chargeback_id": F.lit(f"late_{transaction_id}"), "transaction_id": F.lit(transaction_id), "chargeback_at": at.cast("string"), "reason_code": F.lit("10.4"), "cb_amount": F.lit(amount), "_ingested_at": at}
    late = w.spark.range(1).select(*[given.get(c, F.lit(None)).cast(raw.schema[c].dataType).alias(c) for c in raw.columns])
    after = dag.Warehouse(w.spark, w.raw | {"raw_chargebacks": raw.unionByName(late)}, w.config)
    out = None
    for moment, x in (("before", w), ("after", after)):
        card = x("payment_attempts").where("is_approved and is_chargeback_eligible").where(F.col("cohort_date") == F.to_date(F.lit(sale)))
        one = card.groupBy("cohort_date").agg(F.sum("chargeback_amount").alias("chargeback_amount"), F.sum("amount").alias("approved_amount"))
        one = one.select(F.lit(moment).alias("moment"), "*", (F.col("chargeback_amount").cast("double") / F.col("approved_amount").cast("double")).alias("rate"))
        out = one if out is None else out.unionByName(one)
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="riskmart", description=__doc__)
    p.add_argument("command", choices=("build", "refresh", "velocity", "late-chargeback"))
    p.add_argument("--raw", required=True)
    p.add_argument("--to")
    p.add_argument("--form", choices=("csv", "parquet"), default="csv")
    p.add_argument("--select", help="models, as in `+cohort_daily layer:staging`")
    p.add_argument("--as-of", type=date.fromisoformat)
    p.add_argument("--transaction")
    p.add_argument("--amount", default="500.00")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("riskmart").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w = dag.Warehouse(spark, files.folder(spark, a.raw, a.form), Config(as_of=a.as_of) if a.as_of else Config(), lookups.folder(spark, a.raw))
    if a.command != "late-chargeback" and not a.to:
        p.error("--to is missing")
    if a.command == "build":
        print("\n".join(w.build(a.to, dag.select(a.select) if a.select else None)))
    elif a.command == "refresh":
        print("\n".join(map(str, w.refresh(a.to))))
    elif a.command == "velocity":
        now = w("stg_transactions").agg(F.max("transaction_at")).first()[0]
        files.write_table(velocity_job(w("stg_transactions"), now, w.config), a.to)
    else:
        late_chargeback(w, a.transaction, a.amount).show(truncate=False)


if __name__ == "__main__":
    main()
