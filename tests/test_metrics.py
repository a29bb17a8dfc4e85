"""Metrics over several models and the time spine, distinct counts from sketches, history as it was reported."""

from __future__ import annotations

import random
from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.operators import dimensions, snapshot
from riskmart.plans import semantic
from riskmart.plans.semantic import SKETCH_ERROR


@pytest.fixture(scope="module")
def models(spark):
    sales = [(date(2026, 1, 5), "pix", True, "10.00"), (date(2026, 1, 6), "pix", False, "10.00"), (date(2026, 4, 1), "pix", True, "30.00"), (date(2026, 2, 1), None, True, "5.00"), (None, "pix", True, "7.00")]
    attempts = spark.createDataFrame([(d, m, ok, D(a), D("0.00")) for d, m, ok, a in sales], "cohort_date date, payment_method string, is_approved boolean, amount decimal(18,2), chargeback_amount decimal(38,2)")
    disputes = spark.createDataFrame([(date(2026, 5, 9), "pix", True, D("4.00")), (date(2026, 1, 9), "card", True, D("2.00")), (date(2026, 1, 10), "card", False, D("1.00"))], "chargeback_date date, payment_method string, is_fraud_reason boolean, cb_amount decimal(18,2)")
    spine = dimensions.time_spine(spark, Config(calendar=(date(2026, 1, 1), date(2026, 4, 30))))
    return {"payment_attempts": attempts, "fct_chargebacks": disputes, "time_spine": spine}.__getitem__


def test_timeline_fills_gaps_of_the_calendar(models):
    got = [tuple(r) for r in semantic.timeline(models, ["approval_rate", "gross_fraud_loss", "attempts"], "month").orderBy("period").collect()]
    assert got == [(date(2026, 1, 1), 0.5, D("2.00"), 2), (date(2026, 2, 1), 1.0, D("0.00"), 1), (date(2026, 3, 1), None, D("0.00"), 0), (date(2026, 4, 1), 1.0, D("0.00"), 1)]  # May is beyond the calendar


def test_timeline_by_a_shared_dimension(models):
    got = {(r.payment_method, r.period.month): (r.approval_rate, r.gross_chargeback_loss) for r in semantic.timeline(models, ["approval_rate", "gross_chargeback_loss"], "quarter", ["payment_method"]).collect()}
    assert got == {("pix", 1): (0.5, D("0.00")), ("pix", 4): (1.0, D("4.00")), ("card", 1): (None, D("3.00")), (None, 1): (1.0, D("0.00"))}
    with pytest.raises(ValueError, match="country"):
        semantic.timeline(models, ["approval_rate", "gross_chargeback_loss"], "day", ["country"])
    assert semantic.timeline(models, ["attempts"], "week").orderBy("period").first().period == date(2026, 1, 5)


def test_sketches_roll_up_within_their_error(spark):
    rng = random.Random(2)
    rows = [(date(2026, 1 + rng.randrange(2), 1 + rng.randrange(28)), f"o{rng.randrange(30_000)}") for _ in range(60_000)] + [(date(2026, 3, 1), None)]
    df = spark.createDataFrame(rows, "cohort_date date, order_id string").repartition(4)
    daily = semantic.sketches(df, "orders", ["cohort_date"])
    got = {r.period.month: r.distinct_estimate for r in semantic.distinct_of(daily, [F.trunc("cohort_date", "month").alias("period")]).collect()}
    for month in (1, 2):
        exact = len({o for d, o in rows if d.month == month})
        assert abs(got[month] - exact) <= SKETCH_ERROR * exact
    assert got[3] == 0
    with pytest.raises(ValueError, match="sum"):
        semantic.sketches(df, "attempts", ["cohort_date"])


def test_history_as_it_was_reported(spark):
    t = lambda n: datetime(2026, 1, n)
    versions = [("a", 1, t(1), t(5)), ("a", 2, t(5), None), ("b", 7, t(3), t(4)), ("c", 9, t(9), None)]
    df = spark.createDataFrame(versions, "k string, n int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = sorted((r.reported_at.day, r.k, r.n) for r in snapshot.as_reported(df, [t(2), t(3), t(5), t(5), t(30)]).collect())
    assert got == [(2, "a", 1), (3, "a", 1), (3, "b", 7), (5, "a", 2), (30, "a", 2), (30, "c", 9)]
    assert snapshot.as_reported(df, [datetime(2020, 1, 1)]).count() == 0
