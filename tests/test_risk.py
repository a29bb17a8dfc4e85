"""Cases of the payment-risk operators on small feeds with known results."""

from __future__ import annotations

import shutil
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.frames import latest_by
from riskmart.operators import aggregates, features, incremental, intermediate, quality, snapshot, staging
from riskmart.plans import dag, queries, semantic
from riskmart.plans.dag import Warehouse
from riskmart.sources import lookups
from riskmart.sources.files import raw_rows

#: Published rows, here and in the results below.
DAY = "2026-03-01 "
TX = [
    ("tx_1001", "usr_01", DAY + "10:00:00", "150.00", "approved", "credit_card", DAY + "10:00:05"),
    ("tx_1002", "usr_02", DAY + "10:05:00", "500.00", "declined", "credit_card", DAY + "10:05:04"),
    ("tx_1003", "usr_01", DAY + "10:15:00", "1200.00", "approved", "pix", DAY + "10:15:03"),
    ("tx_1004", "usr_03", DAY + "11:30:00", "350.00", "approved", "credit_card", DAY + "11:30:04"),
    ("tx_1005", "usr_03", DAY + "11:30:00", "350.00", "approved", "credit_card", DAY + "11:30:04"),
]
EV = [
    ("eval_01", "tx_1001", DAY + "09:59:58", "12", "approve", None, DAY + "10:00:00"),
    ("eval_02", "tx_1002", DAY + "10:04:59", "89", "reject", "rule_high_velocity", DAY + "10:05:00"),
    ("eval_03", "tx_1003", DAY + "10:14:55", "05", "approve", "", DAY + "10:15:00"),
    ("eval_04", "tx_1004", DAY + "11:29:50", "45", "approve", "rule_manual_review_pass", DAY + "11:30:00"),
]
CB = [("cb_901", "tx_1001", "2026-03-15 14:00:00", "10.4_fraud", "150.00", "2026-03-15 14:05:00")]
LATE = ("cb_902", "tx_1004", "2026-06-29 09:00:00", "10.4_fraud", "350.00", "2026-06-29 09:05:00")


def feeds(spark, tx=TX, ev=EV, cb=CB, **more):
    return {"raw_transactions": raw_rows(spark, "raw_transactions", tx), "raw_risk_evaluations": raw_rows(spark, "raw_risk_evaluations", ev), "raw_chargebacks": raw_rows(spark, "raw_chargebacks", cb)} | {k: raw_rows(spark, k, v) for k, v in more.items()}


@pytest.fixture(scope="module")
def seed(spark):
    return Warehouse(spark, feeds(spark), Config(as_of=date(2026, 10, 3)))


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_attempts_flag_and_never_drop(seed):
    rows = by(seed("payment_attempts"), "transaction_id")
    assert len(rows) == 5
    assert rows["tx_1005"].is_approved_without_risk_evaluation and rows["tx_1005"].is_duplicate_candidate
    assert rows["tx_1005"].duplicate_of_transaction_id == "tx_1004" == rows["tx_1004"].duplicate_of_transaction_id
    assert rows["tx_1002"].decline_source == "risk_engine" and rows["tx_1002"].issuer_decline_type is None
    assert rows["tx_1004"].decision_source == "manual_review" and rows["tx_1003"].risk_score == 5


def test_contract(seed):
    assert quality.contract_violations(seed("fct_payment_attempts")) == []


def test_published_rates(seed):
    rows = [(r.approval_rate_pct, r.chargeback_rate_qty_pct, r.chargeback_rate_amount_pct) for r in seed("metric_sensitivity").collect()]
    assert rows == [(80.0, 25.0, 7.32), (75.0, 33.33, 8.82), (75.0, 33.33, 17.65), (66.67, 50.0, 30.0)]


def test_velocity(seed):
    rows = by(seed("velocity"), "transaction_id")
    found = {k: (r.user_attempts_10m, r.user_attempts_24h, r.user_amount_24h) for k, r in rows.items()}
    assert found == {"tx_1001": (0, 0, D("0.00")), "tx_1002": (0, 0, D("0.00")), "tx_1003": (0, 1, D("150.00")), "tx_1004": (1, 1, D("350.00")), "tx_1005": (1, 1, D("350.00"))}


def test_late_chargeback_reopens_its_cohort_only(spark, seed):
    config = seed.config
    old = seed("payment_attempts")
    new = Warehouse(spark, feeds(spark, cb=[*CB, LATE]), config)
    marks = {"_tx_watermark": DAY + "11:30:04", "_cb_watermark": "2026-03-15 14:05:00"}
    keys = incremental.affected_keys(new("stg_transactions"), {"_tx_watermark": new("stg_transactions").where("false"), "_cb_watermark": new("stg_chargebacks").where("chargeback_id = 'cb_902'")}, marks, config)
    assert {r[0] for r in keys.collect()} == {"tx_1004", "tx_1005"}
    again = incremental.only(new("payment_attempts"), keys)
    merged = incremental.merge_by_key(old, again, "transaction_id")
    twice = incremental.merge_by_key(merged, again, "transaction_id")
    assert merged.count() == twice.count() == 5
    cohorts = incremental.affected_cohorts(old, again)
    assert [r[0] for r in cohorts.collect()] == [date(2026, 3, 1)]
    rows = by(aggregates.cohort_daily(merged), "payment_method")
    assert (rows["credit_card"].chargeback_amount, rows["credit_card"].approved_amount) == (D("500.00"), D("850.00"))
    assert (rows["pix"].attempt_count, rows["pix"].approved_amount, rows["pix"].chargeback_amount) == (1, D("1200.00"), D("0.00"))


def test_decision_is_the_last_before_authorisation(spark):
    tx = [("tx_a", "u", DAY + "10:00:00", "1", "approved", "pix", DAY + "10:00:01")]
    ev = [("e1", "tx_a", DAY + "09:59:50", "1", "review", None, DAY + "10:00:00"), ("e2", "tx_a", DAY + "09:59:58", "1", "approve", None, DAY + "10:00:00"), ("e3", "tx_a", DAY + "10:30:00", "1", "reject", None, DAY + "10:30:00")]
    (r,) = Warehouse(spark, feeds(spark, tx, ev, []))("risk_decision").collect()
    assert (r.evaluation_id, r.risk_action, r.evaluation_count, r.post_authorization_evaluation_count) == ("e2", "approve", 3, 1)


def test_reason_codes(spark):
    raw = raw_rows(spark, "raw_chargebacks", [(str(i), "t", DAY + "10:00:00", c, "1", DAY + "11:00:00") for i, c in enumerate(["10.4_fraud", "13.1", "4837", "99.9_new"])])
    rows = [(r.network_reason_code, r.reason_category, r.is_fraud_reason) for r in staging.chargebacks(raw, lookups.reason_codes(spark)).orderBy("chargeback_id").collect()]
    assert rows == [("10.4", "fraud", True), ("13.1", "consumer_dispute", False), ("4837", "fraud", True), ("99.9", "unmapped", False)]
    codes = [r[1] for r in lookups.REASON_CODES]
    assert len(codes) == len(set(codes))


def test_duplicates_within_a_minute(spark):
    tx = [*TX[3:], ("tx_1006", "usr_03", DAY + "11:35:00", "350.00", "approved", "credit_card", DAY + "11:35:04"), ("tx_1007", None, DAY + "11:35:00", "350.00", "approved", "credit_card", DAY + "11:35:04")]
    w = Warehouse(spark, feeds(spark, tx, [], []))
    rows = [tuple(r) for r in w("duplicate_suspects").orderBy("transaction_id").collect()]
    assert rows == [("tx_1004", "tx_1004", 2, False), ("tx_1005", "tx_1004", 2, True)]


def test_time_blocks_change_no_window(spark):
    """One user with attempts on both sides of every block's end, at equal seconds and without a time: as counted by hand."""
    config = Config(velocity_seconds=(3, 10), duplicate_seconds=5)
    at = [*range(155, 166), 160, 160, *range(314, 326, 3), 80, 85, 90, 95, None, None]
    rows = [(f"t{i:02}", "u", None if s is None else datetime(1970, 1, 1) + timedelta(seconds=s), D("2.00"), "pix") for i, s in enumerate(at)]
    df = spark.createDataFrame(rows, "transaction_id string, user_id string, transaction_at timestamp_ntz, amount decimal(18,2), payment_method string")

    def within(i, low, high):
        return [f"t{j:02}" for j, s in enumerate(at) if (s is None) == (at[i] is None) and (s is None or low <= s - at[i] <= high)]

    got = by(features.velocity(df, config), "transaction_id")
    assert len(got) == len(at)
    for i in range(len(at)):
        assert [got[f"t{i:02}"].user_attempts_10m, got[f"t{i:02}"].user_attempts_24h] == [len(within(i, -n, 0)) - 1 for n in (3, 10)]
        assert got[f"t{i:02}"].user_amount_24h == 2 * (len(within(i, -10, 0)) - 1)
    groups = {f"t{i:02}": within(i, -5, 5) for i, s in enumerate(at) if s is not None}
    found = intermediate.duplicate_suspects(df, config).collect()
    assert sorted((r.transaction_id, r.first_transaction_id_in_group, r.group_size) for r in found) == sorted((t, min(g), len(g)) for t, g in groups.items() if len(g) > 1)
    changed = spark.createDataFrame([("t05",), ("t13",)], "transaction_id string")
    assert sorted(r[0] for r in incremental.neighbours(df, changed, config).collect()) == sorted(t for t, g in groups.items() if {"t05", "t13"} & set(g))


def test_velocity_from_sums_equals_the_window(spark):
    """Nulls in user, time and amount, equal seconds, windows that end at rows, hours without any."""
    import random

    rng = random.Random(4)
    config = Config(velocity_seconds=(600, 86400))
    at = lambda: None if rng.random() < 0.1 else datetime(2026, 1, 1) + timedelta(seconds=rng.choice([0, 600, 601, 3599, 3600, 86400, 86401, 90000, rng.randrange(400_000)]))
    rows = [(f"t{i}", rng.choice(["hot", "hot", "hot", "b", "", None]), at(), rng.choice([D("1.50"), D("2.00"), None])) for i in range(400)]
    df = spark.createDataFrame(rows, "transaction_id string, user_id string, transaction_at timestamp_ntz, amount decimal(18,2)")
    got, expected = (sorted(map(str, f(df, config).collect())) for f in (features.velocity_from_sums, features.velocity))
    assert got == expected and len(got) == 400


def test_velocity_of_a_user_with_a_million_attempts_in_a_day(spark):
    n, per_second = 1_000_000, 12
    df = spark.range(n).select(F.col("id").cast("string").alias("transaction_id"), F.lit("hot").alias("user_id"), (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(F.col("id") / per_second))).alias("transaction_at"), F.lit(D("1.00")).cast("decimal(18,2)").alias("amount"))
    (r,) = features.velocity_from_sums(df, Config()).agg(F.count("*").alias("n"), F.max("user_attempts_10m").alias("short"), F.max("user_attempts_24h").alias("long"), F.sum("user_attempts_10m").alias("total")).collect()
    full = [per_second * min(s + 1, 601) - 1 for s in range(-(-n // per_second))]
    last = n - (len(full) - 1) * per_second
    assert (r.n, r.short, r.long) == (n, per_second * 601 - 1, n - 1)
    assert r.total == sum(x * per_second for x in full[:-1]) + last * (full[-1] - (per_second - last))


def test_first_label(spark):
    w = Warehouse(spark, feeds(spark, raw_issuer_fraud_reports=[("r1", "tx_1001", "visa", "2026-03-05 08:00:00", "x", "2026-03-05 09:00:00")]))
    (r,) = w("fraud_labels_per_tx").collect()
    assert (str(r.first_fraud_label_at), r.first_fraud_label_source, r.fraud_evidence_count, r.fraud_label_sources) == ("2026-03-05 08:00:00", "issuer_fraud_report", 2, "chargeback_fraud,issuer_fraud_report")


def test_decline_sources(spark):
    def tx(k, status):
        return (k, "u_" + k, DAY + "10:00:00", "10", status, "credit_card", DAY + "10:00:05")

    def ev(k, action, rule=None):
        return ("e_" + k, k, DAY + "09:59:59", "50", action, rule, DAY + "10:00:00")

    w = Warehouse(spark, feeds(
        spark, [tx("a", "declined"), tx("b", "error"), tx("c", "declined"), tx("d", "declined"), tx("e", "declined")], [ev("a", "reject"), ev("c", "approve"), ev("e", "reject", "rule_manual_review_no")], [],
        raw_payment_enrichment=[("c", "m", "o", "br", "visa", None, None, None, "51", "x", None, None, "brl", DAY + "10:00:00")],
    ))
    rows = {k: (r.decline_source, r.issuer_decline_type) for k, r in by(w("payment_attempts"), "transaction_id").items()}
    assert rows == {"a": ("risk_engine", None), "b": ("technical_error", None), "c": ("issuer_or_acquirer", "soft"), "d": ("unknown_no_risk_evaluation", "unknown"), "e": ("manual_review", None)}


def test_network_ratios(spark):
    def tx(k, at, amount):
        return (k, "u_" + k, at, amount, "approved", "credit_card", at)

    def extra(k, merchant, network, settled):
        return (k, merchant, "o_" + k, "br", network, None, None, None, None, "captured", settled, "30", "brl", settled)

    v, c = [f"v{i}" for i in range(4)], [f"c{i}" for i in range(2)]
    w = Warehouse(spark, feeds(
        spark, [tx(k, "2026-03-02 10:00:00", "100.00") for k in v] + [tx(k, "2026-02-02 10:00:00", "200.00") for k in c], [],
        [("b1", "v0", "2026-03-20 10:00:00", "10.4", "100.00", "2026-03-20 10:00:00"), ("b2", "c0", "2026-03-20 10:00:00", "4853", "200.00", "2026-03-20 10:00:00")],
        raw_payment_enrichment=[extra(k, "m_v", "visa", "2026-03-03 10:00:00") for k in v] + [extra(k, "m_c", "mastercard", "2026-02-03 10:00:00") for k in c],
        raw_issuer_fraud_reports=[("r", "v1", "visa", "2026-03-10 10:00:00", "x", "2026-03-10 10:00:00")],
    ), Config(as_of=date(2026, 10, 3)))
    rows = {(r.merchant_id, r.month_start.month): r for r in w("network_monitoring").collect()}
    a, b, d = rows["m_v", 3], rows["m_c", 2], rows["m_c", 3]
    assert (a.settled_count, a.previous_month_settled_count, a.visa_vamp_ratio, a.visa_vamp_status) == (4, 0, 0.5, "abaixo_do_piso_de_volume")
    assert (b.settled_count, b.mc_ecm_ratio, b.visa_vamp_ratio) == (2, None, None)
    assert (d.settled_count, d.previous_month_settled_count, d.dispute_count, d.mc_ecm_ratio) == (0, 2, 1, 0.5)


def test_incremental_overlap_and_neighbours(spark):
    tx = [("tx_old", "u1", DAY + "04:00:00", "1", "approved", "pix", DAY + "05:00:00"), ("tx_late", "u2", DAY + "04:00:00", "1", "approved", "pix", DAY + "11:00:00"),
          ("tx_dup_old", "u3", DAY + "00:30:00", "9", "approved", "pix", DAY + "01:00:00"), ("tx_new", "u3", DAY + "00:30:00", "9", "approved", "pix", DAY + "12:30:00")]
    w = Warehouse(spark, feeds(spark, tx, [], []))
    keys = incremental.affected_keys(w("stg_transactions"), {"_tx_watermark": w("stg_transactions")}, {"_tx_watermark": DAY + "12:00:00"}, w.config)
    assert {r[0] for r in keys.collect()} == {"tx_late", "tx_dup_old", "tx_new"}
    assert {r.transaction_id for r in w("payment_attempts").where("is_duplicate_candidate").collect()} == {"tx_new"}


def test_moved_sale_recomputes_both_cohorts(spark, seed):
    moved = [(*TX[0][:2], "2026-03-02 10:00:00", *TX[0][3:6], "2026-03-02 10:00:05"), *TX]
    new = Warehouse(spark, feeds(spark, moved), seed.config)("payment_attempts")
    cohorts = incremental.affected_cohorts(seed("payment_attempts"), new.where("transaction_id = 'tx_1001'"))
    assert {r[0] for r in cohorts.collect()} == {date(2026, 3, 1), date(2026, 3, 2)}


@pytest.fixture(scope="module")
def moving(spark):
    """A payment, an evaluation and a chargeback that move after the cut, away from what they were beside, and a payment that loses its date."""
    may, june = "2001-05-01 ", "2001-06-20 10:00:00"
    tx = [(f"t{i}", f"u{i // 2}", f"{may}10:00:{i % 2}0", "9.00", "approved", "credit_card", may + "10:05:00") for i in range(8)] + [("far", "u0", "2001-04-01 10:00:00", "9.00", "approved", "credit_card", may + "10:05:00")]
    moved = [("t0", "u0", "2001-05-03 10:00:00", "9.00", "approved", "credit_card", june), ("t2", "u7", may + "10:00:00", "9.00", "approved", "credit_card", june), ("t4", "u2", None, "9.00", "approved", "credit_card", june)]
    return Warehouse(spark, feeds(
        spark, tx + moved, [("e1", "t5", may + "10:00:00", "50", "approve", None, may + "10:05:00"), ("e1", "t6", may + "10:00:00", "50", "approve", None, june)],
        [("c1", "t7", may + "11:00:00", "10.4", "9.00", may + "11:05:00"), ("c1", "t6", may + "11:00:00", "10.4", "9.00", june)],
        raw_payment_enrichment=[("t7", "m", "o1", "br", "visa", "f", "4", "", "00", "captured", None, "2", "brl", june)],
    ), Config())


@pytest.mark.parametrize("limit", [4_000_000, 0])  # sent to all tasks, or joined by shuffles
@pytest.mark.parametrize("name", ["incremental_merge", "cohort_reprocess"])
def test_what_moves_away_is_made_anew(moving, monkeypatch, name, limit):
    monkeypatch.setattr(incremental, "SENT_HASHES", limit, raising=False)
    made, whole = {"incremental_merge": (queries._incremental_merge, "payment_attempts"), "cohort_reprocess": (queries._cohort_reprocess, "cohort_daily")}[name]
    found, expected = (sorted(map(repr, queries.finished(df).collect())) for df in (made(moving), moving(whole)))
    assert found == expected


def test_reopened_reads_what_is_in_reach(spark, moving):
    raw = {k: moving.raw[k] for k in ("raw_transactions", "raw_risk_evaluations", "raw_chargebacks")}
    keys, context, cut = incremental.reopened(raw, queries.FEEDS, queries.CUT, moving.config, raw)
    assert {r[0] for r in keys.collect()} == {"t0", "t1", "t2", "t3", "t4", "t5", "t6", "t7"}
    assert {r.transaction_id for r in context.collect()} == {f"t{i}" for i in range(8)}  # not the user's payment of another month
    assert {k: df.count() for k, df in cut.items()} == {"raw_transactions": 11, "raw_risk_evaluations": 2, "raw_chargebacks": 2}


def test_sales_are_attempts_of_fewer_columns(moving):
    sales = queries._sales(moving).drop("_updated_at")
    assert sorted(map(repr, sales.collect())) == sorted(map(repr, moving("payment_attempts").select(*sales.columns).collect()))


def test_upsert_creates_and_merges(spark, tmp_path):
    path = str(tmp_path / "features")
    incremental.upsert(spark, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    incremental.upsert(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, "k")
    assert sorted(map(tuple, incremental.read_version(spark, path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_upsert_leaves_other_buckets_alone(spark, tmp_path, monkeypatch):
    path = tmp_path / "features"
    incremental.upsert(spark, spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v")), str(path), "k", buckets=64)
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    ten = spark.range(0, 100, 10).select(F.col("id").alias("k"), F.lit("b").alias("v"), F.lit(1).alias("more"))
    incremental.upsert(spark, ten, str(path), "k")
    kept = {f for f, t in before.items() if f.exists() and f.stat().st_mtime_ns == t}
    assert len(before) == 64 and len(kept) >= 54
    rows = incremental.read_version(spark, str(path))
    assert (rows.count(), rows.where("v = 'b' and more = 1").count(), rows.where("v = 'a' and more is null").count()) == (2000, 10, 1990)
    # It breaks off after some buckets are gone: the next run puts them in place first.
    own = incremental.write_table

    def breaks(df, to, *args, **more):
        if to == str(path):
            for f in list(path.glob("_bucket=*"))[:5]:
                shutil.rmtree(f)
            raise RuntimeError("gone")
        own(df, to, *args, **more)

    monkeypatch.setattr(incremental, "write_table", breaks)
    every = spark.range(2000).select(F.col("id").alias("k"), F.lit("c").alias("v"), F.lit(2).alias("more"))
    with pytest.raises(RuntimeError, match="gone"):
        incremental.upsert(spark, every, str(path), "k")
    monkeypatch.undo()
    incremental.upsert(spark, ten, str(path), "k")
    rows = incremental.read_version(spark, str(path))
    assert (rows.count(), rows.where("v = 'c'").count(), rows.where("v = 'b'").count()) == (2000, 1990, 10)
    assert incremental.read_version(spark, str(tmp_path / "none")) is None


def test_upsert_makes_what_is_new_once_and_in_groups(spark, tmp_path, monkeypatch):
    path, made = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(500).withColumn("v", F.lit("a"))
    incremental.upsert(spark, rows.mapInPandas(seen, rows.schema), path, "id", buckets=8)
    assert made.value == 500
    monkeypatch.setattr(incremental, "SENT_KEYS", 100)  # some buckets at a time
    more = spark.range(250, 750).withColumn("v", F.lit("b"))
    for n in (1000, 1500):
        incremental.upsert(spark, more.mapInPandas(seen, more.schema), path, "id")
        assert made.value == n
    found = incremental.read_version(spark, path)
    assert (found.count(), found.where("v = 'a' and id < 250").count(), found.where("v = 'b' and id >= 250").count()) == (750, 250, 500)


def test_snapshot_versions(spark, seed):
    first = snapshot.start(seed("cohort_daily").drop("_updated_at"), "2026-04-01")
    late = Warehouse(spark, feeds(spark, cb=[*CB, LATE]), seed.config)("cohort_daily").drop("_updated_at")
    now = snapshot.advance(first, late, "2026-07-01")
    again = snapshot.advance(now, late, "2026-07-02")
    rows = sorted((r.payment_method, r.chargeback_amount, str(r.valid_from)[:10], r.valid_to and str(r.valid_to)[:10]) for r in again.collect())
    assert rows == [("credit_card", D("150.00"), "2026-04-01", "2026-07-01"), ("credit_card", D("500.00"), "2026-07-01", None), ("pix", D("0.00"), "2026-04-01", None)]


def test_suite_finds_the_two_warnings(seed):
    found = {t.name: (t.rows().count(), t) for t in quality.suite(seed) if t.name in ("approved_without_evaluation", "duplicate_candidates", "attempts_grain", "cohorts_reconcile", "chargeback_amount_reconciles")}
    assert {k: (n, t.status(n)) for k, (n, t) in found.items()} == {"approved_without_evaluation": (1, "warn"), "duplicate_candidates": (1, "warn"), "attempts_grain": (0, "pass"), "cohorts_reconcile": (0, "pass"), "chargeback_amount_reconciles": (0, "pass")}
    assert quality.card_data_columns({"t": seed("payment_attempts")}) == []


def test_contract_rules(spark, seed):
    rules = by(quality.contract_rules(seed, Config()), "rule")
    assert rules["orphan_chargebacks"].status == "pass" and rules["orphan_chargebacks"].value == 0
    assert (rules["approved_without_evaluation"].n_bad, rules["approved_without_evaluation"].n_rows, rules["approved_without_evaluation"].status) == (1, 4, "error")
    assert (rules["incomplete_attempts"].n_bad, rules["incomplete_attempts"].status) == (5, "error")  # no enrichment: no merchant, no order
    at_limit = by(quality.share_rules(spark.range(200), {"at": ("id = 7", "true", 0.005), "under": ("id = 7", "true", 0.0051), "none": ("true", "id > 200", 0.005), "zero": ("id is null", "true", 0.0)}), "rule")
    assert {k: (r.value, r.status) for k, r in at_limit.items()} == {"at": (0.005, "error"), "under": (0.005, "pass"), "none": (None, "pass"), "zero": (0.0, "pass")}


def test_business_days(spark):
    days = [date(2026, 2, 20) + timedelta(days=i) for i in range(24)] + [date(1969, 12, 20), date(1970, 1, 4), None]
    rows = [(a, b) for a in days for b in days if None in (a, b) or a <= b]
    got = spark.createDataFrame(rows, "a date, b date").select("a", "b", quality.business_days(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        expected = None if None in (r.a, r.b) else sum((r.a + timedelta(days=i)).weekday() < 5 for i in range(1, (r.b - r.a).days + 1))
        assert r.n == expected, r


def test_volume_anomalies(spark):
    """Ten or eleven rows a day for 40 days but for the 35th, which has none, and the 38th with 90."""
    counts = [0 if d == 34 else 90 if d == 37 else 10 + d % 2 for d in range(40)]
    rows = [(datetime(2026, 1, 1) + timedelta(days=d, hours=1),) for d, n in enumerate(counts) for _ in range(n)] + [(None,)]
    found = quality.volume_anomalies(spark.createDataFrame(rows, "at timestamp_ntz"), "at", Config()).orderBy("metric_date").collect()
    assert [r.row_count for r in found] == counts
    assert [i for i, r in enumerate(found) if r.status == "anomaly"] == [34, 37]
    assert [r.status for r in found[:28]] == ["no_baseline"] * 28
    assert quality.volume_anomalies(spark.createDataFrame([], "at timestamp_ntz"), "at", Config()).count() == 0


def test_metrics(seed):
    (r,) = semantic.query(seed, ["approval_rate", "card_chargeback_rate_amount", "risk_reject_rate"]).collect()
    assert (round(r.approval_rate, 4), round(r.card_chargeback_rate_amount, 4), r.risk_reject_rate) == (0.8, 0.1765, 0.2)
    with pytest.raises(ValueError, match="several models"):
        semantic.query(seed, ["approval_rate", "gross_fraud_loss"])


def test_latest_version_with_ties(spark):
    df = spark.createDataFrame([(1, "a", "2026-01-01"), (1, "b", "2026-01-01"), (2, "c", None)], "k int, v string, _ingested_at string")
    found = [{tuple(r) for r in latest_by(df.repartition(n), "k").collect()} for n in (1, 3)]
    assert found[0] == found[1] and len(found[0]) == 2


def test_graph_order():
    names = dag.order()
    for k in names:
        assert all(names.index(r) < names.index(k) for r in dag.MODELS[k].reads if r in dag.MODELS)
    assert dag.select("cohort_daily+") == ["cohort_daily", "cohort_maturity"]


def test_empty_feeds(spark):
    w = Warehouse(spark, {}, Config(as_of=date(2026, 1, 1)))
    for k in ("payment_attempts", "fct_chargebacks", "network_monitoring", "score_psi", "open_exposure", "velocity"):
        assert w(k).count() == 0
    assert intermediate.duplicate_suspects(w("stg_transactions"), w.config).count() == 0


def test_refresh_equals_a_build_of_all(spark, tmp_path):
    late = [*CB, LATE]
    old, new = Warehouse(spark, feeds(spark), Config(as_of=date(2026, 10, 3))), Warehouse(spark, feeds(spark, tx=[*TX, ("tx_2001", "usr_09", "2026-07-01 10:00:00", "10.00", "approved", "pix", "2026-07-01 10:00:05")], cb=late), Config(as_of=date(2026, 10, 3)))
    old.build(str(tmp_path), ["fct_payment_attempts", "cohort_daily"])
    assert sorted(map(str, new.refresh(str(tmp_path)))) == ["2026-03-01", "2026-07-01"]
    for table in ("fct_payment_attempts", "cohort_daily"):
        want = [c for c in new(table).columns if c != "_updated_at" and not c.startswith("_")]
        got = spark.read.parquet(f"{tmp_path}/marts/{table}").select(*want)
        assert sorted(map(str, got.collect())) == sorted(map(str, new(table).select(*want).collect()))
    card = spark.read.parquet(f"{tmp_path}/marts/cohort_daily").where("payment_method = 'credit_card'").first()
    assert (card.chargeback_amount, card.approved_amount) == (D("500.00"), D("850.00"))


def test_sources_and_command_lines(spark, tmp_path):
    from riskmart.__main__ import late_chargeback, main
    from riskmart.sources import files

    for name, df in feeds(spark).items():
        df.toPandas().to_csv(tmp_path / f"{name}.csv", index=False)
    read = files.folder(spark, str(tmp_path))
    assert read["raw_transactions"].count() == 5 and read["raw_refunds"].count() == 0
    got = {r.moment: r for r in late_chargeback(Warehouse(spark, read, Config()), "tx_1004", "350.00").collect()}
    assert (round(got["before"].rate, 4), round(got["after"].rate, 4)) == (0.1765, 0.5882)
    read["raw_transactions"].write.saveAsTable("raw_transactions_of_test", mode="overwrite")
    assert files.raw_table(spark, "raw_transactions", "raw_transactions_of_test").schema == read["raw_transactions"].schema
    spark.sql("DROP TABLE raw_transactions_of_test")
    main(["build", "--raw", str(tmp_path), "--to", str(tmp_path / "out"), "--select", "+cohort_daily fct_payment_attempts"])
    assert spark.read.parquet(str(tmp_path / "out/marts/cohort_daily")).count() == 2
    main(["refresh", "--raw", str(tmp_path), "--to", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/marts/cohort_daily")).count() == 2
    main(["velocity", "--raw", str(tmp_path), "--to", str(tmp_path / "velocity")])
    assert spark.read.parquet(str(tmp_path / "velocity")).count() > 0


def test_lookups_from_files(spark, tmp_path):
    (tmp_path / "ref_reason_codes.csv").write_text("network,reason_code,reason_description,reason_category\nvisa, 99.9 ,New,fraud\n")
    w = Warehouse(spark, feeds(spark, cb=[("c", "tx_1001", "2026-03-15 14:00:00", "99.9_new", "1.00", "2026-03-15 14:05:00"), ("d", "tx_1001", "2026-03-15 14:00:00", "10.4", "1.00", "2026-03-15 14:05:00")]), Config(), lookups.folder(spark, str(tmp_path)))
    assert {k: r.reason_category for k, r in by(w("stg_chargebacks"), "chargeback_id").items()} == {"c": "fraud", "d": "unmapped"}
    assert w("ref_response_codes").count() == len(lookups.RESPONSE_CODES)
    (tmp_path / "ref_reason_codes.csv").write_text("network,reason_code,reason_description,reason_category\nvisa,1,a,fraud\nelo,1,b,fraud\n")
    with pytest.raises(ValueError, match="twice"):
        lookups.folder(spark, str(tmp_path))


def test_violations_are_kept_for_audit(seed, tmp_path):
    tests = [t for t in quality.suite(seed) if t.name in ("approved_without_evaluation", "attempts_grain", "amount_positive")]
    assert sorted(quality.run(tests, str(tmp_path))) == [("amount_positive", 0, "pass"), ("approved_without_evaluation", 1, "warn"), ("attempts_grain", 0, "pass")]
    assert [p.name for p in tmp_path.iterdir()] == ["approved_without_evaluation"]
    assert [r.transaction_id for r in seed.spark.read.parquet(f"{tmp_path}/approved_without_evaluation").collect()] == ["tx_1005"]
