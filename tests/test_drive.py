"""A stream into the stored warehouse: two micro-batches equal a build, a batch that comes twice changes nothing."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from riskmart import schemas
from riskmart.config import Config
from riskmart.plans.dag import Warehouse
from riskmart.plans.stored import Stored
from riskmart.sources import files
from riskmart.streaming import drive, ingest
from tests.test_risk import CB, EV, LATE, TX
from tests.test_stored import rows_of

CONFIG = Config(as_of=date(2026, 10, 3))


def messages(feed, rows):
    """JSON lines as a broker would give them."""
    return [json.dumps({"topic": feed, "timestamp": r[-1], "value": json.dumps(dict(zip(schemas.RAW_FIELDS[feed], r[:-1], strict=True)))}) for r in rows]


FIRST = messages("raw_transactions", TX[:3]) + messages("raw_risk_evaluations", EV) + [json.dumps({"topic": "else", "timestamp": "2026-03-01 10:00:00", "value": "?"})]
SECOND = messages("raw_transactions", [*TX[3:], ("tx_bad", "u", "soon", "1", "approved", "pix", "2026-03-01 12:00:00")]) + messages("raw_chargebacks", [*CB, LATE]) + messages("raw_refunds", [("r1", "tx_1003", "2026-03-09 10:00:00", "5.00", "fraud_alert", "2026-03-09 10:00:00"), (None, "tx_1003", "2026-03-09 10:00:00", "5.00", "x", "2026-03-09 10:00:00")])


def tables(spark, path):
    stored = Stored(Warehouse(spark, files.by_day(spark, f"{path}/bronze"), CONFIG), path, 2)
    return {"attempts": rows_of(stored.read("fct_payment_attempts")), "cohorts": rows_of(stored.read("cohort_daily")), "approval": rows_of(stored.mart("approval_daily"))}


@pytest.fixture(scope="module")
def expected(spark):
    from riskmart.sources.files import raw_rows

    feeds = {"raw_transactions": TX, "raw_risk_evaluations": EV, "raw_chargebacks": [*CB, LATE], "raw_refunds": [("r1", "tx_1003", "2026-03-09 10:00:00", "5.00", "fraud_alert", "2026-03-09 10:00:00")]}
    w = Warehouse(spark, {k: raw_rows(spark, k, v) for k, v in feeds.items()}, CONFIG)
    return {"attempts": rows_of(w("payment_attempts")), "cohorts": rows_of(w("cohort_daily")), "approval": rows_of(w("approval_daily"))}


def test_two_batches_equal_a_build_and_a_new_checkpoint_changes_nothing(spark, tmp_path, expected):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(FIRST) + "\n")
    path = str(tmp_path / "to")
    drive.drive(drive.json_messages(spark, f"{tmp_path}/in", 1), path, f"{tmp_path}/mark", CONFIG, 2).awaitTermination()
    (tmp_path / "in/b.json").write_text("\n".join(SECOND) + "\n")
    drive.drive(drive.json_messages(spark, f"{tmp_path}/in", 1), path, f"{tmp_path}/mark", CONFIG, 2).awaitTermination()
    assert tables(spark, path) == expected
    bad = spark.read.json(f"{path}/quarantine/_unknown").count(), spark.read.parquet(f"{path}/quarantine/raw_transactions").count(), spark.read.parquet(f"{path}/quarantine/raw_refunds").count()
    assert bad[1:] == (1, 1) and len(list((tmp_path / "to/state/ledger").glob("[!.]*"))) == 2
    # All messages again, by a stream with another checkpoint: nothing is overwritten, and nothing changes.
    before = {f for f in (tmp_path / "to/bronze").rglob("*.parquet")}
    drive.drive(drive.json_messages(spark, f"{tmp_path}/in"), path, f"{tmp_path}/other", CONFIG, 2).awaitTermination()
    assert tables(spark, path) == expected and before < {f for f in (tmp_path / "to/bronze").rglob("*.parquet")}


def test_a_batch_that_comes_twice_or_breaks_off(spark, tmp_path, expected, monkeypatch):
    path = str(tmp_path / "to")

    def batch(lines):
        return spark.createDataFrame([(x["topic"], datetime.fromisoformat(x["timestamp"]), x["value"]) for x in map(json.loads, lines)], drive.MESSAGE)

    assert drive.apply(batch(FIRST), path, "s-0", CONFIG, 2)
    own = files.touch

    def breaks(spark, at):
        if "ledger" in at:
            raise RuntimeError("gone")
        own(spark, at)

    monkeypatch.setattr(files, "touch", breaks)
    with pytest.raises(RuntimeError, match="gone"):  # after the refresh, before the entry
        drive.apply(batch(SECOND), path, "s-1", CONFIG, 2)
    monkeypatch.undo()
    assert drive.apply(batch(SECOND), path, "s-1", CONFIG, 2)
    assert tables(spark, path) == expected
    stamps = {f: f.stat().st_mtime_ns for f in (tmp_path / "to").rglob("*.parquet")}
    assert not drive.apply(batch(SECOND), path, "s-1", CONFIG, 2)
    assert stamps == {f: f.stat().st_mtime_ns for f in (tmp_path / "to").rglob("*.parquet")}


def test_broker_rows_are_named_and_decoded(spark):
    value = json.dumps(dict(zip(schemas.RAW_FIELDS["raw_chargebacks"], CB[0][:-1], strict=True)))
    raw = spark.createDataFrame([("cb.v1", bytearray(value.encode()), datetime(2026, 3, 15, 14, 5)), ("cb.v1", bytearray(b"no json"), datetime(2026, 3, 15, 14, 5)), ("cb.v1", None, None)], "topic string, value binary, timestamp timestamp")
    kept, bad = drive.split(drive.named(raw, {"cb.v1": "raw_chargebacks"}), "raw_chargebacks")
    (r,) = kept.collect()
    assert (r.chargeback_id, r.cb_amount, str(r["_ingested_at"])) == ("cb_901", "150.00", "2026-03-15 14:05:00") and bad.count() == 2
    assert ingest.decoded(raw.where(F.col("value").isNotNull()), "raw_chargebacks").where("chargeback_id = 'cb_901'").count() == 1


def test_a_new_stream_overwrites_no_other(spark, tmp_path):
    source, out = tmp_path / "cb", str(tmp_path / "out")
    source.mkdir()
    header = "chargeback_id,transaction_id,chargeback_at,reason_code,cb_amount\n"
    for name, mark in (("a", "m1"), ("b", "m2")):
        for f in source.glob("*.csv"):
            f.unlink()
        (source / f"{name}.csv").write_text(f"{header}{name},t1,2026-03-01 10:00:00,10.4,5\n")
        ingest.ingest(ingest.csv_files(spark, "raw_chargebacks", str(source)), "raw_chargebacks", out, str(tmp_path / mark)).awaitTermination()
    assert sorted(r.chargeback_id for r in spark.read.parquet(f"{out}/raw_chargebacks").collect()) == ["a", "b"]


def test_without_contracts_every_row_with_a_key_is_an_attempt(spark, tmp_path):
    """The events of the query's feeds, one of them with an amount of zero, which the contract would quarantine."""
    from riskmart.plans import queries

    rows = "(1, timestamp'2024-01-01 00:10:00', 7, 'view', 0.001D), (2, timestamp'2024-01-01 01:10:00', 7, 'view', 5D), (3, timestamp'2024-01-01 02:10:00', 8, 'error', 0D)"
    spark.sql(f"SELECT *, '{{\"k\": 5}}' AS props FROM VALUES {rows} t(event_id, ts, user_id, event_type, value)").write.parquet(f"{tmp_path}/events.parquet")
    assert rows_of(queries.QUERIES["streaming_refresh"](spark, str(tmp_path))) == rows_of(queries.finished(queries.warehouse(spark, str(tmp_path), "events")("payment_attempts")))
    keyless = messages("raw_transactions", [(None, *TX[0][1:])])
    kept, bad = drive.split(spark.createDataFrame([(x["topic"], datetime.fromisoformat(x["timestamp"]), x["value"]) for x in map(json.loads, keyless)], drive.MESSAGE), "raw_transactions", ())
    assert (kept.count(), bad.count()) == (0, 1)
