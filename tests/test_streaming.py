from __future__ import annotations

import json

from riskmart.streaming import ingest

GOOD = {"transaction_id": "t", "user_id": "u", "transaction_at": "2026-03-01 10:00:00", "amount": "1.50", "status": "approved", "payment_method": "pix"}
BAD = [GOOD | x for x in ({"transaction_id": None}, {"transaction_at": "soon"}, {"amount": "0"}, {"amount": None}, {"status": "odd"}, {"payment_method": None})]


def test_stream_keeps_or_quarantines_every_message_once(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "a.txt").write_text("\n".join([*map(json.dumps, [GOOD, *BAD]), "no json"]) + "\n")
    ingest.ingest(ingest.json_lines(spark, "raw_transactions", str(source)), "raw_transactions", out, mark).awaitTermination()
    (source / "b.txt").write_text(json.dumps(GOOD | {"transaction_id": "t2"}) + "\n")
    ingest.ingest(ingest.json_lines(spark, "raw_transactions", str(source)), "raw_transactions", out, mark).awaitTermination()
    kept = spark.read.parquet(f"{out}/raw_transactions").collect()
    bad = spark.read.parquet(f"{out}/quarantine/raw_transactions").collect()
    assert sorted(r.transaction_id for r in kept) == ["t", "t2"] and len(bad) == len(BAD) + 1
    assert all(r["_broken"] for r in bad) and all(r["_ingested_at"] for r in kept)


def test_csv_stream_names_its_file(spark, tmp_path):
    source, out = tmp_path / "cb", str(tmp_path / "out")
    source.mkdir()
    (source / "f.csv").write_text("chargeback_id,transaction_id,chargeback_at,reason_code,cb_amount\nc1,t1,2026-03-01 10:00:00,10.4,5\nc2,t1,x,10.4,5\n")
    ingest.ingest(ingest.csv_files(spark, "raw_chargebacks", str(source)), "raw_chargebacks", out, str(tmp_path / "m")).awaitTermination()
    (kept,) = spark.read.parquet(f"{out}/raw_chargebacks").collect()
    assert kept.chargeback_id == "c1" and kept["_source_file"].endswith("f.csv")
    assert spark.read.parquet(f"{out}/quarantine/raw_chargebacks").count() == 1
