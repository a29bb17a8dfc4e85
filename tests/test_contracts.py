from __future__ import annotations

import json
from datetime import timedelta

import pytest

from riskmart import contracts, schemas
from riskmart.contracts import CONTRACTS
from riskmart.streaming import ingest


def test_files_give_the_rules_of_the_feeds(spark):
    assert {k: list(c.columns) for k, c in CONTRACTS.items()} == {k: schemas.RAW_FIELDS[k] for k in ("raw_transactions", "raw_risk_evaluations", "raw_chargebacks")}
    assert all(c.ddl == schemas.FEED[k] for k, c in CONTRACTS.items())
    assert {k: sorted(c.expectations()) for k, c in CONTRACTS.items()} == {
        "raw_transactions": ["amount_positive", "payment_method_present", "status_accepted", "transaction_at_valid", "transaction_id_present"],
        "raw_risk_evaluations": ["evaluated_at_valid", "evaluation_id_present", "risk_action_accepted", "transaction_id_present"],
        "raw_chargebacks": ["cb_amount_positive", "chargeback_at_valid", "chargeback_id_present", "transaction_id_present"],
    }
    assert CONTRACTS["raw_chargebacks"].shares() == {"fct_chargebacks": {"orphan_chargebacks": ("is_orphan", "true", 0.005)}}
    assert CONTRACTS["raw_transactions"].freshness() == (timedelta(minutes=30), timedelta(hours=2)) and CONTRACTS["raw_chargebacks"].freshness() == (timedelta(days=2), timedelta(days=4))
    assert CONTRACTS["raw_chargebacks"].service["latency"] == (1, "hour") and CONTRACTS["raw_risk_evaluations"].key == ("evaluation_id",)


def test_another_contract_from_a_file(spark, tmp_path):
    document = {"kind": "DataContract", "name": "feed", "schema": [{"properties": [{"name": "code", "logicalType": "string", "quality": [{"rule": "pattern", "pattern": "^[0-9]+$"}, {"rule": "present"}]}]}]}
    path = tmp_path / "feed.json"
    path.write_text(json.dumps(document))
    rules = contracts.read(path).expectations()
    rows = spark.createDataFrame([("1",), ("x",), (None,)], "code string").select("code", *[c.alias(k) for k, c in rules.items()])
    assert [tuple(r) for r in rows.collect()] == [("1", True, True), ("x", False, True), (None, None, False)]
    for broken in ({"kind": "else"}, document | {"quality": [{"rule": "odd"}]}, document | {"schema": [{"properties": [{"name": "a", "logicalType": "array"}]}]}):
        with pytest.raises(ValueError):
            contracts.compiled(broken)


def test_both_sinks_still_come_from_one_contract(spark):
    df = spark.createDataFrame([("c", "t", "2026-03-01 10:00:00", "10.4", "5"), ("c", "t", "soon", "10.4", "0"), (None,) * 5], schemas.FEED["raw_chargebacks"])
    kept, bad = ingest.split(df, "raw_chargebacks")
    assert kept.count() == 1 and sorted(len(r["_broken"]) for r in bad.collect()) == [2, 4]
