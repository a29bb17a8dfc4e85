"""The stored warehouse: a refresh equals a build of all, whenever it breaks off, and reads only what changed."""

from __future__ import annotations

import random
import shutil
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest

from riskmart.config import Config
from riskmart.plans.dag import Warehouse
from riskmart.plans.stored import FACTS, SUMS, Stored
from riskmart.sources import files
from riskmart.sources.files import raw_rows

CONFIG = Config(as_of=date(2026, 3, 20))
START = datetime(2026, 1, 5)
MARTS = ["approval_daily", "cohort_daily", "rule_performance", "network_monitoring", "merchant_loss", "rule_backtest"]


def at(t):
    return None if t is None else str(t)


def feeds_of(seed=1, n=70):
    """Rows of all feeds over ten weeks, first those that had come by day 50, then those that came later: corrections that move sales, users, merchants and chargebacks, and late evidence."""
    rng = random.Random(seed)
    first, later, late_day = {}, {}, START + timedelta(days=60)

    def put(feed, row, came, late):
        came = max(came, late_day) if late else came
        (later if late else first).setdefault(feed, []).append((*row, at(came)))

    for i in range(n):
        t = START + timedelta(days=rng.randrange(40), seconds=rng.randrange(0, 86400, 20))
        if i % 5 == 1:  # within a minute of the one before, sometimes over midnight
            t = prev + timedelta(seconds=rng.choice([10, 59, 60, 61]))
        if i % 11 == 2:
            t = t.replace(hour=23, minute=59, second=50)
        prev = t
        k, user, amount, method = f"t{i}", f"u{i % 7}" if i % 5 != 1 else f"u{(i - 1) % 7}", rng.choice(["10.00", "20.00"]), rng.choice(["credit_card", "credit_card", "pix"])
        status = rng.choice(["approved", "approved", "declined", "error"])
        late = i % 9 == 4
        came = late_day if late else t + timedelta(seconds=5)
        put("raw_transactions", (k, user, at(t) if i % 23 != 7 else "soon", amount, status, method), came, late)
        for e in range(rng.randrange(0, 3)):
            put("raw_risk_evaluations", (f"e{i}_{e}", k, at(t - timedelta(seconds=3 - 2 * e)), str(rng.randrange(100)), rng.choice(["approve", "reject", "review"]), rng.choice(["", "rule_a", "rule_manual_review_b"])), came, late or (i % 13 == 5 and e))
            put("raw_risk_rule_hits", (f"e{i}_{e}", rng.choice(["r1", "r2"]), str(rng.randrange(1, 3)), rng.choice(["true", "false"]), rng.choice(["reject", "review"])), came, late or i % 10 == 3)
        merchant = ["m1", "m2", "m3"][i % 3]
        put("raw_payment_enrichment", (k, merchant, f"o{i // 2}", "br", rng.choice(["visa", "mastercard", ""]), None, None, rng.choice(["authenticated", ""]), rng.choice(["51", "14"]), rng.choice(["captured", "no"]), at(t + timedelta(days=rng.randrange(3))), "30", "brl"), came, late)
        if i % 6 == 0:
            put("raw_chargebacks", (f"c{i}", k if i % 12 else rng.choice([None, "gone"]), at(t + timedelta(days=rng.randrange(5, 70))), rng.choice(["10.4", "13.1"]), "10.00"), late_day if i % 18 == 0 else t + timedelta(days=5), i % 18 == 0)
            put("raw_chargeback_outcomes", (f"c{i}", "second", rng.choice(["won", "lost"]), at(t), "3.00", "1.00"), late_day, i % 4 == 0)
        if i % 7 == 0:
            put("raw_issuer_fraud_reports", (f"r{i}", k, "visa", at(t + timedelta(days=9)), "x"), late_day if i % 14 else t, bool(i % 14))
        if i % 8 == 0:
            put("raw_refunds", (f"f{i}", k, at(t), "2.00", rng.choice(["fraud_alert", "goodwill"])), late_day if i % 16 else t, bool(i % 16))
            put("raw_dispute_alerts", (f"a{i}", k, "p", at(t), "confirmed_fraud", "x"), late_day if i % 16 else t, bool(i % 16))
            put("raw_pix_med_claims", (f"p{i}", k, at(t + timedelta(days=3)), "5.00", "ok", "1.00"), late_day if i % 16 else t, bool(i % 16))
    for m in ("m1", "m2"):
        put("raw_merchants", (m, "5000", "retail", at(START)), START, False)
    # Corrections: another day, another user, another merchant, a chargeback that goes to another sale or gets none.
    moved = late_day + timedelta(hours=1)
    rows = {r[0]: r for r in first["raw_transactions"]}
    put("raw_transactions", (*rows["t0"][:2], at(START + timedelta(days=33)), *rows["t0"][3:6]), moved, True)
    put("raw_transactions", (rows["t2"][0], "u5", *rows["t2"][2:6]), moved, True)
    put("raw_transactions", (*rows["t3"][:2], "never", *rows["t3"][3:6]), moved, True)
    e = next(r for r in first["raw_payment_enrichment"] if r[0] == "t6")
    put("raw_payment_enrichment", ("t6", "m9", *e[2:-1]), moved, True)
    put("raw_chargebacks", ("c6", "t1", at(START + timedelta(days=44)), "10.4", "7.00"), moved, True)
    put("raw_chargebacks", ("c30", None, at(START + timedelta(days=44)), "10.4", "7.00"), moved, True)
    put("raw_chargebacks", ("c12", "t10", at(START + timedelta(days=20)), "10.4", "7.00"), moved, True)
    put("raw_merchants", ("m1", "6000", "travel", at(START)), moved, True)
    return first, {k: first.get(k, []) + later.get(k, []) for k in first.keys() | later.keys()}


def rows_of(df):
    columns = sorted(c for c in df.columns if not c.startswith("_"))
    return sorted(map(str, df.select(*columns).collect()))


def made(full):
    return {name: rows_of(full(name)) for name in ["payment_attempts", "fct_chargebacks", *MARTS]}


def assert_equal(stored, expected):
    assert rows_of(stored.read("fct_payment_attempts")) == expected["payment_attempts"]
    assert rows_of(stored.read("fct_chargebacks").drop("month")) == expected["fct_chargebacks"]
    for name in MARTS:
        assert rows_of(stored.mart(name)) == expected[name], name


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """A warehouse of what came first, and the feeds of all, both by day of arrival."""
    path = tmp_path_factory.mktemp("stored")
    early, every = feeds_of()
    for folder, feeds in (("early", early), ("every", every)):
        for name, rows in feeds.items():
            files.write_by_day(raw_rows(spark, name, rows), f"{path}/{folder}", name)
    Stored(Warehouse(spark, files.by_day(spark, f"{path}/early"), CONFIG), f"{path}/built", 4).build()
    return path


@pytest.fixture(scope="module")
def expected(spark, built):
    """What a build of all feeds gives."""
    return made(Warehouse(spark, files.by_day(spark, f"{built}/every"), CONFIG))


@pytest.fixture
def stored(spark, built, tmp_path):
    """The stored warehouse with all feeds, to be refreshed."""
    shutil.copytree(built / "built", tmp_path / "w")
    return Stored(Warehouse(spark, files.by_day(spark, f"{built}/every"), CONFIG), f"{tmp_path}/w", 4)


def test_build_equals_the_models(spark, built):
    early = Warehouse(spark, files.by_day(spark, f"{built}/early"), CONFIG)
    assert_equal(Stored(early, f"{built}/built", 4), made(early))


def test_refresh_equals_a_build(stored, expected):
    days = stored.refresh()
    assert 10 < len(days) < 41 and None in days
    assert_equal(stored, expected)
    stored.refresh()  # the look-back alone: nothing changes
    assert_equal(stored, expected)


class Broken(Exception):
    pass


@pytest.mark.parametrize("step, nth", [("_put", 1), ("_put", 9), ("_put_marks", 1), ("_planned", 3)])
def test_a_run_that_breaks_off_loses_nothing(stored, expected, monkeypatch, step, nth):
    calls, own = [0], getattr(Stored, step)

    def breaks(self, *args, **more):
        calls[0] += 1
        if calls[0] == nth:
            if step == "_put":  # in the midst: the first touched partition is gone, and not written yet
                units = self.spark.read.parquet(f"{self.run}/units").where("unit is not null").where(f"name = '{args[0]}'").orderBy("unit").first()
                shutil.rmtree(f"{self._at(args[0])}/{(FACTS | SUMS)[args[0]][2]}={units.unit}", ignore_errors=True)
            raise Broken
        return own(self, *args, **more)

    monkeypatch.setattr(Stored, step, breaks)
    with pytest.raises(Broken):
        stored.refresh()
    monkeypatch.undo()
    stored.refresh()
    assert_equal(stored, expected)
    assert not Path(stored.run).exists()


def test_a_build_that_broke_off_is_not_refreshed(stored, monkeypatch):
    monkeypatch.setattr(Stored, "_add_units", lambda *a: (_ for _ in ()).throw(Broken()))
    with pytest.raises(Broken):
        stored.build()
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="broke off"):
        stored.refresh()


def test_only_touched_partitions_are_read(spark, built, tmp_path):
    """One late chargeback: all files of other days of arrival, other days of sales and other buckets are unreadable."""
    shutil.copytree(built / "built", tmp_path / "w")
    shutil.copytree(built / "early", tmp_path / "feeds")
    early, _ = feeds_of()
    sale = next(r for r in early["raw_transactions"] if r[0] == "t41")
    came = START + timedelta(days=80)
    late = ("late", "t41", at(came), "10.4", "4.00", at(came))
    files.write_by_day(raw_rows(spark, "raw_chargebacks", [late]), f"{tmp_path}/feeds", "raw_chargebacks")
    stored = Stored(Warehouse(spark, files.by_day(spark, f"{tmp_path}/feeds"), CONFIG), f"{tmp_path}/w", 4)
    # Marks of a quiet day: nothing but the late row is newer.
    marks = {k: came - timedelta(days=1) for k in stored._marks()}
    stored._write_marks(marks)
    stored._put_marks()
    files.delete(spark, stored.run)
    day = datetime.fromisoformat(sale[2]).date()
    needed = {f"_day={day}", f"_day={came.date()}", f"cohort_date={day}"}
    hidden = []
    for f in [*Path(tmp_path / "feeds").rglob("*.parquet"), *Path(tmp_path / "w/marts/fct_payment_attempts").rglob("*.parquet"), *Path(tmp_path / "w/incremental/rule_hits").rglob("*.parquet")]:
        if f.parent.name not in needed and "raw_merchants" not in str(f):
            hidden.append((f, f.read_bytes()))
            f.write_bytes(b"not to be read")
    assert len(hidden) > 100
    names = {f: f.stat().st_mtime_ns for f, _ in hidden}
    assert stored.refresh() == [day]
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in names.items())  # nor written
    for f, data in hidden:
        f.write_bytes(data)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert_equal(stored, made(Warehouse(spark, files.by_day(spark, f"{tmp_path}/feeds"), CONFIG)))
