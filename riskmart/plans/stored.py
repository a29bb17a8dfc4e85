"""A stored warehouse that is kept up to date by what has changed.

Layout below a path: marts/ (the attempts fact and the cohorts, by cohort date), incremental/ (other facts and the additive sums of marts, by their units), state/ (what to look up)
and _run/ (a refresh that isn't done). A unit is one partition: a day of sales, or a month of notification. What a refresh does:

1. Rows that came since a feed's stored mark (less the look-back) name their transactions; so do rows that name a changed chargeback or evaluation, and a key's former transactions.
2. state/links (feed, id, transaction, day of arrival; kept twice, in hash buckets of the id and of the transaction) tells on which days the rows of those transactions came, and
   state/units in which partitions their facts are. So only those days of the feeds and those partitions of the facts are read. A feed with a column _day (see files.by_day) is
   pruned to partitions, any other one is filtered by its stamp.
3. Neighbours in time of a changed payment, and the payments that can be its duplicates, come from the fact's partitions around it.
4. Facts of all re-opened transactions are made anew from feeds that are cut before they are staged. Units that they are or were in are replaced, the others aren't touched.
5. Marts follow by their group keys: days of sales from the touched days; merchant, network and month (the month after follows at reading) from kept sums by day and from the touched months.

Everything is first written to _run/, then `ready` is put there, then tables are replaced from it, marks last. A run that breaks off before `ready` has changed nothing and is
thrown away; after it, the next run finishes it first, from what it wrote, so no cohort is lost. Replacing a table twice gives the same. What is looked up is only ever added to:
a stale entry costs a partition that is replaced by the same rows. `build` makes all of it from the whole feeds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart import schemas
from riskmart.operators import aggregates, facts, incremental, intermediate
from riskmart.plans import semantic
from riskmart.plans.dag import WATERMARK_SOURCES, Warehouse
from riskmart.sources import files

#: Of each feed its own key; feeds without a transaction go by the feed that has the key too.
FEEDS = {
    "raw_transactions": "transaction_id", "raw_risk_evaluations": "evaluation_id", "raw_chargebacks": "chargeback_id", "raw_payment_enrichment": "transaction_id", "raw_issuer_fraud_reports": "report_id",
    "raw_refunds": "refund_id", "raw_dispute_alerts": "alert_id", "raw_pix_med_claims": "claim_id", "raw_chargeback_outcomes": "chargeback_id", "raw_risk_rule_hits": "evaluation_id",
}
THROUGH = {"raw_chargeback_outcomes": "raw_chargebacks", "raw_risk_rule_hits": "raw_risk_evaluations"}
#: The mark in the fact that a feed goes by where none is stored.
_MARK_OF = {"raw_transactions": "_tx_watermark", "raw_risk_evaluations": "_eval_watermark", "raw_chargebacks": "_cb_watermark", "raw_payment_enrichment": "_enrichment_watermark", "raw_refunds": "_refund_watermark"}
#: Facts: folder, key, column of the unit.
FACTS = {"fct_payment_attempts": ("marts", "transaction_id", "cohort_date"), "fct_chargebacks": ("incremental", "chargeback_id", "month"), "reported_frauds": ("incremental", "report_id", "month"), "merchant_claims": ("incremental", "claim_id", "month"), "rule_hits": ("incremental", "transaction_id", "cohort_date")}
#: Sums: folder, column of the keys that are replaced, column of the unit.
SUMS = {
    "cohort_daily": ("marts", "cohort_date", "cohort_date"), "approval_daily": ("incremental", "transaction_date", "month"), "rule_performance": ("incremental", "transaction_date", "month"), "settled_daily": ("incremental", "cohort_date", "month"),
    "fraud_daily": ("incremental", "cohort_date", "month"), "rule_daily": ("incremental", "cohort_date", "month"), "orders_daily": ("incremental", "cohort_date", "month"), "network_sums": ("incremental", "month_start", "month"), "loss_sums": ("incremental", "month_start", "month"),
}
BUCKETS = 64
_LINK = "feed string, id string, transaction_id string, day date"


#: Tables that are written at the same time.
AT_ONCE = 4


def at_once(f: Callable, names: Iterable[str]) -> dict:
    """f of each name, several at a time: their Spark jobs share the cluster."""
    names = list(names)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(names, pool.map(f, names), strict=True))


@contextmanager
def many_tasks(spark: SparkSession) -> Iterator[None]:
    """Within it, few rows of many partitions are written by several tasks: by default they would meet in one, which writes a file after the other."""
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    was = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "month")


def among(c: str | Column, values: list) -> Column:
    """Whether c is one of the values, null for null."""
    c = F.col(c) if isinstance(c, str) else c
    is_one = F.coalesce(c.isin([v for v in values if v is not None]), F.lit(False))
    return is_one | c.isNull() if None in values else is_one


def _through() -> Column:
    """The feed whose rows have an id and its transaction."""
    return F.coalesce(*[F.when(F.col("feed") == a, b) for a, b in THROUGH.items()], "feed")


class Stored:
    def __init__(self, warehouse: Warehouse, path: str, buckets: int = BUCKETS):
        self.w, self.spark, self.path, self.buckets = warehouse, warehouse.spark, path, buckets
        self.run, self._schemas = f"{path}/_run", {}

    # Tables

    def _at(self, name: str) -> str:
        return f"{self.path}/{(FACTS | SUMS)[name][0]}/{name}"

    def has(self, name: str) -> bool:
        return files.exists(self.spark, self._at(name))

    def read(self, name: str) -> DataFrame:
        """A stored table; `month` is the unit of those that have no such column themselves."""
        return self.spark.read.schema(self._schema(name)).parquet(self._at(name))

    def _units(self, name: str, units: list) -> DataFrame:
        """A table's partitions of these units: no other folder is even listed."""
        unit = (FACTS | SUMS)[name][2]
        paths = [x for u in units if files.exists(self.spark, x := f"{self._at(name)}/{unit}={u if u is not None else '__HIVE_DEFAULT_PARTITION__'}")]
        if not paths:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).option("basePath", self._at(name)).parquet(*paths)

    def _schema(self, name: str):
        if name not in self._schemas:
            self._schemas[name] = self._full(name).schema
        return self._schemas[name]

    @property
    def feeds(self) -> list[str]:
        """Feeds that a stored table depends on."""
        unused = {"raw_chargeback_outcomes": "fct_chargebacks", "raw_risk_rule_hits": "rule_hits"}
        return [f for f in FEEDS if f not in unused or self.has(unused[f])]

    def mart(self, name: str) -> DataFrame:
        """A mart as a build of all would give it, from the stored sums."""
        if name == "network_monitoring":
            return aggregates.network_status(self.read("network_sums"), self.w.config)
        if name == "merchant_loss":
            return aggregates.losses_with_merchants(self.read("loss_sums"), self.w("stg_merchants"))
        if name == "rule_backtest":
            return aggregates.rule_shares_of_days(self.read("rule_daily").drop("month"), self.read("fraud_daily"))
        return self.read(name).select(*self.w(name).columns)

    def _full(self, name: str, w: Warehouse | None = None) -> DataFrame:
        """A table made from a warehouse of feeds."""
        w = w or self.w
        if name == "fct_payment_attempts":
            return w(name)
        if name == "fct_chargebacks":
            return w(name).withColumn("month", _month("chargeback_at"))
        if name == "reported_frauds":
            return aggregates.reported_frauds(w("payment_attempts"), w("stg_issuer_reports")).withColumn("month", _month("reported_at"))
        if name == "merchant_claims":
            return aggregates.claims_of_merchants(w("stg_med_claims"), w("stg_enrichment")).withColumn("month", _month("claimed_at"))
        if name == "rule_hits":
            return aggregates.rule_hits_on_attempts(w("stg_rule_hits"), w("stg_evaluations"), w("payment_attempts"))
        return self._sums(name, {k: self._full(k, w) for k in _READS[name]})

    def _sums(self, name: str, of: dict[str, DataFrame]) -> DataFrame:
        """A table of sums from the tables that it reads."""
        if name in ("network_sums", "loss_sums"):
            if name == "loss_sums":
                summed = aggregates.loss_sums(of["fct_chargebacks"].drop("month"), of["merchant_claims"].drop("month"))
            else:
                counts = of["settled_daily"].drop("cohort_date", "month")
                summed = aggregates.network_sums(counts.unionByName(aggregates.reported(of["reported_frauds"])).unionByName(aggregates.disputed(of["fct_chargebacks"])))
            return summed.withColumn("month", F.col("month_start"))
        if name == "rule_daily":
            return aggregates.rule_sums(of["rule_hits"], "cohort_date").withColumn("month", _month("cohort_date"))
        attempts = of["fct_payment_attempts"]
        if name == "cohort_daily":
            return aggregates.cohort_daily(attempts)
        if name == "settled_daily":
            return aggregates.network_sums(aggregates.settled(attempts, "cohort_date"), "cohort_date").withColumn("month", _month("cohort_date"))
        if name == "fraud_daily":
            return attempts.groupBy("cohort_date").agg(F.count_if("is_fraud_labeled").alias("fraud_count")).withColumn("month", _month("cohort_date"))
        if name == "orders_daily":
            return semantic.sketches(attempts, "orders", ["cohort_date", "payment_method"]).withColumn("month", _month("cohort_date"))
        made = aggregates.approval_daily(attempts) if name == "approval_daily" else aggregates.rule_performance(attempts, self.w.config)
        return made.withColumn("month", _month("transaction_date"))

    # State

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _link(self, feed: str, df: DataFrame) -> list[Column]:
        transaction = F.trim("transaction_id") if "transaction_id" in df.columns else F.lit(None).cast("string")
        return [F.lit(feed).alias("feed"), F.trim(FEEDS[feed]).alias("id"), transaction.alias("transaction_id"), self._day(df).alias("day")]

    def _day(self, df: DataFrame) -> Column:
        return F.col("_day") if "_day" in df.columns else F.col("_ingested_at").cast("date")

    def _add_links(self, links: DataFrame) -> None:
        for name, key in (("by_id", "id"), ("by_transaction", "transaction_id")):
            rows = links.where(F.col(key).isNotNull()).withColumn("bucket", self._bucket(key))
            files.write_table(rows, f"{self.path}/state/{name}", "bucket", mode="append")

    def _add_units(self, name: str, rows: DataFrame) -> None:
        _, key, unit = FACTS[name]
        of = rows.select(F.coalesce("transaction_id", F.concat(F.lit("\x00"), F.col(key))).alias("key"), F.col(unit).alias("unit")).where("key is not null").distinct().withColumn("bucket", self._bucket("key"))
        files.write_table(of, f"{self.path}/state/units/{name}", "bucket", mode="append")

    def _found(self, at: str, schema: str, key: str, keys: DataFrame) -> DataFrame:
        """Rows of a state table for the keys (with their buckets): only those buckets are read."""
        if not files.exists(self.spark, f"{self.path}/state/{at}"):
            return self.spark.createDataFrame([], schema)
        keys = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
        buckets = [r[0] for r in keys.select(self._bucket(key)).distinct().collect()]  # as many as buckets
        stored = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/state/{at}").where(F.col("bucket").isin(buckets))
        return stored.join(keys, key, "left_semi").select(*[c.split()[0] for c in schema.split(", ")]).distinct()

    def _marks(self) -> dict[str, object]:
        """The stored marks; where there are none, those of the fact."""
        if files.exists(self.spark, f"{self.path}/state/marks"):
            return {r.name: r.mark for r in self.spark.read.schema("name string, mark timestamp_ntz").parquet(f"{self.path}/state/marks").collect()}  # one for each feed
        columns = schemas.WATERMARKS
        of = self.read("fct_payment_attempts").agg(*[F.max(m).alias(m) for m in columns]).first().asDict()
        return of | {feed: of[_MARK_OF.get(feed, "_label_watermark")] for feed in FEEDS if feed not in THROUGH}

    def _write_marks(self, marks: dict[str, object]) -> None:
        rows = self.spark.createDataFrame(sorted((k, v) for k, v in marks.items() if v is not None), "name string, mark timestamp_ntz")
        files.write_table(rows.coalesce(1), f"{self.run}/marks")

    # Runs

    def build(self) -> None:
        """All tables and the state from the whole feeds, in place of what is there.

        Facts are first made as plain files in _run/: tables of many small partitions are written from those, and no sum reads the partitions.
        """
        for folder in ("_run", "state"):
            files.delete(self.spark, f"{self.path}/{folder}")
        files.touch(self.spark, f"{self.path}/_building")
        for name in FACTS | SUMS:
            self._schema(name)
        marks = self._look_through()
        made: dict[str, DataFrame] = {}

        def make(name: str) -> None:
            made[name] = self._written(self._full(name), f"made/{name}")

        def table(name: str) -> None:
            files.delete(self.spark, self._at(name))
            rows = made[name] if name in FACTS else self._sums(name, {k: made[k] for k in _READS[name]})
            files.write_table(rows, self._at(name), (FACTS | SUMS)[name][2], mode="append")
            if name in FACTS:
                self._add_units(name, rows)
            elif any(name in r for r in _READS.values()):
                made[name] = self.read(name)

        attempts, own = "fct_payment_attempts", self.w("payment_attempts")
        make(attempts)
        self.w.made["payment_attempts"] = made[attempts].drop(*schemas.WATERMARKS)
        at_once(make, [name for name in FACTS if name != attempts])
        with many_tasks(self.spark):
            last = [name for name in SUMS if any(r in SUMS for r in _READS[name])]
            at_once(table, [name for name in FACTS | SUMS if name not in last])
            at_once(table, last)
        marks |= made[attempts].agg(*[F.max(m).alias(m) for m in schemas.WATERMARKS]).first().asDict()
        self.w.made["payment_attempts"] = own  # the files in _run/ go
        self._write_marks(marks)
        self._put_marks()
        files.delete(self.spark, self.run)
        files.delete(self.spark, f"{self.path}/_building")

    def _look_through(self) -> dict[str, object]:
        """The links of all feeds, each read once; returns their marks. A link that is there twice costs its place alone."""
        out = None
        for feed in FEEDS:
            df = self._feed(feed)
            part = df.select(*self._link(feed, df), F.col("_ingested_at").alias("stamp"))
            out = part if out is None else out.unionByName(part)
        links = self._written(out, "links")
        self._add_links(links.drop("stamp"))
        return {r.feed: r.stamp for r in links.groupBy("feed").agg(F.max("stamp").alias("stamp")).collect()}  # one for each feed

    def _feed(self, feed: str) -> DataFrame:
        return self.w(feed)

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        files.write_table(df, f"{self.run}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.run}/{name}")

    def refresh(self, arrived: dict[str, DataFrame] | None = None) -> list[date | None]:
        """Bring all stored tables up to the feeds; returns the days of sales that were replaced. What is new is told by stamps, or is arrived: rows by feed, which the feeds have too."""
        if files.exists(self.spark, f"{self.path}/_building"):
            raise RuntimeError(f"the build of {self.path} broke off: build it again")
        self.finish()
        marks = self._marks()
        if not files.exists(self.spark, f"{self.path}/state/by_id"):  # made by a plain build: no feed was looked through yet
            for feed in self.feeds:
                df = self._feed(feed)
                self._add_links(df.select(*self._link(feed, df)).distinct())
            for name in filter(self.has, FACTS):
                self._add_units(name, self.read(name))
        with many_tasks(self.spark):
            return self._refresh(marks, arrived)

    def _refresh(self, marks: dict[str, object], arrived: dict[str, DataFrame] | None) -> list[date | None]:
        changed = self._changed(marks, arrived)
        stamps = {r.feed: max(filter(None, (r.stamp, marks.get(r.feed))), default=None) for r in changed.groupBy("feed").agg(F.max("stamp").alias("stamp")).collect()}  # one for each feed
        if not stamps:
            files.delete(self.spark, self.run)
            return []
        keys, cut, suspects = self._reopened(changed)
        refs = {k: v for k, v in self.w.made.items() if k.startswith("ref_")}
        some = Warehouse(self.spark, cut, self.w.config, refs)
        # A chargeback that went from a changed transaction to another one belongs to that one.
        of = some("stg_chargebacks")
        some.made |= {"stg_chargebacks": of.where("transaction_id is null").unionByName(incremental.only(of, keys)), "duplicate_suspects": suspects}
        latest = facts.watermarks({mark: some(m) for mark, m in WATERMARK_SOURCES.items()})
        latest = latest.select(*[F.greatest(m, F.lit(marks.get(m)).cast("timestamp_ntz")).alias(m) for m in schemas.WATERMARKS])
        some.made["fct_payment_attempts"] = facts.with_watermarks(some("payment_attempts"), latest)
        touched, now = {}, {}

        def done(found: dict) -> None:
            touched.update({k: v[0] for k, v in found.items()})
            now.update({k: v[1] for k, v in found.items()})

        def fact(name: str) -> tuple[list, DataFrame]:
            return self._fact(name, self._written(self._full(name, some), f"new/{name}"), keys)

        attempts = "fct_payment_attempts"
        done({attempts: fact(attempts)})
        some.made["payment_attempts"] = self.spark.read.schema(self._schema(attempts)).parquet(f"{self.run}/new/{attempts}").drop(*schemas.WATERMARKS)
        done(at_once(fact, [name for name in FACTS if name != attempts and self.has(name)]))
        # Sums of sums come after those that they read.
        for last in (False, True):
            done(at_once(lambda name: self._sum(name, touched, now), [name for name in SUMS if self.has(name) and any(r in SUMS for r in _READS[name]) == last]))
        files.write_table(self.spark.createDataFrame([(name, u) for name, units in touched.items() for u in units], "name string, unit date").coalesce(1), f"{self.run}/units")
        first = self._written(latest, "latest").first().asDict()
        self._write_marks(marks | stamps | first)
        files.touch(self.spark, f"{self.run}/ready")
        self.finish()
        return touched["fct_payment_attempts"]

    def _changed(self, marks: dict[str, object], arrived: dict[str, DataFrame] | None) -> DataFrame:
        """Links of all rows that came since, with their stamp."""
        out = None
        for feed in self.feeds if arrived is None else arrived:
            df = self._feed(feed) if arrived is None else arrived[feed]
            if arrived is None:
                if mark := marks.get(feed):
                    df = df.where(self._day(df) >= F.lit((mark - timedelta(hours=self.w.config.lookback_hours)).date()))
                df = incremental.since(df, marks.get(feed), self.w.config)
            part = df.select(*self._link(feed, df), F.col("_ingested_at").alias("stamp"))
            out = part if out is None else out.unionByName(part)
        return self._written(out, "changed")

    def _reopened(self, changed: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
        """Transactions to make anew, their rows of each feed, and which of them are suspected duplicates."""
        ids = changed.select("id", _through().alias("feed")).distinct()
        former = self._found("by_id", _LINK, "id", ids).unionByName(changed.select(*[c.split()[0] for c in _LINK.split(", ")])).join(ids, ["id", "feed"], "left_semi")
        first = self._written(former.select("transaction_id").where("transaction_id is not null").distinct(), "first_keys")
        cut = self._rows_of(first, changed, ["raw_transactions"])
        now = Warehouse(self.spark, cut, self.w.config)("stg_transactions").select("transaction_id", "user_id", "transaction_at", "amount", "payment_method")
        was = self._stored_payments(first)
        moved = self._written(now.unionByName(was).distinct(), "moved")  # changed payments as they are and as they were
        reach = 2 * self.w.config.duplicate_seconds  # a neighbour's duplicates are so far off
        around = moved.where("transaction_at is not null").select(F.explode(F.array_distinct(F.array(*[(F.col("transaction_at") + F.expr(f"INTERVAL '{s}' SECOND")).cast("date") for s in (-reach, 0, reach)]))).alias("day"))
        days = [r.day for r in around.distinct().collect()]  # days at most
        stored = self._units("fct_payment_attempts", days).select(*moved.columns)
        context = stored.join(moved.select("user_id").distinct(), "user_id", "left_semi").join(first, "transaction_id", "left_anti").select(*moved.columns)
        context = self._written(context, "context")
        near = incremental.neighbours(context.unionByName(moved), first, self.w.config)
        keys = self._written(first.unionByName(near).distinct(), "keys")
        cut = self._rows_of(keys, changed, self.feeds)
        suspects = intermediate.duplicate_suspects(context.unionByName(now), self.w.config)
        return keys, cut | {"raw_merchants": self.w("raw_merchants")}, incremental.only(suspects, keys)

    def _stored_payments(self, keys: DataFrame) -> DataFrame:
        units = [r.unit for r in self._found("units/fct_payment_attempts", "key string, unit date", "key", keys).select("unit").distinct().collect()]  # days at most
        return incremental.only(self._units("fct_payment_attempts", units), keys).select("transaction_id", "user_id", "transaction_at", "amount", "payment_method")

    def _rows_of(self, keys: DataFrame, changed: DataFrame, feeds: list[str]) -> dict[str, DataFrame]:
        """All rows of the feeds with an id that has ever been of one of the transactions, from the days on which they came."""
        columns = [c.split()[0] for c in _LINK.split(", ")]
        linked = self._found("by_transaction", _LINK, "transaction_id", keys).unionByName(incremental.only(changed, keys).select(*columns))
        linked = linked.select("feed", "id").unionByName(changed.where("transaction_id is null").select(_through().alias("feed"), "id")).distinct()
        for feed, over in THROUGH.items():
            linked = linked.unionByName(linked.where(F.col("feed") == over).select(F.lit(feed).alias("feed"), "id"))
        linked = self._written(linked.where(F.col("feed").isin(feeds)).distinct(), f"ids_{len(feeds)}")
        came = self._found("by_id", _LINK, "id", linked.select("id")).unionByName(changed.select(*columns)).join(linked, ["feed", "id"], "left_semi")
        days = {r.feed: r.days for r in came.groupBy("feed").agg(F.collect_set("day").alias("days")).collect()}  # days at most
        out = {}
        for feed in feeds:
            df = self._feed(feed)
            ids = linked.where(F.col("feed") == feed).select(F.col("id").alias("_id"))
            out[feed] = df.where(among(self._day(df), days.get(feed, []))).join(ids, F.trim(FEEDS[feed]) == F.col("_id"), "left_semi")
        return out

    def _fact(self, name: str, new: DataFrame, keys: DataFrame) -> tuple[list, DataFrame]:
        """Units of a fact that the keys' rows are or were in, and all rows that these units have now."""
        _, key, unit = FACTS[name]
        by = keys.select(F.col("transaction_id").alias("key")).unionByName(new.select(F.concat(F.lit("\x00"), F.col(key)).alias("key")))
        units = self._found(f"units/{name}", "key string, unit date", "key", by).select("unit").unionByName(new.select(F.col(unit).alias("unit"))).distinct()
        units = [r.unit for r in units.collect()]  # days or months
        old = self._units(name, units).join(keys, "transaction_id", "left_anti")
        if key != "transaction_id":
            old = old.join(new.select(key), key, "left_anti")
        return units, self._planned(name, old.select(*new.columns).unionByName(new))

    def _sum(self, name: str, touched: dict[str, list], now: dict[str, DataFrame]) -> tuple[list, DataFrame]:
        """The same for sums: keys are days or months that what they read was touched in."""
        _, key, unit = SUMS[name]
        if name in ("network_sums", "loss_sums"):
            keys = sorted({m for r in _READS[name] for m in (touched[r] if r != "settled_daily" else self._settled_months(touched, now))}, key=str)
            of = {r: self._view(r, touched, now).where(among("month_start" if r == "settled_daily" else "month", keys)) for r in _READS[name]}
            return keys, self._planned(name, self._sums(name, of))
        read = _READS[name][0]
        keys = touched[read]
        new = self._sums(name, {read: now[read]})
        if unit == key:
            return keys, self._planned(name, new)
        months = sorted({k and k.replace(day=1) for k in keys}, key=str)
        kept = self._units(name, months).where(~among(key, keys))
        return months, self._planned(name, kept.select(*new.columns).unionByName(new))

    def _settled_months(self, touched: dict[str, list], now: dict[str, DataFrame]) -> list:
        """Months of settlement in the touched partitions, as they were and as they are."""
        both = now["settled_daily"].select("month_start").unionByName(self._units("settled_daily", touched["settled_daily"]).select("month_start"))
        return [r.month_start for r in both.distinct().collect()]  # months

    def _view(self, name: str, touched: dict[str, list], now: dict[str, DataFrame]) -> DataFrame:
        """A table as it will be: stored partitions, and those that will be replaced."""
        unit = (FACTS | SUMS)[name][2]
        return self.read(name).where(~among(unit, touched[name])).select(*now[name].columns).unionByName(now[name])

    def _planned(self, name: str, rows: DataFrame) -> DataFrame:
        return self._written(rows, f"now/{name}")

    def finish(self) -> None:
        """Replace partitions from a run that was planned to its end; throw away any other."""
        if not files.exists(self.spark, self.run):
            return
        if files.exists(self.spark, f"{self.run}/ready"):
            at_once(self._put, [name for name in FACTS | SUMS if files.exists(self.spark, f"{self.run}/now/{name}")])
            self._add_links(self.spark.read.schema(f"{_LINK}, stamp timestamp_ntz").parquet(f"{self.run}/changed").drop("stamp").distinct())
            self._put_marks()
        files.delete(self.spark, self.run)

    def _put(self, name: str) -> None:
        unit = (FACTS | SUMS)[name][2]
        rows = self.spark.read.schema(self._schema(name)).parquet(f"{self.run}/now/{name}")
        files.write_table(rows, self._at(name), unit)
        if name in FACTS:
            self._add_units(name, self.spark.read.schema(self._schema(name)).parquet(f"{self.run}/new/{name}"))
        left = {r[0] for r in rows.select(unit).distinct().collect()}  # units
        for r in self.spark.read.schema("name string, unit date").parquet(f"{self.run}/units").where(F.col("name") == name).collect():
            if r.unit not in left:  # all rows have left it
                files.delete(self.spark, f"{self._at(name)}/{unit}={r.unit if r.unit is not None else '__HIVE_DEFAULT_PARTITION__'}")

    def _put_marks(self) -> None:
        files.write_table(self.spark.read.schema("name string, mark timestamp_ntz").parquet(f"{self.run}/marks").coalesce(1), f"{self.path}/state/marks")


_READS = {
    "cohort_daily": ["fct_payment_attempts"], "approval_daily": ["fct_payment_attempts"], "rule_performance": ["fct_payment_attempts"], "settled_daily": ["fct_payment_attempts"], "fraud_daily": ["fct_payment_attempts"], "orders_daily": ["fct_payment_attempts"],
    "rule_daily": ["rule_hits"], "network_sums": ["settled_daily", "reported_frauds", "fct_chargebacks"], "loss_sums": ["fct_chargebacks", "merchant_claims"],
}
