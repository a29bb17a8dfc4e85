"""A stream that drives the stored warehouse: each micro-batch of messages becomes bronze rows, and the marts follow at once.

Messages carry the feed's name as their topic, a stamp and a value of JSON. A batch is split by the feeds' contracts into bronze (by what brought it and the day it came, so the
refresh finds its rows by partitions) and quarantine; its kept rows are what arrived, and `Stored.refresh` makes anew what they touch. Then the batch is entered in the ledger, by the
stream's id and its number. A batch that comes again after that changes nothing. If a run breaks off before, the batch is done again from its beginning: its bronze
folder is overwritten by the same rows, and a refresh of the same rows gives the same tables.

A feed without a contract keeps every row with its key, and so does every feed of a stream that is run without contracts: the models flag what is odd and drop nothing. Messages of
unknown topics go to quarantine/_unknown. One stream at a time may drive a warehouse.
"""

from __future__ import annotations

from collections.abc import Container

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskmart import schemas
from riskmart.config import Config
from riskmart.contracts import CONTRACTS
from riskmart.plans.dag import Warehouse
from riskmart.plans.stored import FEEDS, Stored
from riskmart.sources import files
from riskmart.streaming import ingest

MESSAGE = "topic string, timestamp timestamp_ntz, value string"


def json_messages(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """Files with a message as JSON on each line, as they arrive: a broker's stand-in."""
    reader = spark.readStream.schema(MESSAGE)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(path)


def kafka_messages(spark: SparkSession, servers: str, topics: dict[str, str]) -> DataFrame:
    """Messages of a broker; topics tells the feed of each topic."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return named(raw, topics)


def named(raw: DataFrame, topics: dict[str, str]) -> DataFrame:
    """Broker rows (topic, value in bytes, timestamp with a zone) as messages, with the feed's name for the topic."""
    feed = F.coalesce(*[F.when(F.col("topic") == t, name) for t, name in topics.items()], "topic")
    return raw.select(feed.alias("topic"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("value").cast("string").alias("value"))


def split(messages: DataFrame, feed: str, contracts: Container[str] = CONTRACTS) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) rows of a feed; contracts are the feeds whose contract holds."""
    payload = F.from_json("value", schemas.FEED[feed])
    rows = messages.where(F.col("topic") == feed).select(F.col("value").alias("raw_payload"), F.col("timestamp").alias("_ingested_at"), payload.alias("payload")).select("payload.*", "raw_payload", "_ingested_at")
    if feed in contracts:
        kept, bad = ingest.split(rows, feed)
        return kept.drop("raw_payload"), bad
    whole = F.col(FEEDS.get(feed, schemas.RAW_FIELDS[feed][0])).isNotNull()
    return rows.where(whole).drop("raw_payload"), rows.where(~whole).withColumn("_broken", F.array(F.lit("key_present")))


def apply(messages: DataFrame, path: str, batch: str, config: Config, buckets: int, contracts: Container[str] = CONTRACTS) -> bool:
    """One micro-batch into the warehouse below path; whether it wasn't in the ledger yet."""
    spark = messages.sparkSession
    entry = f"{path}/state/ledger/{batch}"
    if files.exists(spark, entry):
        return False
    at = f"{path}/_arrived/{batch}"
    files.write_table(messages, at)  # read once from the source
    messages = spark.read.schema(MESSAGE).parquet(at)
    topics = {r.topic for r in messages.where(F.col("topic").isin(list(schemas.RAW))).select("topic").distinct().collect()}  # names of feeds
    arrived = {}
    for feed in topics:
        kept, bad = split(messages, feed, contracts)
        files.write_by_day(kept, f"{path}/bronze", feed, batch)
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/{feed}/_batch={batch}")
        if feed in FEEDS:
            arrived[feed] = kept
    other = messages.where(~F.coalesce(F.col("topic").isin(list(schemas.RAW)), F.lit(False)))
    if not other.isEmpty():
        other.write.mode("overwrite").parquet(f"{path}/quarantine/_unknown/_batch={batch}")
    stored = Stored(Warehouse(spark, files.by_day(spark, f"{path}/bronze"), config), path, buckets)
    if not files.exists(spark, f"{path}/state/marks"):
        stored.build()
    elif arrived:
        stored.refresh(arrived)
    files.touch(spark, entry)
    files.delete(spark, at)
    return True


def drive(messages: DataFrame, path: str, checkpoint: str, config: Config, buckets: int = 64, once: bool = True, contracts: Container[str] = CONTRACTS) -> StreamingQuery:
    """Run a stream of messages into the warehouse below path; with once, all that is there now, in as many micro-batches as the source makes, and then stop."""
    w = messages.writeStream.foreachBatch(lambda df, number: apply(df, path, ingest.batch_name(df, number), config, buckets, contracts) and None).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="15 minutes")).start()
