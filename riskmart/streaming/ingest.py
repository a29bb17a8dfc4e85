"""Feeds into bronze tables: what meets the contract is kept, the exact complement goes to quarantine.

A contract is one expression for each expectation; validity is their conjunction with null as false, and both sinks are cut by that one
column, so they can't drift apart. A stream reads its source once and writes both in each micro-batch, into folders named by the stream and the batch:
a batch that is run again after a failure overwrites its own, and a stream that starts anew, with another checkpoint, no other's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskmart import schemas
from riskmart.contracts import CONTRACTS


def contract(name: str) -> dict[str, Column]:
    """Expectations of a feed, by name, as its contract's file has them."""
    return CONTRACTS[name].expectations()


def checked(df: DataFrame, name: str) -> DataFrame:
    """df with _valid and the names of the expectations that each row breaks."""
    rules = contract(name)
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("_broken", broken).withColumn("_valid", F.size("_broken") == 0)


def split(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) of a batch."""
    marked = checked(df, name)
    return marked.where("_valid").drop("_valid", "_broken"), marked.where("not _valid").drop("_valid")


def decoded(messages: DataFrame, name: str) -> DataFrame:
    """Messages with a value of JSON: the feed's fields, and the text itself."""
    text = F.col("value").cast("string")
    return messages.select(text.alias("raw_payload"), F.from_json(text, schemas.FEED[name]).alias("payload")).select("payload.*", "raw_payload")


def kafka(spark: SparkSession, name: str, servers: str, topic: str) -> DataFrame:
    return decoded(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load(), name)


def json_lines(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Files with a JSON message on each line: a topic's stand-in."""
    return decoded(spark.readStream.format("text").load(path), name)


def csv_files(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Files as they arrive, each read once, with where each row is from."""
    return spark.readStream.schema(schemas.FEED[name]).option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("_source_file"))


def batch_name(df: DataFrame, number: int) -> str:
    """The stream's id, which is its checkpoint's, and the number of the micro-batch."""
    return f"{df.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"


def ingest(stream: DataFrame, name: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Into path/<name> and path/quarantine/<name>; with once, all that is there now and then stop."""

    def batch(df: DataFrame, number: int) -> None:
        stamped = df.withColumn("_ingested_at", F.current_timestamp().cast("timestamp_ntz"))
        stamped.persist()
        kept, bad = split(stamped, name)
        own = batch_name(df, number)
        kept.drop("raw_payload").write.mode("overwrite").parquet(f"{path}/{name}/_batch={own}")
        bad.write.mode("overwrite").parquet(f"{path}/quarantine/{name}/_batch={own}")
        stamped.unpersist()

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
