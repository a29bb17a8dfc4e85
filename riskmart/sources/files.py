"""Raw feeds as files and tables, and the sinks that keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart import schemas


def raw_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A CSV file with a header, every business field as text."""
    return spark.read.option("header", True).schema(schemas.RAW[name]).csv(path)


def raw_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW[name]).parquet(path)


def raw_table(spark: SparkSession, name: str, table: str | None = None) -> DataFrame:
    """A catalog table; its stamp may have a zone there."""
    df = spark.table(table or name)
    return df.select(*schemas.RAW_FIELDS[name], F.col("_ingested_at").cast("timestamp_ntz").alias("_ingested_at"))


def raw_rows(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """Rows in memory; the stamp as text, like all else."""
    fields = [*schemas.RAW_FIELDS[name], "_ingested_at"]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in fields))
    return df.withColumn("_ingested_at", F.col("_ingested_at").try_cast("timestamp_ntz"))


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.RAW[name])


def folder(spark: SparkSession, path: str, form: str = "csv") -> dict[str, DataFrame]:
    """All raw feeds of a folder, by name; those without a file are empty."""
    read = {"csv": raw_csv, "parquet": raw_parquet}[form]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for name in schemas.RAW:
        p = hadoop(f"{path}/{name}.{form}")
        found[name] = read(spark, name, p.toString()) if p.getFileSystem(conf).exists(p) else empty(spark, name)
    return found


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite", rebalance: bool = True) -> None:
    """Parquet; with partition_by and mode overwrite only the partitions that df has are replaced. Without rebalance, for rows that lie by partition already, each task writes those it has."""
    if partition_by and rebalance:
        df = df.hint("rebalance", partition_by)  # a few files for each partition, more for large ones
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    w.parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _path(spark, path)
    if not fs.rename(p, _path(spark, to)[1]):
        raise OSError(f"{path} can't be moved to {to}")


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, p = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file: a mark that is there or not."""
    fs, p = _path(spark, path)
    fs.create(p, True).close()


def write_by_day(df: DataFrame, path: str, name: str, batch: str = "0") -> None:
    """Add rows of a raw feed to path/<name>, by what brought them and the day on which they came. A batch that is written again takes its own place."""
    dated = df.select(*schemas.RAW_FIELDS[name], "_ingested_at", F.col("_ingested_at").cast("date").alias("_day"))
    write_table(dated, f"{path}/{name}/_batch={batch}", "_day", mode="append" if batch == "0" else "overwrite")


def by_day(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The raw feeds of write_by_day(), with their day; those without rows are empty."""
    return {name: spark.read.schema(f"{ddl}, _batch string, _day date").parquet(f"{path}/{name}").drop("_batch") if exists(spark, f"{path}/{name}") else empty(spark, name).withColumn("_day", F.lit(None).cast("date")) for name, ddl in schemas.RAW.items()}


def new_path(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return f"{base.rstrip('/')}/{what}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written and read again: a plan that reads it several times makes it once, and a lost executor costs no more than what it was at."""
    path = new_path(df.sparkSession, what)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
