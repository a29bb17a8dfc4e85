"""Dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.config import Config
from riskmart.functions.columns import iso_weekday, month
from riskmart.functions.frames import daily_dates


def time_spine(spark: SparkSession, config: Config) -> DataFrame:
    """Every day of the calendar, the last one included."""
    return daily_dates(spark, *config.calendar)


def dates(spine: DataFrame) -> DataFrame:
    day = iso_weekday("date_day")
    return spine.select("date_day", month("date_day").alias("month_start"), F.year("date_day").alias("year_number"), F.month("date_day").alias("month_number"), day.alias("iso_day_of_week"), (day >= 6).alias("is_weekend"))


def merchants(staged: DataFrame) -> DataFrame:
    return staged.select("merchant_id", "segment", "mcc", "merchant_created_at")


def risk_rules(hits: DataFrame) -> DataFrame:
    """Each version of a rule, in each mode it was seen in."""
    return hits.select(F.concat("rule_id", F.lit("@v"), F.col("rule_version").cast("string")).alias("rule_key"), "rule_id", "rule_version", "is_shadow").distinct()
