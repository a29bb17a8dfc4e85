"""Lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.sources import files

#: Network, reason code, description, category of chargeback reasons.
REASON_CODES = [
    ("visa", "10.1", "EMV Liability Shift Counterfeit Fraud", "fraud"),
    ("visa", "10.2", "EMV Liability Shift Non-Counterfeit Fraud", "fraud"),
    ("visa", "10.3", "Other Fraud - Card-Present Environment", "fraud"),
    ("visa", "10.4", "Other Fraud - Card-Absent Environment", "fraud"),
    ("visa", "10.5", "Visa Fraud Monitoring Program", "fraud"),
    ("visa", "11.1", "Card Recovery Bulletin", "authorization"),
    ("visa", "11.2", "Declined Authorization", "authorization"),
    ("visa", "11.3", "No Authorization", "authorization"),
    ("visa", "12.6", "Duplicate Processing or Paid by Other Means", "processing_error"),
    ("visa", "13.1", "Merchandise or Services Not Received", "consumer_dispute"),
    ("visa", "13.3", "Not as Described or Defective", "consumer_dispute"),
    ("visa", "13.6", "Credit Not Processed", "consumer_dispute"),
    ("mastercard", "4837", "No Cardholder Authorization", "fraud"),
    ("mastercard", "4863", "Cardholder Does Not Recognize - Potential Fraud", "fraud"),
    ("mastercard", "4870", "Chip Liability Shift", "fraud"),
    ("mastercard", "4871", "Chip/PIN Liability Shift", "fraud"),
    ("mastercard", "4853", "Cardholder Dispute", "consumer_dispute"),
    ("mastercard", "4834", "Point-of-Interaction Error", "processing_error"),
]
#: Code, description, kind of an issuer's response.
RESPONSE_CODES = [
    ("00", "Aprovada", "approved"),
    ("05", "Do not honor", "soft"),
    ("51", "Saldo insuficiente", "soft"),
    ("61", "Excede limite de valor", "soft"),
    ("65", "Excede limite de quantidade", "soft"),
    ("91", "Emissor indisponivel", "soft"),
    ("96", "Falha do sistema", "soft"),
    ("14", "Cartao invalido", "hard"),
    ("41", "Cartao perdido", "hard"),
    ("43", "Cartao roubado", "hard"),
    ("54", "Cartao vencido", "hard"),
    ("57", "Transacao nao permitida ao portador", "hard"),
    ("59", "Suspeita de fraude", "hard"),
]


_SCHEMAS = {"ref_reason_codes": "network string, reason_code string, reason_description string, reason_category string", "ref_response_codes": "issuer_response_code string, description string, decline_type string"}


def reason_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REASON_CODES, _SCHEMAS["ref_reason_codes"])


def response_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESPONSE_CODES, _SCHEMAS["ref_response_codes"])


def from_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A lookup table from a CSV file with a header, in place of the table that is here by the same name. Codes are trimmed, and one that occurs twice is an error: joins go by the code alone."""
    key = {"ref_reason_codes": "reason_code", "ref_response_codes": "issuer_response_code"}[name]
    df = spark.read.option("header", True).option("enforceSchema", False).schema(_SCHEMAS[name]).csv(path).withColumn(key, F.trim(key))
    if twice := [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]:
        raise ValueError(f"{path}: codes that occur twice: {twice}")
    return df


def folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The lookup tables that a folder has files of, by name."""
    return {name: from_csv(spark, name, f"{path}/{name}.csv") for name in _SCHEMAS if files.exists(spark, f"{path}/{name}.csv")}
