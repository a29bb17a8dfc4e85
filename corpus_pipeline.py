"""A pipeline over the documents: language, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes all that the one before it kept. What a stage decides:
language: documents without a letter, or whose language has a posterior under LANGUAGE_SCORE, go (without any lang in the input only the former); near_duplicates: of each
group that pairs with a Jaccard similarity of SIMILARITY of their five-word shingles join, one row stays, of the least doc_id (rows without an id come last; ties by the
text's hash). The SimHash operator finds them, in its mode for a similarity: within the two bits of its contract hardly a pair at 0.8 would be found. substring_dedup: words
in repeated windows are cut out of the texts, and texts that lose all their words go; decontamination: rows that hold a benchmark item go; packing: the rest becomes sequences.

Stages decide by row, not by doc_id: equal and missing ids are no ties between rows. Rows without text go in the first stage; texts are read whole. An empty table
gives an empty one. Columns of documents can have any names but doc_id, text and n_chars (which is remade where a text is cut) and keep their values: helper columns take free
names. A stage's input is deleted once its output is written; the last stage reads the fourth one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.llm import common, decontamination, langid, packing, simhash, substrings

LANGUAGE_SCORE = 0.5
#: As a fraction.
SIMILARITY = (4, 5)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    if not model.languages:  # nothing to learn from
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name, score = (common.free_name(docs.columns, x) for x in ("language", "language_score"))
    found = langid.predict(docs, model, lang_name=name, score_name=score)
    return found.where((F.col(name) != langid.UNKNOWN) & (F.col(score) >= LANGUAGE_SCORE)).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = common.free_name(docs.columns, "row")
    # A key of each row, written once so that it stays the same.
    rows = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = simhash.near_duplicates(rows, id_col=row, similarity=SIMILARITY)
    many = common.materialise(found.groupBy("component").agg(F.count("*").alias("n_left")).where("n_left > 1"), "many")
    # Rows of groups alone need an order; the others stay.
    grouped = common.materialise(common.join_to_keys(found, many, "component", found.count()), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col(row).alias("row"))
    ordered = common.materialise(rows.select(F.col(row).alias("row"), order.alias("order")).join(grouped, "row"), "ordered")
    stays = ordered.groupBy("component").agg(F.min("order").alias("least")).select(F.col("least.row").alias("row"))
    # What goes is written: Spark then knows its size, and broadcasts it if it is small.
    gone = common.materialise(ordered.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(row)), "gone")
    for x in (found, many, grouped, ordered):
        common.discard(x)
    return rows.join(gone, row, "left_anti").select(*_columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substrings.remove_repeats(docs, one_space=False, carry=tuple(others)).where("n_removed < n_words or n_words = 0")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return cut.select(*[new.get(c, F.col(f"`carry_{c}`").alias(c)) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = common.free_name(docs.columns, "is_contaminated")
    return decontamination.flag(docs, common.table(spark, sf_dir, "benchmark"), name).where(f"not {name}").select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", pack)]
#: No stage but the joins can be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch():
            made = stage(spark, docs, sf_dir)
            written = common.materialise(made, f"stage-{name}", keep=True)
        common.discard(docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
