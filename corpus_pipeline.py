"""A training-data pipeline over `documents`: every stage takes what its predecessor kept, and its decisions take effect.

Null and shared ids: rows are documents, whatever their ids. A null text has no language and goes in the first stage; an
empty table passes every stage. Repeated rows: one stays. Other columns than those of documents are not carried. Stages
write tables in the shared folder while their plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, jaccard_join, language_id, packing, suffix_dedup
from newsloom.llm.common import materialized, table

#: Passages of over 50 words have this many bytes, but for some of very short words.
PASSAGE_BYTES = 300
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin stay; the languages are learned from the documents' labels."""
    found = language_id.predict(docs, language_id.fit(docs), keep=True)
    return found.where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays, null ids last. Rows are told apart by a hash
    of id and text, so shared and null ids don't decide what is a near-duplicate; of repeated rows one stays."""
    said = F.when(F.col("text").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("text")))
    told = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), said).cast("binary"))
    rows = docs.select(*COLUMNS).withColumn("_row", told)
    classes = jaccard_join.jaccard_join(rows, doc_id="_row").select(F.col("doc_id").alias("_row"), "class_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    stay = rows.select("_row", "doc_id").distinct().join(classes.distinct(), "_row").groupBy("class_id").agg(F.min(place)["row"].alias("_row"))
    return rows.join(stay.select("_row"), "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of `PASSAGE_BYTES` that stand twice or more are cut from the texts, at every place: a passage that many
    documents share is boilerplate of none of them. A cut character goes whole. Texts with nothing left go."""
    cut = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), width=PASSAGE_BYTES)
    text = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    changed = F.size("removed") > 0
    out = cut.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where(~changed | (F.btrim("text") != "")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces_of(docs, added_tokens=True))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: No stage can be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written as a table in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
