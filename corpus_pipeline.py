"""From raw documents to token ids: toxicity, near-dedup, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and gives the rows that go on, with the columns of ``documents``; the last one gives token
ids. Stages are written down and read again between each other, in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import common as C
from newsloom.llm import decontaminate, near_copies, pii, sentencepiece_viterbi, toxicity
from newsloom.runtime import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go; it is fitted on the labelled ones among ``docs``."""
    ship(spark)
    found = toxicity.toxicity(spark, docs, docs, C.read_table(spark, sf_dir, "labels"))
    return found.where(~F.col("is_toxic")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id stays of each group of near copies; a row repeated as it is stays once; rows without an id stay."""
    ship(spark)
    found = near_copies.near_copies(docs)
    gone = C.checkpoint(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    may_go = C.among(gone.unionByName(again), "doc_id")  # the texts of all others need not be sent anywhere
    rest = docs.where(may_go).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return docs.where(~may_go).unionByName(rest.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship(spark)
    found = decontaminate.contamination(docs, C.read_table(spark, sf_dir, "benchmark"))
    gone = found.where(F.col("n_hit") > 0).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; all rows stay, and their lengths follow."""
    ship(spark)
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the text again."""
    ship(spark)
    out = sentencepiece_viterbi.encode(docs, sentencepiece_viterbi.model_file())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", sanitise_personal_data),
    ("sentencepiece", encode_tokens),
]
ORACLE_SQL = None  # SimHash, the classifiers and BPE have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = C.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
