"""The corpus pipeline: language ID, near-dedup, decontamination, personal data, mixing.

Each stage takes what its predecessor kept and returns the columns of documents; the
last repeats each document as often as the mix takes it and adds ``copy``, from 1.

Edge cases are those of the operators; rows that repeat both id and text are one
document after the second stage, and a null id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.llm._common import table
from loxodrome.llm.decontam import contamination
from loxodrome.llm.langid import fit_language_model, identify_language
from loxodrome.llm.mixing import mix_sources
from loxodrome.llm.near_dup import near_duplicates
from loxodrome.llm.pii import sanitise

#: A language named with less certainty than this is rejected, as is a text without letters.
LEAST_CERTAINTY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = identify_language(docs, fit_language_model(docs))
    return out.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_CERTAINTY)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    return docs.join(bad, (F.xxhash64("text") == F.col("_bad_key")) & docs["doc_id"].eqNullSafe(F.col("_bad_id")), "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs.withColumn("text_key", F.xxhash64("text")), carry=("text_key",))
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("of_id"), F.col("text_key"), "copies")
    joined = docs.join(taken, (F.xxhash64(docs["text"]) == taken["text_key"]) & docs["doc_id"].eqNullSafe(taken["of_id"]))
    return joined.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), taken["copies"])).alias("copy"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("personal_data", personal_data),
    ("source_mixing", mixing),
]

#: Trained models and drawn copies have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
