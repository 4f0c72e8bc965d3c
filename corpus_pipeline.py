"""From raw documents to packed sequences: STAGES, each over all that the one before has kept.

Every stage but the last returns the columns of documents; run() writes each stage's result under spark.checkpoint.dir
and reads it again, so a lost executor costs a stage at most.
"""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import langid, packing, pii, quality_classifier, simhash
from inkstone.llm.common import Scratch, table


def _whole(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The named columns, and the whole row as _row, whatever names its columns have."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts, those without letters and rejected ones go. Repeated rows are judged
    alike; an empty table, or one without a known language to learn from, gives no rows."""
    found = langid.identify(_whole(docs, "text"), langid.fit(docs))
    return found.where(~F.col("rejected")).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be of label 1, whatever their ids; null and empty texts get the
    score of no difference. Repeated rows are judged alike; an empty table gives no rows."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_classifier.score(_whole(docs, "text"), model).where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) one row: that of the smallest id, of
    equal ids that of the smallest digest of the text, of equal texts that of the smallest digest of the row; rows without an
    id come last, so a group of them alone keeps one."""
    key = F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest")
    )
    led = Scratch(spark).write(simhash.similar(docs.select(key.alias("key"), "text"), "key"))
    gone = led.where("key <> leader").select(F.col("key").alias("_key")).distinct()
    again = led.where("key = leader").groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_key")
    rows = _whole(docs, key.alias("_key"))
    once = rows.join(gone.union(again), "_key", "left_anti")
    alike = rows.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row"))
    return once.select("_row").union(alike.select("_row")).select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, null texts and repeated rows too, with personal data replaced by its kind; n_chars follows the text. An
    empty table gives no rows."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
