"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the
stage before it kept. All but the last return the columns of documents.

- language: drops documents without a letter, and those that no learned language
  fits (best share under MIN_SHARE). With nothing to learn from, only the former go.
- near_duplicates: of each group linked by word shingles (five words, similarity
  0.8 or more) the document of smallest doc_id stays; where none has a doc_id, one
  of them. Rows that repeat doc_id and text are one document.
- repeated_passages: cuts out each string of 50 bytes that an earlier document
  has too; documents of which nothing is left go.
- personal_data: puts the kind in place of each span found.
- pack: pieces of token ids in sequences of at most 1024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import jaccard, langid, packing, pii, suffix_dedup
from terrapanel.llm.common import broadcast_if_small, materialize, scratch_scope

MIN_SHARE = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learned(docs)
    judged = langid.identify(docs.select(*COLUMNS), model)
    fits = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE)
    return judged.where(fits if model["langs"] else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.unhex(F.md5("text"))
    with scratch_scope(spark):  # only the keys of rows that go outlive the search
        groups = jaccard.similar_groups(docs, size=5, percent=80, links_too=False)
        other = ~(F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & F.col("keeper.text_key").eqNullSafe(F.col("text_key")))
        gone = materialize(groups.where(other).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone", keep=True)
    keyed = docs.select(*COLUMNS).withColumn("same", key)
    kept = keyed.join(broadcast_if_small(gone, gone.count(), 1_000_000), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("same") == F.col("gone_key")), "left_anti")
    # rows that repeat doc_id and text are one document; only ids are read to see whether there are any
    if docs.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept.select(*COLUMNS)
    return kept.dropDuplicates(["doc_id", "same"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, carry=("lang", "source"))
    left = cut.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = docs.withColumn("text", pii.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep=("ids",))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("pack", pack)]

#: SQL can't express the learned and the packing stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
