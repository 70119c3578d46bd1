"""From raw documents to packed training sequences: toxicity, MinHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and reread as the
docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import session
from quern.llm import toxicity
from quern.llm.minhash_dedup import near_duplicates
from quern.llm.packing import packed_sequences
from quern.llm.substring_dedup import substring_dedup
from quern.sources import scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language; the classifier learns from this stage's input."""
    session.prepare(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, model, out_col="score", reject_col="rejected").where(~F.col("rejected")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, similarity 0.8 on five words: that of the smallest id, of such rows the
    one whose values have the smallest digest. Rows are told apart by a number, so that rows that share an id are
    documents of their own, and rows without an id, which come last in a group, are found too. Rows equal in id and text
    count once, also where the text has no words."""
    session.prepare(spark)
    numbered = scratch.save(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")), "numbered")
    found = near_duplicates(numbered.select("__row", F.col("__doc.text").alias("text")), id_col="__row", percent=80)
    rank = F.struct(F.col("__doc.doc_id").isNull(), "__doc.doc_id", F.xxhash64("__doc.text"), F.xxhash64("__doc"), "__row").alias("__rank")
    group = F.struct(F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("a"), *[F.when(F.col("n_shingles") == 0, x) for x in (F.col("__doc.doc_id"), F.col("__doc.doc_id").isNull(), F.col("__doc.text").isNull(), F.xxhash64("__doc.text"))]).alias("__group")
    ranked = numbered.select("__row", "__doc.doc_id", rank, "__doc").join(found.select("__row", "n_shingles", "component_id"), "__row").select(group, "__rank")
    first = scratch.save(ranked.groupBy("__group").agg(F.min("__rank").alias("__rank")).select("__rank.__row"), "first")
    scratch.drop(found)
    return numbered.join(first, "__row", "left_semi").select("__doc.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words and more that occur anywhere else; other characters stay as they are."""
    session.prepare(spark)
    out = substring_dedup(docs, window=35, keep_layout=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the permitted lengths, with the ids and spans of the documents in each."""
    session.prepare(spark)
    return packed_sequences(docs)


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeated_passages), ("packing", pack_sequences)]

#: A trained classifier and a heuristic packing can't be stated in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs, name)
    return docs
