"""Corpus pipeline: five training-data stages over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.llm import line_dedup, mixing, near_dedup, packing, quality
from figweave.llm.queries import held_out
from figweave.llm.shared import write_table

#: A classifier and random draws have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; the others go. Columns stay.

    Each row is judged by its own text, so rows that repeat an id or a text are judged alike; null and empty texts by the bias alone; a null id is scored but never
    learned from. No rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.filter(F.col("score") >= 0.7).select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least three documents share, except where they are kept; n_chars follows.

    Every row stays. Null texts become empty ones; rows that repeat an id are one document and keep or lose a line alike; null ids count as one document below all others. No rows
    give no rows.
    """
    out = line_dedup.line_dedup(docs).select("doc.*")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    A document without words (null, empty or blank text) is a group of its own and stays, as do rows with a null id. Rows that repeat an id are one document: all stay, or all
    go. No rows give no rows.
    """
    gone = near_dedup.near_dedup(docs).filter("not kept").select("id").distinct()
    return docs.select(F.struct(*docs.columns).alias("doc")).join(gone, F.col("doc.doc_id") == F.col("id"), "left_anti").select("doc.*")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows are repeated, or left out where their source is over its target.

    Rows with one id and text share the copies that the mix gave them, as evenly as whole copies allow, so no target is passed. Documents without words are never taken; a null
    source is a source of its own; a null id is drawn by its text. No rows give no rows.
    """
    drawn = mixing.pareto_mix(docs).groupBy(_known(F.col("id")).alias("k"), "th").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), _known(F.col("doc_id")).alias("k"), F.xxhash64("text").alias("th")).join(drawn, ["k", "th"])
    once, more = F.expr("cast(copies div n as int)"), F.col("copies") % F.col("n")
    place = F.row_number().over(W.partitionBy("k", "th").orderBy(F.lit(0)))
    rows = rows.withColumn("times", F.when(F.col("n") == 1, F.col("copies")).otherwise(once + (place <= more).cast("int")).cast("int"))
    return rows.filter("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def _known(doc_id: Column) -> Column:
    """An id that joins, with one value for null."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that the mix gave, in a token-budget batch of its length bucket.

    Null and empty texts have length 0 and go to the first bucket; repeated rows and null ids are packed like others. No rows give no rows.
    """
    return packing.pack_buckets(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("pack", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir, each one's rows written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
