"""A corpus pipeline of training-data operators. Each stage gets what its predecessor kept, as the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.bpe import digest_texts
from spanlab.llm.common import discard, free_names, read_table, saved_alone
from spanlab.llm.line_dedup import line_dedup
from spanlab.llm.minhash_dedup import near_duplicates
from spanlab.llm.mixing import mix
from spanlab.llm.quality_rules import quality_rules

NEAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    (into,) = free_names(docs, "__q")
    return quality_rules(docs, into=into).where(F.col(into)["kept"]).drop(into)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first place; so do documents that held nothing else. n_chars follows the text."""
    (into,) = free_names(docs, "__l")
    cleaned = line_dedup(docs, into=into)
    same = F.col(into)["n_removed"] == 0
    cleaned = cleaned.where(same | F.col(into)["left"])
    return cleaned.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays. Copies share NEAR percent of their shingles or more; op1's contract has its own bound."""
    (text,) = free_names(docs, "__text")
    gone = near_duplicates(docs, NEAR).where("NOT kept").select("doc_id", F.col("text_hash").alias(text)).distinct()
    return docs.withColumn(text, F.xxhash64("text")).join(gone, ["doc_id", text], "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stands as often as the mix takes it: not at all, once or twice. Texts without words aren't taken.

    A row is known by two hashes of all its columns, so one without a doc_id, or with that of another, has a place of its own; equal rows stand as often as they are
    taken together.
    """
    *row, times, copy = free_names(docs, "__row", "__proof", "__times", "__n")
    marked = docs.withColumns({row[0]: F.xxhash64(*docs.columns), row[1]: F.hash(*docs.columns)})
    taken = mix(marked, also=tuple(row)).where("taken > 0").groupBy(*row).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias(times))
    return marked.dropDuplicates(row).join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return digest_texts(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("bpe", tokens)]

#: The mix and BPE have no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, writing and rereading what each returns."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
