"""Corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of ``documents``, whatever else ``docs`` brings along. Decisions are taken for each row by itself, named by a
hash of its id and text, so rows with a null doc_id and different texts that share one are judged as all others;
equal rows stay or go together, and one of them is left by the stage of near copies. Null and empty texts are rows
like others, very long ones too; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm import decontaminate, jaccard_join, langid, mixing, toxicity
from seamark.llm.common import durable, if_small, removed, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language with less probability than this is not known. Very short texts seldom reach more, and are kept.
LEAST_LANG = 0.35


def _key() -> Column:
    """A row's own name."""
    return F.xxhash64("doc_id", "text", F.lit(9))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as the operators take them, with each row's own name in place of its id."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` less the rows whose names are in ``keys`` (doc_id)."""
    gone = durable(keys.select(F.col("doc_id").alias("_key")).distinct())
    return docs.select(*COLUMNS).withColumn("_key", _key()).join(if_small(gone), "_key", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; the model learns from labelled documents of ``docs``."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return _without(docs, toxicity.score(_keyed(docs), model).where("predicted = 1"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with one of under LEAST_LANG probability, go."""
    net = langid.fit(docs)
    return _without(docs, langid.predict(_keyed(docs), net).where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_LANG)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.8 or more connect, the one with the least doc_id stays (null last)."""
    names = durable(docs.select("doc_id", _key().alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")))
    groups = jaccard_join.jaccard_join(_keyed(docs)).select(F.col("doc_id").alias("key"), "group_id").distinct().join(names, "key")
    groups = durable(groups.select("group_id", "key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("order")))
    first = durable(groups.groupBy("group_id").agg(F.count("*").alias("n"), F.min("order").alias("first")).where("n > 1").select("group_id", F.col("first.key").alias("kept")))
    gone = groups.join(if_small(first), "group_id").where("key <> kept").select(F.col("key").alias("doc_id"))
    left = _without(docs, gone).withColumn("_key", _key())
    # one of equal rows: only rows that repeat are shuffled
    again = durable(names.where("rows > 1").select(F.col("key").alias("_key")))
    once, more = left.join(if_small(again), "_key", "left_anti"), left.join(if_small(again), "_key", "left_semi")
    return once.unionByName(more.dropDuplicates(["_key"])).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go."""
    return _without(docs, decontaminate.contaminated(_keyed(docs), table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target marginals of source, language and topic."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learned and randomised stages can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage has written goes when the next one has."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
