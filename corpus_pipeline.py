"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept.

The stages are functions of (spark, docs, sf_dir); the caller may write and reread between them.
All but the last return the columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtusk.llm import jaccard, packing, quality_rules, toxicity
from flowtusk.llm.common import read_table
from flowtusk.llm.queries import WORDS
from flowtusk.llm.training import THRESHOLD
from flowtusk.plans.storage import store

#: Near-duplicates of the corpus: words of an n-gram and least similarity (per cent).
WORDS_OF_NGRAM, SIMILARITY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject. It learns from the table `labels`
    and the texts of `documents` in `sf_dir`; if these have not texts of both labels, all stay."""
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(F.col("text"), model, spark) < THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id. Of rows of one id
    one stays; rows without id have no group and stay."""
    groups = jaccard.jaccard_components(docs, words=WORDS_OF_NGRAM, numerator=SIMILARITY, denominator=100)
    # Of most ids every row stays. Those of which none or one of several stays are fewer, and sent to the rows.
    heads = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("count"))
    others = store(heads.filter("count <> 1"), "others")
    others = F.broadcast(others) if others.count() <= jaccard.BROADCAST_IDS else others
    # Rows travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = rows.withColumn("doc_id", F.col("row.doc_id")).join(others, "doc_id", "left")
    repeated = marked.filter("count > 1").dropDuplicates(["doc_id"]).select("row")
    out = marked.filter("count IS NULL").select("row").unionByName(repeated)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, packed into sequences: one row per piece."""
    return packing.pack_documents(docs, WORDS)


STAGES = [("toxicity", drop_toxic), ("quality rules", keep_quality), ("n-gram Jaccard join", drop_near_duplicates),
          ("best-fit packing", pack)]

#: SQL cannot express the classifier, the join and the packing; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`. What a stage keeps is written and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
