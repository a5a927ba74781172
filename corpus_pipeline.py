"""A corpus pipeline: what a training run would read of `documents`, filtered, deduplicated, mixed and sharded.

Each stage takes all its predecessor kept; its decisions take effect. All but the last return the
columns of `documents`; the last adds `shard` and `slot`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, mixing, sharding, toxicity
from tidemark.llm.common import table, text_key, written
from tidemark.llm.queries import held_out


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the clause grammar finds toxic; learns from the same four fifths of the labels as op1."""
    model = toxicity.trained(docs.filter(~held_out(5, 0)), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every component of 0.8 similar documents, one row of it.

    A document is an id and a text: rows that only share an id are no copies of each other. Of equal
    ids and texts the first row by the other columns stays, of several texts of the smallest id the first by key.
    Documents without an id or without words are no copies of any other and stay. Further columns are kept as they are.
    """
    key = text_key(F.col("text"))
    named = docs.withColumn("__name", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", key)))
    found = jaccard.join(named.select(F.col("__name").alias("doc_id"), "text")).filter("n_shingles > 0 and doc_id is not null")
    found = written(found.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("doc_id", "__name"), "copies")
    # only components and names with several rows are looked at further
    several = found.groupBy("component_id").agg(F.sum("n").alias("rows")).filter("rows > 1").select("component_id")
    several = written(found.join(several.hint("merge"), "component_id", "left_semi"), "several")
    if several.isEmpty():
        return docs
    ids = named.filter("__name is not null").select("__name", "doc_id").distinct()
    ids = written(several.join(ids.hint("merge"), "__name"), "several-ids")
    first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "__name")).alias("f")).select(F.col("f.__name").alias("__name"))
    gone = ids.select("__name").join(first.hint("merge"), "__name", "left_anti").distinct()
    kept = named.join(gone.hint("merge"), "__name", "left_anti")
    twice = several.filter("n > 1").select("__name")
    again = kept.join(twice.hint("merge"), "__name", "left_semi")
    # a map has no order: its entries have; the first row is kept before the shuffle, so equal rows do not meet
    keys = [F.sort_array(F.map_entries(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes if c not in ("doc_id", "text")]
    order = F.row_number().over(Window.partitionBy("__name").orderBy(*keys, F.lit(0)))
    again = again.withColumn("__i", order).filter("__i = 1")
    return kept.join(twice.hint("merge"), "__name", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; documents of sources short of text come twice."""
    return mixing.mix(docs).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A random order of all rows, cut into eight shards."""
    return sharding.shard(docs, shards=8)


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: The toxicity model is fitted, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
