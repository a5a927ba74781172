"""The registered queries of the corpus operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc
from . import decontamination, hard_negatives, jaccard, langid, licenses, lines, mixing, neighbours, quality, repeats, sharding, toxicity, variants
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def held_out(n: int, remainder: int):
    """Whether the document is kept back from learning; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == remainder


@query("op1_toxicity")
def op1(spark, d):
    """Toxicity of each document; the labels of four fifths of them are learned from."""
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    model = toxicity.trained(docs.filter(~held_out(5, 0)), labels)
    return toxicity.scored(docs.withColumn("held_out", held_out(5, 0)), model, ["doc_id", "held_out"])


@query("op2_sharding")
def op2(spark, d):
    """All documents in eight shards of nearly equal row counts, in random order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shard(table(spark, d, "documents"), shards=8).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_jaccard_join", jaccard.SQL)
def op3(spark, d):
    """Shingle set size and near-duplicate component of each document."""
    return jaccard.join(table(spark, d, "documents"))


@query("op4_language_id")
def op4(spark, d):
    """Predicted language of each document, learned from two thirds of them."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    out = held_out(3, 1)
    scored = langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), docs.filter(~out))
    return scored.select("doc_id", "held_out", "lang_pred", "score")


@query("op5_decontamination")
def op5(spark, d):
    """Benchmark items found in documents, with the best window of each."""
    return decontamination.matches(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("key")


@query("op6_neighbours")
def op6(spark, d):
    """The five nearest vectors found for every fiftieth vector."""
    return neighbours.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_mixing", mixing.SQL)
def op7(spark, d):
    """Words the mix takes of each document."""
    return mixing.plan(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_line_dedup", lines.SQL)
def op8(spark, d):
    """Lines held by three documents or more stay only in the last of them."""
    kept = lines.dedup(table(spark, d, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op9_repeats")
def op9(spark, d):
    """Bytes of each document covered by 200-byte strings that start anywhere else too."""
    return repeats.cut(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_license_scan", licenses.sql())
def op10(spark, d):
    """Licences of each document, by rules over its known licence sentences."""
    return licenses.scan(table(spark, d, "documents")).select(
        "doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_license_sentences"),
        F.array_join("licenses", ",").alias("licenses"))


@query("op11_hard_negatives", hard_negatives.SQL)
def op11(spark, d):
    """For every fiftieth vector and each of its positives, the best rows of another label below the positive's score."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), F.col("id") % 50 == 0)


@query("op12_quality")
def op12(spark, d):
    """Quality of each document; the labels of three quarters of them are learned from."""
    docs, out = table(spark, d, "documents").select("doc_id", "text"), held_out(4, 2)
    model = quality.trained(docs.filter(~out), table(spark, d, "labels"))
    return quality.scored(docs.withColumn("held_out", out), model, ["doc_id", "held_out"])


@query("op13_spelling_variants", variants.sql())
def op13(spark, d):
    """Words of the corpus, each with the far more frequent word one edit away that it is a spelling of."""
    found = variants.runs(table(spark, d, "documents").select("doc_id", "text"), variants.LEAST)
    return variants.grouped(variants.vocabulary(variants.typed(found), variants.TIMES))
