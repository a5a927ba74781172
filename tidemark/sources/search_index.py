"""Search without a scan: postings of trigrams, candidates verified.

A text that holds the query holds each of its trigrams. Postings are (field, gram, key), one row per
distinct trigram of a text, stored by a hash of the gram and sorted by it, so that a search reads a few
stretches of them; a dictionary says how many texts hold a gram. A search looks up its rarest grams, joins their
postings, and tests the candidates by the search's own rule: same rows as the scan.

A query of one or two letters has no trigram and scans the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import search_match
from ..session import fresh_path

PARTS = 64
#: Tasks that the postings of a part are dealt to.
DEALT = 16
#: Grams of a query that are looked up: the rarest ones; the others are left to the verification.
LOOKED_UP = 4


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def of_query(query: str) -> list[str]:
    q = query.strip().lower()
    return sorted({q[i:i + 3] for i in range(len(q) - 2)})


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


@dataclass
class SearchIndex:
    """Rows with a unique `key`, and the postings and dictionary of `symbol` and `name` (two of their columns)."""

    rows: DataFrame
    key: str
    symbol: str
    name: str
    postings: DataFrame
    dictionary: DataFrame

    def lookup(self, wanted: Sequence[str]) -> DataFrame:
        """Postings of these grams alone: their parts are pruned, and the grams pushed to the scan."""
        return _only(self.postings, wanted)

    def candidates(self, query: str) -> DataFrame:
        """(key) of rows of which a field holds the rarest grams of the query."""
        wanted = of_query(query)
        held = {(r.field, r.gram): r.n for r in _only(self.dictionary, wanted).collect()}        # at most two rows a gram
        found = None
        for field in ("symbol", "name"):
            if any((field, g) not in held for g in wanted):
                continue
            rare = sorted(wanted, key=lambda g: (held[field, g], g))[:LOOKED_UP]
            part = self.lookup(rare).filter(F.col("field") == field).groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(rare)).select("key")
            found = part if found is None else found.unionByName(part)
        return self.postings.select("key").limit(0) if found is None else found.distinct()

    def search(self, query: str) -> DataFrame:
        """The rows that match: symbol prefix or name fragment, in any case."""
        match = search_match(query, self.symbol, self.name)
        if len(query.strip()) < 3:
            return self.rows.filter(match)
        near = self.candidates(query).withColumnRenamed("key", "_key")
        return self.rows.join(near, F.col(self.key) == F.col("_key"), "left_semi").filter(match)


def _only(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    at = [r.p for r in df.sparkSession.createDataFrame([(g,) for g in wanted], "gram string").select(_part(F.col("gram")).alias("p")).distinct().collect()]
    return df.filter(F.col("part").isin(at) & F.col("gram").isin(list(wanted)))


def build(rows: DataFrame, key: str, symbol: str, name: str, path: str | None = None) -> SearchIndex:
    """Writes postings and dictionary of `rows`; texts are read once. Null keys and texts have no postings."""
    spark = rows.sparkSession
    path = path or fresh_path(spark, "search")
    fields: Mapping[str, str] = {"symbol": symbol, "name": name}
    each = F.array(*[F.struct(F.lit(f).alias("field"), grams(F.col(c).cast("string")).alias("grams")) for f, c in fields.items()])
    long = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(each).alias("f"))
    posted = long.select("key", "f.field", F.explode("f.grams").alias("gram")).withColumn("part", _part(F.col("gram")))
    # dealt by the part and a hash of the key: a text has each gram once, so a gram that most texts hold is spread over tasks.
    # Ranges would cut every text into grams a second time, to sample them.
    dealt = posted.repartition("part", F.pmod(F.xxhash64("key"), F.lit(DEALT))).sortWithinPartitions("part", "gram", "field")
    dealt.write.partitionBy("part").parquet(f"{path}/postings")
    postings = spark.read.schema(dealt.schema).parquet(f"{path}/postings")
    counted = postings.groupBy("part", "gram", "field").agg(F.count("*").alias("n"))
    counted.repartitionByRange("part", "gram").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/dictionary")
    return SearchIndex(rows, key, symbol, name, postings, spark.read.schema(counted.schema).parquet(f"{path}/dictionary"))
