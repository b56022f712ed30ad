"""A stored lexical index: postings sorted by term with bounds for ranges of chunks, written once, extended by new chunks, read by the terms that are asked for.

Chunks are dealt to ranges of about ``per_range``. The postings (term, range, chunk, frequency, length) lie in folders by the term's hash and are sorted by
term and range; so do the bounds, which hold for each term and range how many chunks have it, the greatest frequency and the least length among them. Batches of
extensions lie side by side, and one counts from the moment its totals are written, which happens last.

A search reads the bounds of its terms first: greatest frequency and least length give a range's best possible score for each question. It
scores the most promising ranges, and then only those others whose bound reaches the k-th score found so far. The answer is that of a full count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import work
from .ranking import top_n
from .retrieval import tokens

#: Folders by term hash; ranges that are scored for every question before the bounds cut.
BUCKETS = 64
PER_RANGE = 64
FIRST = 8
#: Tokens behind the postings of one file, about.
PER_FILE = 1 << 24

TOTALS = "batch int, n long, sized long, length long, buckets int"


def _totals(spark: SparkSession, path: str) -> list:
    """A row for each complete batch."""
    return spark.read.schema(TOTALS).parquet(f"{path}/totals").orderBy("batch").collect() if work.exists(spark, f"{path}/totals") else []


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _held(value: Column, use) -> Column:
    """use(value), with the value computed once a row: a name in a lambda's body would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def counted(t: Column) -> Column:
    """The distinct terms of an array, in order, each with how often it stands there; within the row, without a shuffle."""

    def runs(ordered: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == F.size(ordered)) | (F.get(ordered, i - 1) != F.get(ordered, i)))
        tf = lambda ends: F.transform(ends, lambda e, i: F.struct(F.get(ordered, e - 1).alias("term"), (e - F.coalesce(F.get(ends, i - 1), F.lit(0))).alias("tf")))
        return _held(ends, tf)

    empty = F.array().cast("array<struct<term: string, tf: int>>")
    return F.when(t.isNotNull(), _held(F.array_sort(t), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(empty)))


def extend(chunks: DataFrame, path: str, text: str = "content", chunk: str = "chunk_id", buckets: int = BUCKETS, per_range: int = PER_RANGE) -> int:
    """Adds the chunks whose ids the index does not hold yet, and says how many; begins a new index where there is none.

    Null ids are left out; of rows that repeat an id the one with the greatest text counts.
    """
    spark = chunks.sparkSession
    held = _totals(spark, path)
    batch, buckets = (held[-1].batch + 1, held[0].buckets) if held else (0, buckets)
    rows = chunks.where(F.col(chunk).isNotNull()).groupBy(F.col(chunk).alias("chunk_id")).agg(F.max(text).alias("x"))
    if held:
        known = spark.read.parquet(*[f"{path}/chunks/batch={r.batch}" for r in held]).select("chunk_id")
        rows = rows.join(known, "chunk_id", "left_anti")
    rows = rows.select("chunk_id", tokens(F.col("x")).alias("t")).withColumn("length", F.when(F.col("t").isNotNull(), F.size("t")))
    rows = work.stored(rows.select("chunk_id", "length", counted(F.col("t")).alias("terms")), "terms-of-chunks")
    n, sized, length = rows.agg(F.count(F.lit(1)), F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not n:
        return 0
    rows.select("chunk_id").write.mode("overwrite").parquet(f"{path}/chunks/batch={batch}")
    deal = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, math.ceil(n / per_range)))).cast("int")
    postings = rows.select("chunk_id", "length", deal.alias("range"), F.explode("terms").alias("e")).select("e.term", "range", "chunk_id", "e.tf", "length")
    # a term of very many chunks is split by its ranges
    slices = max(1, math.ceil(length / (buckets * PER_FILE)))
    postings = postings.withColumn("bucket", _bucket(buckets)).repartition(buckets * slices, "bucket", F.pmod(F.xxhash64("term", "range"), F.lit(slices)))
    postings.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    written = spark.read.option("basePath", f"{path}/postings").parquet(f"{path}/postings/batch={batch}")
    bounds = written.groupBy("bucket", "term", "range").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
    bounds = bounds.repartition(buckets * slices, "bucket", F.pmod(F.xxhash64("term"), F.lit(slices)))
    bounds.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bounds/batch={batch}")
    spark.createDataFrame([(batch, n, sized, length, buckets)], TOTALS).coalesce(1).write.mode("append").parquet(f"{path}/totals")
    return n


def _batches(spark: SparkSession, path: str, kind: str, batches: list[int], buckets: list[int] | None = None) -> DataFrame:
    """Postings or bounds of some batches, from the folders of some buckets."""
    rows = spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/batch={b}" for b in batches])
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) of the whole index, from the bounds alone."""
    return _batches(spark, path, "bounds", [r.batch for r in _totals(spark, path)]).groupBy("term").agg(F.sum("n").alias("df"))


class Search:
    """The steps of one search, each written: questions, bounds of ranges, the first ranges and what they give, and the other ranges that may still matter."""

    def __init__(self, queries: DataFrame, path: str, k: int, match: str, k1: float, b: float, query: str, text: str, first: int):
        if match not in ("any", "all"):
            raise ValueError(f"match is 'any' or 'all', not {match!r}")
        spark = queries.sparkSession
        totals = _totals(spark, path)
        n, mean = sum(r.n for r in totals), sum(r.length for r in totals) / max(1, sum(r.sized for r in totals))  # null texts have no length
        self.k, self.match, self.k1, self.b, self.mean = k, match, k1, b, mean
        asked = queries.select(F.col(query).alias("query_id"), F.array_distinct(tokens(F.col(text))).alias("t")).withColumn("n_terms", F.size("t"))
        asked = asked.select("query_id", "n_terms", F.explode("t").alias("term")).withColumn("bucket", _bucket(totals[0].buckets if totals else 1))
        asked = work.stored(asked, "asked")
        buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # no more than the index has
        self.postings = _batches(spark, path, "postings", [r.batch for r in totals], buckets)
        heads = _batches(spark, path, "bounds", [r.batch for r in totals], buckets).join(asked.select("bucket", "term").distinct(), ["bucket", "term"])
        heads = work.stored(heads, "bounds-of-terms")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        self.asked = work.stored(asked.join(df, "term").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))), "terms")
        best = F.sum(F.col("idf") * self.weight(F.col("max_tf"), F.col("min_length")))
        bounds = self.asked.join(heads.drop("bucket"), "term").groupBy("query_id", "n_terms", "batch", "range").agg(best.alias("bound"), F.count(F.lit(1)).alias("terms"))
        if match == "all":
            bounds = bounds.where("terms = n_terms")
        self.bounds = work.stored(bounds, "bounds")
        self.first = work.stored(top_n(self.bounds, ["query_id"], ["-bound", "batch", "range"], first).select("query_id", "batch", "range"), "first-ranges")
        self.found = work.stored(self.scored(self.first), "first-scores")
        kth = top_n(self.found, ["query_id"], ["-score", "chunk_id"], k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("have")).where(F.col("have") >= k)
        others = self.bounds.join(kth, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
        self.rest = others.join(self.first, ["query_id", "batch", "range"], "left_anti").select("query_id", "batch", "range")

    def weight(self, tf: Column, length: Column) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def scored(self, ranges: DataFrame) -> DataFrame:
        """Scores of the chunks in some (query_id, batch, range)."""
        need = ranges.join(self.asked.select("query_id", "n_terms", "bucket", "term", "idf"), "query_id")
        each = need.join(self.postings, ["bucket", "term", "batch", "range"])
        score = F.round(F.sum(F.col("idf") * self.weight(F.col("tf"), F.col("length"))), 9)
        hits = each.groupBy("query_id", "chunk_id", "n_terms").agg(score.alias("score"), F.count(F.lit(1)).alias("held"))
        return (hits.where("held = n_terms") if self.match == "all" else hits).select("query_id", "chunk_id", "score")

    def result(self) -> DataFrame:
        hits = self.found.unionByName(self.scored(self.rest))
        return top_n(hits, ["query_id"], ["-score", "chunk_id"], self.k).select("query_id", "rank", "chunk_id", "score")


def search(queries: DataFrame, path: str, k: int = 30, match: str = "any", k1: float = 1.2, b: float = 0.75, query: str = "query_id", text: str = "text", first: int = FIRST) -> DataFrame:
    """(query_id, rank, chunk_id, score) by Okapi BM25 from a stored index; match="all" keeps chunks that hold every term of the query."""
    spark = queries.sparkSession
    if not _totals(spark, path):
        kinds = f"query_id {queries.schema[query].dataType.simpleString()}, rank int, chunk_id string, score double"
        return spark.createDataFrame([], kinds)
    return Search(queries, path, k, match, k1, b, query, text, first).result()
