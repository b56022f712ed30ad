"""Lexical and dense retrieval over chunks, rank fusion, re-ranking, and the pipeline of them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work
from .joins import expand_parents as put_parents
from .ranking import top_n


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}0-9]+"), lambda t: t != "")


Encoder = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def embed(df: DataFrame, text: str, encoder: Encoder | None = None, out: str = "embedding", dim: int = 256) -> DataFrame:
    """Adds unit vectors: a caller's encoder over batches of texts, or hashed term counts."""
    if encoder is not None:
        encode = F.pandas_udf(encoder, "array<float>")
        raw = df.withColumn("_v", F.transform(encode(text), lambda x: x.cast("double")))
        norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
        return raw.withColumn(out, F.transform("_v", lambda x: F.coalesce((x / F.nullif(norm, F.lit(0.0))).cast("float"), F.lit(0.0).cast("float")))).drop("_v")
    hashed = HashingTF(numFeatures=dim, inputCol="_t", outputCol="_tf").transform(df.withColumn("_t", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))))
    unit = Normalizer(inputCol="_tf", outputCol="_n").transform(hashed)
    return unit.withColumn(out, vector_to_array("_n", "float32")).drop("_t", "_tf", "_n")


#: Bytes of chunks that are compared with one block of queries after the other.
HELD = 1 << 25


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int = 30, block: int = 1024, query: str = "query_id", chunk: str = "chunk_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, chunk_id, score): the k chunks with the greatest cosine for each query, ties to the smaller id.

    Queries are a stated batch, written to the shared folder in blocks of about ``block``. A task reads one block after the other, and each run of chunks
    answers with its own k best for each query and those that tie with them. Vectors are compared with those of their own length.
    """
    asked = queries.select(F.col(query).alias("q"), F.col(vec).alias("v")).dropna()
    kinds = f"query_id {asked.schema['q'].dataType.simpleString()}, chunk_id {chunks.schema[chunk].dataType.simpleString()}, score double"
    files = work.blocks(asked, block, "query-blocks")

    def matrices(table: pa.Table | pa.RecordBatch, ids: str) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
        lengths = table.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        for n in np.unique(lengths).tolist():
            some = table.filter(pa.array(lengths == n))
            m = some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
            yield n, some.column(ids).combine_chunks(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def answers(held: pa.Table) -> Iterator[pa.RecordBatch]:
        for n, ids, vectors in matrices(held, "c"):
            for file in files:
                for length, asks, matrix in matrices(work.read_block(file), "q"):
                    if length != n:
                        continue
                    for at in range(0, len(vectors), 4096):
                        scores = np.round(matrix @ vectors[at : at + 4096].T, 9)
                        # whatever reaches the k-th score may be among the k best, ties too
                        kth = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else -np.inf
                        row, best = np.nonzero(scores >= kth)
                        yield pa.RecordBatch.from_arrays([asks.take(pa.array(row)), ids.take(pa.array(at + best)), pa.array(scores[row, best])], names=["query_id", "chunk_id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches):
            yield from answers(held)

    found = chunks.select(F.col(chunk).alias("c"), F.col(vec).alias("v")).dropna().mapInArrow(scan, kinds)
    return top_n(found, ["query_id"], ["-score", "chunk_id"], k).select("query_id", "rank", "chunk_id", "score")


@dataclass
class LexicalIndex:
    """postings (term, chunk_id, tf, length), terms (term, df), totals (n, mean_length; one row), rows (chunk_id, t, length; t are a chunk's terms in order)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    rows: DataFrame


def lexical_index(chunks: DataFrame, text: str = "content", chunk: str = "chunk_id") -> LexicalIndex:
    rows = chunks.select(F.col(chunk).alias("chunk_id"), tokens(F.col(text)).alias("t")).withColumn("length", F.size("t"))
    postings = rows.select("chunk_id", "length", F.explode("t").alias("term")).groupBy("term", "chunk_id", "length").agg(F.count(F.lit(1)).alias("tf"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean_length"))
    return LexicalIndex(postings, terms, totals, rows)


#: Cells of the table of terms and chunks that is scored at a time, and what rounding may add to a score.
CELLS = 1 << 22
SLACK = 1e-8


def _frequencies(t: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often) for the rows of an array of lists that hold some of the terms, in order of rows."""
    at = pc.index_in(t.flatten(), value_set=terms)
    row = np.repeat(np.arange(len(t)), pc.fill_null(t.value_lengths(), 0).to_numpy(zero_copy_only=False))
    held = at.is_valid().to_numpy(zero_copy_only=False)
    cell, tf = np.unique(row[held] * max(1, len(terms)) + pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[held], return_counts=True)
    return *np.divmod(cell, max(1, len(terms))), tf


@lru_cache(maxsize=4)
def _asked(file: str) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, list[np.ndarray]]:
    """Of a block of queries: their ids, how many terms each has, the distinct terms, their weights, and the numbers of each query's terms."""
    block = work.read_block(file).combine_chunks()
    lists = block.column("terms").combine_chunks()
    flat = lists.flatten()
    terms = pc.unique(flat.field("term"))
    number = pc.index_in(flat.field("term"), value_set=terms).to_numpy(zero_copy_only=False)
    idf = np.zeros(len(terms))
    idf[number] = flat.field("idf").to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return block.column("q").combine_chunks(), block.column("n_terms").to_numpy(), terms, idf, np.split(number, ends[:-1])


def _term_counts(rows: DataFrame, files: list[str]) -> DataFrame:
    """(term, n, sized, length) from each task: how many rows hold each term of some files, and under no term the number of rows, of those with an array, and of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(3, np.int64), dict.fromkeys(files, 0)
        for batch in batches:
            t = batch.column("t")
            total += (len(t), len(t) - t.null_count, pc.sum(t.value_lengths()).as_py() or 0)
            for file in files:
                terms = work.read_block(file).column("term").combine_chunks()
                held[file] += np.bincount(_frequencies(t, terms)[1], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *(pa.array([x]) for x in total)], names=["term", "n", "sized", "length"])
        for file in files:
            some = np.flatnonzero(held[file])
            none = pa.array(np.zeros(len(some), np.int64))
            if len(some):
                yield pa.RecordBatch.from_arrays([work.read_block(file).column("term").combine_chunks().take(pa.array(some)), pa.array(held[file][some]), none, none], names=["term", "n", "sized", "length"])

    return rows.select("t").mapInArrow(run, "term string, n long, sized long, length long")


def bm25_top_k(queries: DataFrame, index: LexicalIndex, k: int = 30, match: str = "any", k1: float = 1.2, b: float = 0.75, query: str = "query_id", text: str = "text", block: int = 1024) -> DataFrame:
    """(query_id, rank, chunk_id, score) by Okapi BM25; match="all" keeps chunks that hold every term of the query.

    Queries are a stated batch, written to the shared folder in blocks of about ``block``. One pass over the chunks counts the terms that are asked for. In a second one a task
    reads one block after the other, and its chunks answer with the best for each query and those that tie with them, so that no other pair of query and chunk is kept or shuffled.
    Rows that repeat a chunk's id are scored together, by joins.
    """
    if match not in ("any", "all"):
        raise ValueError(f"match is 'any' or 'all', not {match!r}")
    asked = queries.select(F.col(query).alias("query_id"), F.array_distinct(tokens(F.col(text))).alias("t")).withColumn("n_terms", F.size("t"))
    asked = work.stored(asked.select("query_id", "n_terms", F.explode("t").alias("term")), "asked")
    repeated = work.stored(index.rows.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("chunk_id").alias("_id")), "repeated-ids")
    some, same = not repeated.isEmpty(), F.col("chunk_id").eqNullSafe(F.col("_id"))
    rows = index.rows.join(repeated, same, "left_anti") if some else index.rows

    counts = work.stored(_term_counts(rows, work.blocks(asked.select("term").distinct(), 1 << 18, "asked-terms")), "counts-of-terms")
    totals, df = counts.where("term IS NULL").select("n", "sized", "length"), counts.where("term IS NOT NULL").select("term", F.col("n").alias("df"))
    if some:
        others = index.rows.join(repeated, same, "left_semi")
        totals = totals.unionByName(others.agg(F.count(F.lit(1)).alias("n"), F.count("length").alias("sized"), F.sum("length").alias("length")))
        # only postings of terms that are asked for are counted and shuffled: where their table is small, the semi-join goes below the aggregate
        postings = index.postings.join(repeated, same, "left_semi").join(asked.select("term").distinct(), "term", "left_semi")
        df = df.unionByName(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n, sized, length = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in totals.columns]).first()
    mean = length / max(1, sized)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(df.groupBy("term").agg(F.sum("df").alias("df")), "term").select("query_id", "n_terms", "term", idf.alias("idf"))
    terms = work.stored(terms, "terms")
    asks = terms.groupBy(F.col("query_id").alias("q")).agg(F.max("n_terms").alias("n_terms"), F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("terms"))  # a query's terms
    files = work.blocks(asks, block, "query-blocks")

    def answers(held: pa.Table, least: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, t = held.column("chunk_id").combine_chunks(), held.column("t").combine_chunks()
        lengths = pc.fill_null(t.value_lengths(), 0).to_numpy(zero_copy_only=False)
        for file in files:
            asking, need, names, weights, of = _asked(file)
            bound = least.setdefault(file, np.zeros(len(asking)))
            row, term, tf = _frequencies(t, names)
            value = weights[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean)))
            width = max(1, CELLS // max(1, len(names)))
            for at in range(0, len(t), width):
                lo, hi = np.searchsorted(row, [at, at + width])
                table = np.zeros((len(names), min(width, len(t) - at)))
                table[term[lo:hi], row[lo:hi] - at] = value[lo:hi]
                found = [[], [], []]
                for q, numbers in enumerate(of):
                    cells = table[numbers]
                    scores = cells.sum(axis=0)  # one term after the other, so that equal chunks have equal scores
                    if match == "all":
                        scores[np.count_nonzero(cells, axis=0) != need[q]] = 0
                    if len(scores) > k:  # whatever reaches the k-th score may be among the k best, ties too
                        bound[q] = max(bound[q], np.partition(scores, -k)[-k])
                    best = np.flatnonzero((scores > 0) & (scores >= bound[q] - SLACK))
                    for column, x in zip(found, (np.full(len(best), q), at + best, scores[best]), strict=True):
                        column.append(x)
                asks, chunks, scores = map(np.concatenate, found)
                if len(asks):
                    yield pa.RecordBatch.from_arrays([asking.take(pa.array(asks)), ids.take(pa.array(chunks)), pa.array(scores)], names=["query_id", "chunk_id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, np.ndarray] = {}
        for held in _runs(batches):
            yield from answers(held, least)

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double"
    hits = rows.select("chunk_id", "t").mapInArrow(scan, kinds)
    if some:
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
        joined = terms.join(postings, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * weight).alias("score"), F.count(F.lit(1)).alias("held"), F.max("n_terms").alias("n_terms"))
        joined = joined.where("held = n_terms") if match == "all" else joined
        hits = hits.unionByName(joined.select("query_id", "chunk_id", "score"))
    hits = hits.withColumn("score", F.round("score", 9))
    return top_n(hits, ["query_id"], ["-score", "chunk_id"], k).select("query_id", "rank", "chunk_id", "score")


def rrf(ranked: Sequence[DataFrame], k: int = 60, top_k: int = 40) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, rank, chunk_id, ...) lists; ties go to the earlier list and rank."""
    # keyed by text, so that lists which are dealt out by query in different ways can be put together
    rows = [
        df.select(F.col("query_id").cast("string").alias("q"), F.col("chunk_id").cast("string").alias("c"), "rank", F.struct(F.lit(i).alias("list"), "rank", "query_id", "chunk_id").alias("at"))
        for i, df in enumerate(ranked)
    ]
    fused = reduce(DataFrame.unionByName, rows).groupBy("q", "c").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min("at").alias("at"))
    fused = fused.select("score", F.col("at.query_id").alias("query_id"), F.col("at.chunk_id").alias("chunk_id"), F.col("at.list").alias("first_list"), F.col("at.rank").alias("first_rank"))
    return top_n(fused, ["query_id"], ["-score", "first_list", "first_rank", "chunk_id"], top_k).select("query_id", "rank", "chunk_id", "score")


#: Ids that go to every task. More are looked up by shuffling the table.
LOOKED_UP = 200_000


def _of_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of some ids. Up to LOOKED_UP ids are sent to the chunks, and no other chunk's text is shuffled by what follows."""
    ids = work.stored(ids.where(F.col("chunk_id").isNotNull()).distinct(), "ids")
    return chunks.join(F.broadcast(ids) if ids.count() <= LOOKED_UP else ids, "chunk_id", "left_semi")


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks."""
    hits = work.stored(hits, "hits")
    return hits.join(_of_ids(chunks, hits.select("chunk_id")), "chunk_id")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.size(F.array_intersect(q, tokens(text))) / F.nullif(F.size(q).cast("double"), F.lit(0.0)), F.lit(0.0))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, k: int = 6, query: str = "text", text: str = "content") -> DataFrame:
    """Hits ordered by a scorer of (query, text), the first k of each query; without a scorer in the order they have."""
    if scorer is None:
        return hits.where(F.col("rank") <= k)
    scored = hits.withColumnRenamed("rank", "first_rank").withColumn("score", scorer(F.col(query), F.col(text)))
    return top_n(scored, ["query_id"], ["-score", "first_rank", "chunk_id"], k).drop("first_rank")


def expand_query(queries: DataFrame, synonyms: DataFrame, text: str = "text") -> DataFrame:
    """Queries with the synonyms of their terms added; without any they stay as they are. synonyms: (term, synonym)."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    more = terms.join(synonyms, "term").groupBy("query_id").agg(F.array_sort(F.collect_set("synonym")).alias("_more"))  # a query has few terms
    out = queries.join(more, "query_id", "left")
    return out.withColumn(text, F.when(F.col("_more").isNull(), F.col(text)).otherwise(F.concat_ws(" ", text, F.array_join("_more", " ")))).drop("_more")


def retrieve(queries: DataFrame, corpus: DataFrame, lexical_only: bool = False, top_k_dense: int = 30, top_k_lexical: int = 30, top_k_fused: int = 40, top_k: int = 6, expand_parents: bool = True, synonyms: DataFrame | None = None, scorer: Callable[[Column, Column], Column] | None = overlap_score, encoder: Encoder | None = None, budget: int = 4000, lexical: str | None = None, vectors=None, probes: int = 8) -> DataFrame:
    """Expansion, dense and lexical search, fusion, re-ranking and parent texts, for (query_id, text) queries.

    corpus: (chunk_id, content, content_with_prefix, and parent_chunk_id where parents are wanted). ``lexical`` is the folder of a stored lexical index of
    the corpus, without which its texts are counted for this call; ``vectors`` a stored vector index, of which each query probes some cells, and without which all vectors are compared.
    """
    from . import lexical_store, vector_index

    asked = queries if synonyms is None else expand_query(queries, synonyms)
    lists = [bm25_top_k(asked, lexical_index(corpus), top_k_lexical) if lexical is None else lexical_store.search(asked, lexical, top_k_lexical)]
    if not lexical_only:
        mine = embed(asked, "text", encoder)
        dense = dense_top_k(mine, embed(corpus, "content", encoder), top_k_dense) if vectors is None else vector_index.search(mine, vectors, top_k_dense, probes)
        lists.insert(0, dense)
    fused = work.stored(rrf(lists, top_k=top_k_fused), "fused")
    hits = rerank(with_chunks(fused.join(queries.select("query_id", "text"), "query_id"), corpus), scorer, top_k)
    if not expand_parents or "parent_chunk_id" not in corpus.columns:
        return hits
    parents = _of_ids(corpus, fused.select("chunk_id")).select(F.col("parent_chunk_id").alias("chunk_id"))
    return put_parents(hits, _of_ids(corpus, parents), budget)
