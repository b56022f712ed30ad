"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the corpus' distinct pre-tokens.

Pre-tokens are the words between white space, each with the word mark in front. The distinct ones of the whole table are gathered in
Spark and sorted across partitions, which lays their trie out depth first: a task walks its part of it with a stack of
forward scores, and what pre-tokens share with the one before them, a prefix in the trie, is worked out once. The token count of each terminal is
stored in sorted hash arrays in the shared folder. A document's count is the sum over its words, looked up there.

A pre-token's segmentation is the one with the greatest sum of piece scores, and of those the one with fewest pieces. Scores are learned from the
corpus: beginning with a Zipf law over the vocabulary's order, ``ROUNDS`` times the pieces of all best segmentations are counted, and a piece's score becomes the
logarithm of its share, in whole micro-nats, so that ties are exact. A character outside the vocabulary costs one byte piece for each of its UTF-8
bytes, scored below all others.

Nulls and edge cases: a null, empty or blank text has no tokens; very long words take time in proportion to
their length; repeated rows give repeated results; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import io, words

MARK = "▁"
ROUNDS = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def zipf(path: str) -> dict[str, int]:
    """Scores to begin with."""
    held = pieces(path)
    total = math.log(sum(1 / (rank + 1) for rank in range(len(held))))
    return {p: -round(1e6 * (math.log(rank + 1) + total)) for rank, p in enumerate(held)}


class Walk:
    """A walk over the trie of marked words: forward scores, piece counts and last pieces along the current path."""

    def __init__(self, scores: dict[str, int]):
        self.scores, self.byte = scores, min(scores.values()) - 1_000_000
        self.longest = max(map(len, scores))
        self.best, self.count, self.back, self.path = [0], [0], [0], ""

    def to(self, word: str) -> int:
        """Goes to a word's terminal, from what it shares with the path; gives its number of tokens."""
        marked = MARK + word
        shared = 0
        for a, b in zip(marked, self.path, strict=False):
            if a != b:
                break
            shared += 1
        best, count, back, get, longest = self.best, self.count, self.back, self.scores.get, self.longest
        del best[shared + 1 :], count[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(marked) + 1):
            size = len(marked[end - 1].encode("utf-8", "surrogatepass"))
            top, n, last = best[end - 1] + size * self.byte, count[end - 1] + size, -1
            for start in range(max(0, end - longest), end):
                score = get(marked[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or (score == top and count[start] + 1 < n):
                        top, n, last = score, count[start] + 1, start
            best.append(top)
            count.append(n)
            back.append(last)
        self.path = marked
        return count[-1]

    def pieces(self) -> Iterator[str]:
        """The pieces of the current terminal's segmentation, without bytes."""
        end = len(self.path)
        while end:
            start = self.back[end]
            if start >= 0:
                yield self.path[start:end]
            end = start if start >= 0 else end - 1


def splitter() -> Callable:
    blank = np.zeros(0x110000, bool)
    blank[[c for c in range(0x3001) if chr(c).isspace()]] = True

    def split(texts: list[str]) -> words.Split:
        points, begins = words.joined(texts)
        edge = np.flatnonzero(np.diff(~blank[points], prepend=False, append=False))
        return words.split_of(points, begins, edge[::2], edge[1::2])

    return split


def in_trie_order(found: DataFrame) -> DataFrame:
    """Distinct words in one order over all partitions, so that words with a common prefix stand together."""
    return found.repartitionByRange(io.tasks(found.sparkSession), "word").sortWithinPartitions("word")


def learned(found: DataFrame, scores: dict[str, int]) -> dict[str, int]:
    """Scores by the pieces' shares in the best segmentations of the words (word, times) under the scores given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held = Walk(scores), {}
        for batch in batches:
            for word, times in zip(batch.column("word").to_pylist(), batch.column("times").to_pylist(), strict=True):
                walk.to(word)
                for piece in walk.pieces():
                    held[piece] = held.get(piece, 0) + times
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["piece", "times"])

    counts = found.select("word", "times").mapInArrow(run, "piece string, times long").groupBy("piece").agg(F.sum("times").alias("times"))
    seen = {r.piece: r.times for r in counts.collect()}  # a row for each piece of the vocabulary at most
    total = math.log(sum(seen.values()) + len(scores))
    return {p: round(1e6 * (math.log(seen.get(p, 0) + 1) - total)) for p in scores}


def count_tokens(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every document."""
    spark, path = docs.sparkSession, path or default_path()
    table = words.Table(io.shared_folder(spark, "token-counts"), words.ranges_for(docs))
    found = words.distinct_words(docs, splitter, table.ranges).groupBy("range", "hash", "word").agg(F.sum("times").alias("times"))
    found = io.written(in_trie_order(found), "pre-tokens")
    scores = zipf(path)
    for _ in range(rounds):
        scores = learned(found, scores)
    held_scores = spark.sparkContext.broadcast(scores)  # as many as the vocabulary has pieces

    def terminals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(held_scores.value)
        for batch in batches:
            counts = pa.array([walk.to(w) for w in batch.column("word").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("range"), batch.column("hash"), batch.column("word"), counts], names=["range", "hash", "word", "times"])

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        number, pdf = int(pdf["range"].iloc[0]), words.gathered(pdf)
        table.store(number, pdf["key"].to_numpy(), pdf["times"].to_numpy()[:, None].astype(np.int32))
        return pd.DataFrame({"range": [number], "n": [len(pdf)]})

    counted = found.mapInArrow(terminals, words.SENT)
    held = {r["range"] for r in counted.groupBy("range").applyInPandas(store, "range int, n long").collect() if r.n}  # one row for each range

    def run(texts: list, split: Callable) -> dict:
        got = split([t or "" for t in texts])
        values, begins = table.lists(got, lambda w: np.array([Walk(held_scores.value).to(w)], np.int32), held)
        sums = np.append(0, np.cumsum(values, dtype=np.int64))[begins]
        return {"n_pretokens": pa.array(np.diff(got.first)), "n_tokens": pa.array(np.diff(sums))}

    return io.per_text(docs.select("doc_id", "text"), run, "n_pretokens long, n_tokens long", splitter, words.SLICE)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(io.table(spark, sf_dir, "documents"))
