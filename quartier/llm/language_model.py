"""Interpolated modified Kneser-Ney scoring with an n-gram model of any order that is counted in Spark.

Each step of counting is a shuffle of pre-counted messages: tokens, then bigrams of token numbers, then longer n-grams, each keyed by the
number of its context (the n-gram without its last token) and the last token's number; then, from the longest down, what the n-grams say
of those that are one token shorter (their continuations, and as contexts the followers by count). N-grams below the highest order count
distinct tokens before them, or occurrences if they begin a text. Keys are dealt by hash ranges, and a task sends each distinct
key once, so a word that is a third of all tokens is no heavier than others. Each range becomes sorted hash arrays in
files of the shared folder, which workers map into memory; only totals reach the driver. Where that folder is a store that is not
mounted, workers read the arrays of a few ranges at a time instead.

Token numbers are positions in the sorted array of token hashes, n-gram numbers those in the arrays of their ranges; hashes have 64 bits. Contexts that training has not seen back off to the
next shorter context, and unseen tokens share the uniform part.

Nulls and edge cases: a null text counts as empty, which has one token, the end; a null id is trained on and not held out; without training rows every
probability is uniform; texts of any length are read whole; repeated rows are counted and scored each; an
empty table gives an empty result; other columns are not read. More than 2**32 - 1 distinct tokens, or contexts of a length, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan, io
from .arrays import find, get, put, spread

END = np.uint64(0x5EED_0E4D_0F7E_C57F)
START = np.uint64(2**32 - 1)
LOW = np.uint64(2**32 - 1)
MESSAGE = "range int, keys binary, counts binary"
FLUSH = 1 << 22


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit, else in 64."""
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64)


def messages(keys: list[np.ndarray], counts: list[np.ndarray] | None, ranges: int, mixed: bool) -> pd.DataFrame:
    """Counted keys, one row for each range. ``mixed`` spreads by a hash of the key instead of the key."""
    keys = np.concatenate([np.zeros(0, np.uint64), *keys])
    keys, count = np.unique(keys, return_counts=True)
    place = spread(bytescan.mix(keys) if mixed else keys, ranges)
    order = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[order], np.arange(ranges + 1))
    rows = [(r, keys[order[a:b]].tobytes(), narrow(count[order[a:b]]).tobytes()) for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
    return pd.DataFrame(rows, columns=["range", "keys", "counts"])


def summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of some messages and their total counts."""
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in pdf["keys"]])
    # counts have half the keys' bytes, or as many
    counts = np.concatenate([np.frombuffer(c, np.uint32 if 2 * len(c) == len(k) else np.uint64).astype(np.int64) for k, c in zip(pdf["keys"], pdf["counts"], strict=True)])
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, _sums(inverse, counts, len(keys))


def token_hashes(text: str | None) -> np.ndarray:
    return np.append(bytescan.word_hashes((text or "").encode("utf-8", "surrogatepass")), END)


def _sums(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, place, values)
    return out


def discounts(n: list[int]) -> list[float]:
    """Discounts for counts of one, two, and three or more, from the numbers of keys with counts 1 to 4."""
    if not all(n):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


@dataclass
class Model:
    """Totals of a model and the folder of its arrays."""

    folder: str
    token_ranges: int
    gram_ranges: int
    order: int = 2
    offsets: dict[int, np.ndarray] = field(default_factory=lambda: {1: np.zeros(1, np.int64)})  # by n, of each range's first number
    tokens: int = 0
    texts: int = 0
    bigram_types: int = 0
    start: tuple[int, int, int] = (0, 0, 0)  # bigrams after the start, by count 1, 2, 3 or more
    d: dict[int, list[float]] = field(default_factory=dict)  # by n
    d_low: list[float] = field(default_factory=lambda: [0.5] * 3)
    low_types: tuple[int, int, int] = (0, 0, 0)  # tokens with continuation count 1, 2, 3 or more

    @property
    def distinct(self) -> int:
        return int(self.offsets[1][-1])

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct hashes: token numbers, training counts (0 if unknown), and whether known."""
        number, count, known = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        cut = np.searchsorted(spread(hashes, self.token_ranges), np.arange(self.token_ranges + 1))
        for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if b > a and self.offsets[1][r + 1] > self.offsets[1][r]:
                place, known[a:b] = find(get(self.folder, f"grams1-{r}", "keys"), hashes[a:b])
                number[a:b] = place + self.offsets[1][r]
                count[a:b] = np.where(known[a:b], get(self.folder, f"grams1-{r}", "counts")[place], 0)
        return number, count, known

    def grams(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct n-grams of two tokens or more, and which are known."""
        number, known = np.zeros(len(keys), np.uint64), np.zeros(len(keys), bool)
        place = spread(bytescan.mix(keys), self.gram_ranges)
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.arange(self.gram_ranges + 1))
        for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if b > a and n in self.offsets and self.offsets[n][r + 1] > self.offsets[n][r]:
                at, known[order[a:b]] = find(get(self.folder, f"grams{n}-{r}", "keys"), keys[order[a:b]])
                number[order[a:b]] = at + self.offsets[n][r]
        return number, known

    def rows(self, n: int, key: str, numbers: np.ndarray) -> np.ndarray:
        """Entries of a stored array for n-gram numbers, of which there is one at least."""
        held, inverse = np.unique(numbers.astype(np.int64), return_inverse=True)
        cut = np.searchsorted(held, self.offsets[n])
        return np.concatenate([get(self.folder, f"grams{n}-{r}", key)[held[a:b] - self.offsets[n][r]] for r, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a])[inverse]

    def suffixes(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams without their first token."""
        if n == 2:
            return keys & LOW
        context = keys >> np.uint64(32)
        before = self.rows(2, "keys", context) & LOW if n == 3 else self.rows(n - 1, "suffixes", context).astype(np.uint64)
        keys, inverse = np.unique(before << np.uint64(32) | keys & LOW, return_inverse=True)
        return self.grams(n - 1, keys)[0][inverse]

    def counts(self, n: int, numbers: np.ndarray) -> np.ndarray:
        """Occurrences at the highest order; below it continuations, or occurrences at the start of texts."""
        counts = self.rows(n, "counts", numbers).astype(np.int64)
        if n == self.order:
            return counts
        continued = self.rows(n, "facts", numbers)[:, 0].astype(np.int64)
        return np.where(continued > 0, continued, counts)

    def score(self, texts: list) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text, in log10."""
        each = [token_hashes(t) for t in texts]
        lengths = np.array([len(h) for h in each])
        first = np.cumsum(lengths) - lengths
        hashes, place = np.unique(np.concatenate(each), return_inverse=True)
        number, count, known = self.numbers(hashes)
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))
        facts = np.zeros((len(hashes), 5), np.int64)
        if known.any():
            facts[known] = self.rows(1, "facts", number[known])
        # lower order: continuation counts, interpolated with the uniform distribution
        low = np.full(len(hashes), 1 / (self.distinct + 1))
        if self.bigram_types:
            rest = sum(d * n for d, n in zip(self.d_low, self.low_types, strict=True)) / self.bigram_types
            low = np.maximum(facts[:, 0] - _discount(self.d_low, facts[:, 0]), 0) / self.bigram_types + rest * low
        p, last = low[place], number[place]
        # contexts: the token before, or the start
        before = np.append(0, place[:-1])
        context, seen = number[before], known[before].copy()
        total, by_count = (count if self.order == 2 else facts[:, 4])[before], facts[before, 1:4]
        context[first], seen[first], total[first], by_count[first] = START, self.texts > 0, self.texts, self.start
        for n in range(2, self.order + 1):
            if n > 2:  # the n-gram before, one token longer than the last context
                context, seen = np.append(np.uint64(0), gram[:-1]), np.append(False, found[:-1])
                seen[first] = False
                total, by_count = np.zeros(len(place), np.int64), np.zeros((len(place), 3), np.int64)
                if seen.any():
                    held = self.rows(n - 1, "facts", context[seen]).astype(np.int64)
                    by_count[seen] = held[:, 1:4]
                    total[seen] = self.rows(n - 1, "counts", context[seen]) if n == self.order else held[:, 4]
            use = seen & (total > 0) & (by_count.sum(axis=1) > 0)
            back_off = np.where(use, by_count @ np.array(self.d.get(n, [0.5] * 3)) / np.maximum(total, 1), 1.0)
            sought = use & known[place]
            keys, inverse = np.unique((context << np.uint64(32) | last)[sought], return_inverse=True)
            held, there = self.grams(n, keys)
            gram, found, c = np.zeros(len(place), np.uint64), np.zeros(len(place), bool), np.zeros(len(place), np.int64)
            gram[sought], found[sought] = held[inverse], there[inverse]
            if found.any():
                c[found] = self.counts(n, gram[found])
            p = np.where(use, np.maximum(c - _discount(self.d.get(n, [0.5] * 3), c), 0) / np.maximum(total, 1), 0) + back_off * p
        sums = [np.add.reduceat(x, first) for x in (known[place].astype(np.int64), base[place], np.log10(p))]
        return list(zip(lengths.tolist(), *[s.tolist() for s in sums], strict=True))


def _discount(d: list[float], count: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def _token_groups(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """Token hashes of documents, in groups of some millions."""
    group, size = [], 0
    for pdf in batches:
        for text in pdf["text"]:
            group.append(token_hashes(text))
            size += len(group[-1])
            if size >= FLUSH:
                yield group
                group, size = [], 0
    if group:
        yield group


def train(docs: DataFrame, folder: str, order: int = 2) -> Model:
    """Counts a model of n-grams up to ``order`` tokens, two at least, over docs' texts and stores it below the shared folder."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    rows = docs.select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = io.tasks(spark)
    model = Model(folder, max(tasks, size // 64_000_000), max(tasks, size // 32_000_000), order)
    ranges, gram_ranges = model.token_ranges, model.gram_ranges

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _token_groups(batches):
            yield messages(group, None, ranges, mixed=False)

    def store_tokens(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["range"].iloc[0])
        keys, counts = summed(pdf)
        put(folder, f"grams1-{r}", keys=keys, counts=counts)
        at, known = find(keys, np.array([END]))
        return pd.DataFrame({"range": [r], "n": [len(keys)], "total": [counts.sum()], "texts": [int(counts[at[0]]) if known[0] else 0]})

    stored = rows.mapInPandas(tokens, MESSAGE).groupBy("range").applyInPandas(store_tokens, "range int, n long, total long, texts long").collect()
    lengths = np.zeros(ranges, np.int64)
    for r in stored:  # one row for each range
        lengths[r["range"]] = r.n
    model.offsets[1] = np.append(0, np.cumsum(lengths))
    model.tokens, model.texts = sum(r.total for r in stored), sum(r.texts for r in stored)
    if not stored:
        return model
    if model.distinct >= int(START):
        raise ValueError("token numbers have 32 bits")

    for n in range(2, order + 1):

        def count(batches: Iterator[pd.DataFrame], n=n) -> Iterator[pd.DataFrame]:
            for group in _token_groups(batches):
                hashes, place = np.unique(np.concatenate(group), return_inverse=True)
                last = model.numbers(hashes)[0][place]
                lengths = np.array([len(g) for g in group])
                first = np.cumsum(lengths) - lengths
                context, whole = np.append(START, last[:-1]), np.ones(len(last), bool)
                context[first] = START
                for shorter in range(2, n):
                    keys, inverse = np.unique((context << np.uint64(32) | last)[whole], return_inverse=True)
                    gram = np.zeros(len(last), np.uint64)
                    gram[whole] = model.grams(shorter, keys)[0][inverse]
                    context, whole = np.append(np.uint64(0), gram[:-1]), np.append(False, whole[:-1])
                    whole[first] = False
                yield messages([(context << np.uint64(32) | last)[whole]], None, gram_ranges, mixed=True)

        def store(pdf: pd.DataFrame) -> pd.DataFrame:
            r = int(pdf["range"].iloc[0])
            keys, counts = summed(pdf)
            put(folder, f"grams{n}-{r}", keys=keys, counts=narrow(counts))
            if 2 < n < order:
                put(folder, f"grams{n}-{r}", suffixes=model.suffixes(n, keys).astype(np.uint32))
            return pd.DataFrame({"range": [r], "n": [len(keys)]})

        lengths = np.zeros(gram_ranges, np.int64)
        for r in rows.mapInPandas(count, MESSAGE).groupBy("range").applyInPandas(store, "range int, n long").collect():
            lengths[r["range"]] = r.n
        model.offsets[n] = np.append(0, np.cumsum(lengths))
        if n < order and model.offsets[n][-1] >= int(START):
            raise ValueError("numbers of contexts have 32 bits")

    for n in range(order, 1, -1):
        _facts(spark, model, n)
    return model


def _facts(spark: SparkSession, model: Model, n: int) -> None:
    """Stores what the n-grams say of those that are one token shorter."""
    folder, order, above, below = model.folder, model.order, model.offsets[n], model.offsets[n - 1]

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (int(i) for pdf in batches for i in pdf["id"]):
            out = []
            if r == 0:  # every range gets a message
                out += [(t, np.array([a * 5], np.uint64).tobytes(), np.zeros(1, np.uint32).tobytes(), None) for t, (a, b) in enumerate(zip(below, below[1:], strict=False)) if b > a]
            if above[r + 1] > above[r]:
                name = f"grams{n}-{r}"
                keys = np.array(get(folder, name, "keys"))
                counts = model.counts(n, np.arange(above[r], above[r + 1]))
                suffixes = get(folder, name, "suffixes").astype(np.uint64) if 2 < n < order else model.suffixes(n, keys)
                context = keys >> np.uint64(32)
                inner = context != START if n == 2 else np.ones(len(keys), bool)
                kind = np.minimum(counts, 3).astype(np.uint64)
                # a fact is the number of a shorter n-gram and which of its five figures it adds to
                five = np.uint64(5)
                facts, times = np.unique(np.concatenate([suffixes * five, context[inner] * five + kind[inner]]), return_counts=True)
                if n < order:  # at the highest order the context's own count is the total
                    totals, inverse = np.unique(context[inner] * five + np.uint64(4), return_inverse=True)
                    facts, times = np.append(facts, totals), np.append(times, _sums(inverse, counts[inner], len(totals)))
                    sort = np.argsort(facts, kind="stable")
                    facts, times = facts[sort], times[sort]
                cut = np.searchsorted(facts, below.astype(np.uint64) * five)
                out += [(t, facts[a:b].tobytes(), narrow(times[a:b]).tobytes(), None) for t, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
                of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
                begun = [int((kind[~inner] == k).sum()) for k in (1, 2, 3)]
                out.append((-1, None, None, [len(keys), *of, *begun]))
            yield pd.DataFrame(out, columns=["range", "keys", "counts", "totals"])

    told = spark.range(0, model.gram_ranges, 1, model.gram_ranges).mapInPandas(tell, MESSAGE + ", totals array<long>")
    told = io.written(told, "facts")
    found = [r.totals for r in told.where("range = -1").select("totals").collect()]
    totals = np.sum(found, axis=0).tolist() if found else [0] * 8
    model.d[n] = discounts(totals[1:5])
    if n == 2:
        model.bigram_types, model.start = totals[0], tuple(totals[5:8])

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["range"].iloc[0])
        keys, counts = summed(pdf)
        figures = np.zeros((int(below[r + 1] - below[r]), 5), narrow(counts).dtype)
        figures[(keys // np.uint64(5)).astype(np.int64) - below[r], (keys % np.uint64(5)).astype(np.int64)] = counts
        put(folder, f"grams{n - 1}-{r}", facts=figures)
        low = figures[:, 0]
        return pd.DataFrame({"n": [[int((low == k).sum()) for k in (1, 2, 3, 4)] + [int((low >= 3).sum())]]})

    low = np.sum([r.n for r in told.where("range >= 0").groupBy("range").applyInPandas(store, "n array<long>").collect()], axis=0).tolist()
    if n == 2:
        model.d_low, model.low_types = discounts(low[:4]), (low[0], low[1], low[4])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""

    def run(texts: list) -> dict:
        columns = zip(*model.score(texts), strict=True)
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        out = {name: pa.array(list(c), kind) for (name, kind), c in zip(kinds.items(), columns, strict=True)}
        return out | {"train_tokens": pa.array([model.tokens] * len(texts), pa.int64())}

    return io.per_text(docs.select("doc_id", "text"), run, "n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scored(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    docs = io.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(io.crc_mod("doc_id", 5) == 1, F.lit(False))
    model = train(docs.where(~held), io.shared_folder(spark, "language-model"), order)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity")
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 2)


def op10_lm_scoring_order_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 3)
