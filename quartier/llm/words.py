"""Tables of a corpus' distinct words: texts are split in Spark tasks, each distinct word is worked on once, and what comes of it is
stored as sorted hash arrays that later passes over the texts look up.

Texts are split as arrays of code points, many texts at a time. A splitter says where words begin and end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, bytescan, io

#: Bytes of text that are split at once, and distinct words that a task holds before it sends them on.
SLICE = 1 << 20
MOST_HELD = 400_000
SENT = "range int, hash long, word string, times long"


@dataclass
class Split:
    """Words of some texts laid end to end: their code points, spans, hashes, and for each text its first word's number (and the end)."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> str:
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts with a line feed after each, and where each text begins (and the end)."""
    points = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.append(0, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))


def split_of(points: np.ndarray, begins: np.ndarray, start: np.ndarray, end: np.ndarray) -> Split:
    return Split(points, start, end, bytescan.hash_spans(points, start, end), np.searchsorted(start, begins))


def distinct_words(docs: DataFrame, splitter: Callable, ranges: int) -> DataFrame:
    """(range, hash, word, times): the words of docs' texts, once for each task and share of words that a task holds, with their numbers.

    ``splitter()`` is called once in each task and gives a function from texts to a Split.
    """
    io.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        keys, times, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

        def sent() -> pa.RecordBatch:
            columns = [pa.array(arrays.spread(keys, ranges).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(words.tolist(), pa.string()), pa.array(times)]
            return pa.RecordBatch.from_arrays(columns, names=["range", "hash", "word", "times"])

        for batch in batches:
            for part in io.slices(batch, size=SLICE):
                got = split([t or "" for t in part.column("text").to_pylist()])
                new, at, count = np.unique(got.hashes, return_index=True, return_counts=True)
                place, known = arrays.find(keys, new)
                times[place[known]] += count[known]
                if known.all():
                    continue
                fresh = np.array([got.word(i) for i in at[~known].tolist()] + [None], object)[:-1]
                keys, times, words = np.append(keys, new[~known]), np.append(times, count[~known]), np.append(words, fresh)
                order = np.argsort(keys)
                keys, times, words = keys[order], times[order], words[order]
                if len(keys) > MOST_HELD:
                    yield sent()
                    keys, times, words = keys[:0], times[:0], words[:0]
        if len(keys):
            yield sent()
        io.trim()

    return docs.select("text").mapInArrow(run, SENT)


def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct hashes of a range with their word and number, in order; hashes that two different words share are left out."""
    pdf = pdf.groupby(["hash", "word"], sort=False, as_index=False)["times"].sum()
    pdf = pdf[~pdf["hash"].duplicated(keep=False)]
    return pdf.assign(key=pdf["hash"].to_numpy(np.int64).view(np.uint64)).sort_values("key")


@dataclass
class Table:
    """What is stored of each distinct word: a list of numbers. Words that are not there (of hashes that two words share) are worked on again."""

    folder: str
    ranges: int

    def store(self, number: int, keys: np.ndarray, lists: list[np.ndarray]) -> None:
        """Lists of a range's words, whose hashes are in order."""
        flat = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)
        arrays.put(self.folder, f"words-{number}", keys=keys, ends=np.cumsum([len(x) for x in lists], dtype=np.int64), values=flat)

    def lists(self, split: Split, missing: Callable[[str], np.ndarray], held: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The lists of all words of a split, one after the other, and where each text's begin (and the end).

        held are the ranges that have words.
        """
        hashes, at, which = np.unique(split.hashes, return_index=True, return_inverse=True)
        count, begin = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        flat, size, unknown = [], 0, []
        cut = np.searchsorted(arrays.spread(hashes, self.ranges), np.arange(self.ranges + 1))
        for r in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            a, b = cut[r], cut[r + 1]
            place, there = np.zeros(b - a, np.int64), np.zeros(b - a, bool)
            if r in held:
                place, there = arrays.find(arrays.get(self.folder, f"words-{r}", "keys"), hashes[a:b])
                ends = arrays.get(self.folder, f"words-{r}", "ends")
                upto = ends[place]
                low = np.where(place > 0, ends[place - 1], 0)
                n = np.where(there, upto - low, 0)
                source = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                flat.append(arrays.get(self.folder, f"words-{r}", "values")[source])
                begin[a:b], count[a:b] = size + np.cumsum(n) - n, n
                size += int(n.sum())
            unknown += (a + np.flatnonzero(~there)).tolist()
        for i in unknown:
            values = missing(split.word(int(at[i])))
            begin[i], count[i] = size, len(values)
            flat.append(values)
            size += len(values)
        table = np.concatenate([np.zeros(0, np.int32), *flat]).astype(np.int32)
        n, low = count[which], begin[which]
        upto = np.append(0, np.cumsum(n))
        values = table[np.repeat(low - upto[:-1], n) + np.arange(upto[-1])]
        return values, upto[split.first]


def ranges_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(io.tasks(docs.sparkSession), size // 64_000_000)
