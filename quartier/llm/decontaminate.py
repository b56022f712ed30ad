"""Benchmark decontamination by q-gram lemma filtering.

Texts are reduced to lower-case letters and digits with single spaces between. Each benchmark item is cut into
overlapping units of ``UNIT`` characters, and into units of ``EXCERPT`` characters, one every ``STRIDE``. An excerpt of
``EXCERPT + STRIDE - 1`` characters, 67, so holds a whole unit wherever in the item it begins. An item no longer than ``UNIT`` is one
unit; its shorter excerpts are found where they are verbatim, and do not count as units. A document holds a unit if it has a substring within the edit budget, ``RATE`` of the unit's length. By the q-gram lemma such a substring shares at least m + 1 - q - q * e
q-grams with the unit, on diagonals that lie within e of each other. So shared q-grams are counted in overlapping bands of
diagonals, bands that meet the bound are kept, and those are aligned within the band.

An item of fewer than ``SHORTEST`` characters after the reduction is held where it stands verbatim, from the beginning of a word to the end of one.

The items are handled in blocks of ``BLOCK_CHARS`` characters; a block's index is what each task receives, and
each block is compared with all documents, one block after the other. Documents are never shuffled. Items with equal texts are one in the index.

Nulls and edge cases: null and empty texts hold nothing, and an item without letters or digits is held by nothing; null ids on either side stay null;
rows that are repeated are each reported; long texts are
searched whole; an empty table on either side gives an empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan, io

Q = 8
UNIT = 120
EXCERPT = 60
STRIDE = 8
RATE = 0.08
SHORTEST = 24
BLOCK_CHARS = 4_000_000

_points: np.ndarray | None = None


def reduced(text: str) -> np.ndarray:
    """Code points of the lower-cased letters and digits, one space for each run of anything else, none around."""
    global _points
    if _points is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalnum():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _points = table
    points = _points[np.frombuffer((text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    return points[~(space & np.append(True, space[:-1]))]


def grams(points: np.ndarray) -> np.ndarray:
    """The q-gram that begins at each place: eight codes of eight bits each. Code points may share a code; alignment decides."""
    code = (points % 251).astype(np.uint8)
    two = code[:-1].astype(np.uint16) << 8 | code[1:]
    four = two[:-2].astype(np.uint32) << 16 | two[2:]
    return four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]


class Index:
    """q-grams of units of similar length."""

    def __init__(self, units: list[tuple[int, np.ndarray]]):
        self.items = np.array([item for item, _ in units])
        self.units = [points for _, points in units]
        self.length = np.array([len(u) for u in self.units])
        self.edits = (RATE * self.length).astype(np.int64)
        self.bound = self.length + 1 - Q - Q * self.edits
        self.width = int(self.edits.max()) + 1
        all_grams = np.concatenate([grams(u) for u in self.units])
        unit = np.repeat(np.arange(len(units)), self.length + 1 - Q)
        offset = np.concatenate([np.arange(n + 1 - Q) for n in self.length])
        order = np.argsort(all_grams, kind="stable")
        self.unit, self.offset = unit[order], offset[order]
        self.grams, first = np.unique(all_grams[order], return_index=True)
        self.first = np.append(first, len(order))
        self.bits = max(16, int(np.ceil(np.log2(len(self.grams)))) + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.grams)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, unit, diagonal) of shared q-grams, in stretches dense enough to meet the least bound."""
        at = np.flatnonzero(self.seen[self._slot(g)])
        place = np.searchsorted(self.grams, g[at])
        place[place == len(self.grams)] = 0
        same = self.grams[place] == g[at]
        at, place = at[same], place[same]
        need, span = int(self.bound.min()), int((self.length + self.edits).max())
        if len(at) < need:
            return (np.zeros(0, np.int64),) * 3
        dense = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= span)
        mark = np.zeros(len(at) + 1, np.int64)
        np.add.at(mark, dense, 1)
        np.add.at(mark, dense + need, -1)
        keep = np.cumsum(mark[:-1]) > 0
        at, place = at[keep], place[keep]
        n = self.first[place + 1] - self.first[place]
        entry = np.repeat(self.first[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(at, n)
        return at, self.unit[entry], at - self.offset[entry]

    def regions(self, g: np.ndarray) -> list[tuple[int, int]]:
        """(unit, least diagonal) of the bands that meet their unit's bound, most shared q-grams first."""
        at, unit, diagonal = self.hits(g)
        if not len(at):
            return []
        band = diagonal // self.width
        low = int(band.min()) - 1
        key = unit * (int(band.max()) - low + 2) + band - low
        both = np.concatenate([key, key - 1])  # bands are two widths wide and overlap by one
        found, count = np.unique(both, return_counts=True)
        u = found // (int(band.max()) - low + 2)
        ok = count >= self.bound[u]
        order = np.argsort(-count[ok], kind="stable")
        u, b = u[ok][order], (found % (int(band.max()) - low + 2) + low)[ok][order]
        return list(zip(u.tolist(), (b * self.width).tolist(), strict=True))


def align(unit: np.ndarray, text: np.ndarray, first: int, diagonals: int) -> tuple[int, int]:
    """Least edits between the unit and any substring that keeps to the band of diagonals, and where that ends.

    Diagonal d pairs unit place i with text place i + d; the band holds ``diagonals`` of them from ``first`` on.
    """
    step = np.arange(diagonals)
    cost = np.zeros(diagonals, np.int64)  # the substring may start anywhere
    cost[(first + step < 0) | (first + step > len(text))] = 1 << 20
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i, c in enumerate(unit):
        place = first + step + i
        inside = (place >= 0) & (place < len(text))
        same = inside & (padded[np.clip(place, 0, len(text))] == c)
        new = np.where(inside, cost + ~same, 1 << 20)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(new - step) + step
    best = int(cost.argmin())
    return int(cost[best]), first + best + len(unit)


def _item(text: str | None) -> np.ndarray:
    points = reduced(text or "")
    return points[: len(points) - bool(len(points) and points[-1] == 32)]


def units_of(item: int, text: str | None) -> list[tuple[int, np.ndarray]]:
    points = _item(text)
    if len(points) < SHORTEST:
        return []
    spans = _spans(len(points), UNIT, UNIT // 2)
    if len(points) > UNIT:
        spans += _spans(len(points), EXCERPT, STRIDE)
    return [(item, points[s : s + size]) for s, size in spans]


def excerpts_of(item: int, text: str | None) -> list[tuple[int, np.ndarray]]:
    """The pieces of an item that is one unit, of which a verbatim copy is a hit."""
    points = _item(text)
    return [(item, points[s : s + size]) for s, size in _spans(len(points), EXCERPT, STRIDE)] if EXCERPT < len(points) <= UNIT else []


def _spans(length: int, size: int, stride: int) -> list[tuple[int, int]]:
    """(start, size) of units that begin every ``stride`` characters, and of the one that ends with the item."""
    starts = list(range(0, max(1, length - size + 1), stride))
    if length > size and starts[-1] != length - size:
        starts.append(length - size)
    return [(s, size) for s in starts]


class Finder:
    """Indexes by length class, so that short items don't lower the bound of long ones. Items are known by their place in the list."""

    def __init__(self, items: list[tuple[int | None, str]], short: bool = True):
        self.ids = pa.array([i for i, _ in items], pa.int64())
        alike: dict[str, list[int]] = {}
        for number, (_, text) in enumerate(items):
            alike.setdefault(text, []).append(number)
        self.alike = list(alike.values())
        classes: dict[int, list] = {}
        by_words: dict[int, dict[int, list]] = {}
        for number, text in enumerate(alike):
            for unit in units_of(number, text):
                classes.setdefault(len(unit[1]).bit_length(), []).append(unit)
            points = _item(text)
            if short and 0 < len(points) < SHORTEST:
                by_words.setdefault(int((points == 32).sum()) + 1, {}).setdefault(len(points), []).append((number, points))
        self.indexes = [Index(units) for units in classes.values()]
        excerpts = [unit for number, text in enumerate(alike) for unit in excerpts_of(number, text)]
        self.excerpts = [Index(excerpts)] if excerpts else []
        self.short = by_words  # by numbers of words and characters

    def _short(self, joined: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in texts, item) of the short items."""
        edge = np.flatnonzero(np.diff((joined != 32) & (joined != 0), prepend=False, append=False)) if self.short else np.zeros(0, np.int64)
        for n_words, lengths in self.short.items():
            begin, end = edge[::2][: max(0, len(edge) // 2 - n_words + 1)], edge[1::2][n_words - 1 :]
            for length, items in lengths.items():
                at = begin[end - begin == length]
                if not len(at):
                    continue
                hashes = bytescan.hash_spans(joined, at, at + length)
                for number, points in items:
                    mine = bytescan.hash_spans(points, np.array([0]), np.array([length]))[0]
                    for place in at[hashes == mine].tolist():
                        if (joined[place : place + length] == points).all():
                            yield int(np.searchsorted(starts, place, side="right")) - 1, number

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(position in texts, item, fewest edits, units held), from one scan over all texts joined."""
        gap = np.zeros(UNIT + Q, np.uint32)  # no unit reaches from one text into the next
        parts = [x for t in texts for x in (reduced(t), gap)]
        joined = np.concatenate([gap, *parts]) if parts else gap
        starts = np.cumsum([len(gap), *[len(p) for p in parts]])[:-1:2]
        g = grams(joined)
        found: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        verbatim: set[tuple[int, int]] = set()
        for number, index in enumerate(self.indexes + self.excerpts):
            for u, diagonal in index.regions(g):
                unit, edits, width = index.units[u], int(index.edits[u]), index.width
                middle = diagonal + width + len(unit) // 2
                doc = max(0, int(np.searchsorted(starts, min(max(middle, 0), len(joined)), side="right")) - 1)
                pair, key = (doc, int(index.items[u])), (number, u)
                held = found.setdefault(pair, {})
                if held.get(key) == 0 or (number >= len(self.indexes) and pair in verbatim):
                    continue
                low = max(0, diagonal - edits)
                span = joined[low : diagonal + 2 * width + edits + len(unit)]
                if unit.tobytes() in span.tobytes():
                    if number < len(self.indexes):
                        held[key] = 0
                    else:
                        verbatim.add(pair)
                    continue
                if number >= len(self.indexes):
                    continue
                n, _ = align(unit, span, 0, diagonal + 2 * width + edits - low)
                if n <= edits:
                    held[key] = min(n, held.get(key, n))
        rows = [(doc, item, min(held.values(), default=0), len(held)) for (doc, item), held in found.items() if held or (doc, item) in verbatim]
        rows += [(doc, item, 0, 1) for doc, item in set(self._short(joined, starts))]
        return sorted((doc, same, edits, units) for doc, item, edits, units in rows for same in self.alike[item])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    for number in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, n_units): which document holds which benchmark item, by how many of its units (0: by a verbatim excerpt only).

    More than one block of items are searched for one after the other, and each block's rows are written before the next one is sent out.
    """
    spark = docs.sparkSession
    io.small_batches(spark)
    names = ["doc_id", "item_id", "edits", "n_units"]
    frames: list[DataFrame] = []
    for items in _blocks(benchmark):
        finder = spark.sparkContext.broadcast(Finder(items))  # BLOCK_CHARS characters

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in io.slices(batch, size=1 << 21):
                    found = finder.value.find([t or "" for t in part.column("text").to_pylist()])
                    doc, item, edits, units = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
                    columns = [part.column("doc_id").take(pa.array(doc, pa.int64())), finder.value.ids.take(pa.array(item, pa.int64())), pa.array(edits, pa.int32()), pa.array(units, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            io.trim()

        if frames:
            frames[-1] = io.written(frames[-1], "contaminated")
        frames.append(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits int, n_units int"))
    found = frames[0]
    for more in frames[1:]:
        found = found.unionByName(more)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were; what one block of items leaves is written before the next.

    Unless ``short`` is set, items of fewer than SHORTEST characters are not counted, as ordinary text has their few words too.
    """
    io.small_batches(docs.sparkSession)
    for number, items in enumerate(_blocks(benchmark)):
        if number:
            docs = io.written(docs, "clean")
        finder = docs.sparkSession.sparkContext.broadcast(Finder(items, short))  # BLOCK_CHARS characters
        docs = docs.where(~_holds(finder)("text"))
    return docs


def _holds(finder):  # a broadcast Finder
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts), bool)
            cuts = (texts.str.len().fillna(0).cumsum() // (1 << 21)).to_numpy()
            for cut in np.unique(cuts):
                mine = np.flatnonzero(cuts == cut)
                hit = [doc for doc, *_ in finder.value.find(texts.iloc[mine].fillna("").tolist())]
                out[mine[hit]] = True
            yield pd.Series(out)
        io.trim()

    return holds


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(io.table(spark, sf_dir, "documents"), io.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return clean(docs, io.table(spark, sf_dir, "benchmark"))
