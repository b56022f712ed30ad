"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of labelled text. A document is parsed against each
automaton into longest matches: a phrase goes on as long as the automaton has it, and the next phrase begins
where it ends. Few long phrases mean that the text looks like the language's sample; the language that needs
fewest phrases a character wins.

Text is lower-cased; runs of anything but letters become one space. A document is parsed whole, cut
into pieces of ``PIECE`` characters that advance together, one step at a time; a phrase that crosses a cut counts twice, for every language alike.

The sample is bounded: of each language, one row of each of ``SAMPLE_ROWS`` hash buckets, the one with the smallest id hash among texts of at most
``WHOLE`` characters (where a bucket has none, its shortest), and of these, in the order of their hashes, all that fit whole into ``SAMPLE_CHARS`` letters and
spaces. Rows are learned from as a whole or not at all; only of a language that has no text within ``SAMPLE_CHARS``, equal shares of the rows are taken.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label are
not learned from; a null id is not held out; ties go to the first language by name; without any labelled text all is ``und``; repeated
rows get equal predictions; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import io

SAMPLE_ROWS = 64
SAMPLE_CHARS = 48_000
WHOLE = 3_000
PIECE = 1024


def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_table: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one space for each run of other characters, and around."""
    global _table
    if _table is None:
        _table = _letters()
    points = _table[np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = points == 32
    return points[~(space & np.append(space[1:], False))]


class SuffixAutomaton:
    """All substrings of one string of small integer codes.

    The states' rows of steps lie over each other in one array, shifted so that no two steps share a slot. A step of a
    state by a code is in slot ``base[state] + code`` if ``owner`` of that slot is the state.
    """

    def __init__(self, codes: np.ndarray, width: int):
        step, link, length = [{}], [-1], [0]
        last = 0
        for c in codes.tolist():
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        # the start state is 0 and no step leads back to it, so 0 can stand for "none"
        rows = [sorted(edges) for edges in step]
        self.base = np.zeros(len(step), np.int32)
        taken, low = bytearray(3 * width), width
        for state in sorted((s for s, row in enumerate(rows) if len(row) > 1), key=lambda s: -len(rows[s])):
            shifts, at, tries = [c - rows[state][0] for c in rows[state][1:]], taken.find(0, low), 0
            while any(taken[at + shift] for shift in shifts):
                at, tries = taken.find(0, at + 1), tries + 1
            low = at if tries > 16 else low  # states with one step fill what is left free
            for shift in (0, *shifts):
                taken[at + shift] = 1
            self.base[state] = at - rows[state][0]
            taken.extend(bytes(max(0, at + 3 * width - len(taken))))
        single = np.array([s for s, row in enumerate(rows) if len(row) == 1], np.int64)
        taken.extend(bytes(len(single) + width))
        free = width + np.flatnonzero(np.frombuffer(taken, np.uint8)[width:] == 0)[: len(single)]
        self.base[single] = free - np.array([rows[s][0] for s in single], np.int64)
        size = width + 1 + int(max(self.base[s] + row[-1] for s, row in enumerate(rows) if row)) if len(codes) else width
        self.owner, self.to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for state, edges in enumerate(step):
            for c, to in edges.items():
                self.owner[self.base[state] + c], self.to[self.base[state] + c] = state, to
        self.start = self.step(np.zeros(width, np.int32), np.arange(width))

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states that the codes lead to; 0 is "no such step"."""
        slot = self.base[state] + codes.astype(np.int32)
        return np.where(self.owner[slot] == state, self.to[slot], 0)


def shared(texts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The beginnings of texts, equally long but for texts that are shorter, with ``size`` entries in all at most."""
    left, share = size, 0
    for i, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - i)
        if n > share:
            break
        left -= n
        share = n
    return [t[:share] for t in texts]


class Model:
    """Suffix automata of several languages over one alphabet."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = {lang: np.concatenate(shared([letters(t) for t in samples[lang]], SAMPLE_CHARS)) for lang in self.languages}
        kept = np.unique(np.concatenate([*texts.values(), np.array([32], np.uint32)]))
        self.width = len(kept) + 2  # code 0 pads, and the last one is for letters that no sample holds
        self.code = np.full(0x110000, len(kept) + 1, np.min_scalar_type(self.width))
        self.code[kept] = np.arange(1, len(kept) + 1)
        self.automata = [SuffixAutomaton(self.code[texts[lang]], self.width) for lang in self.languages]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and the number of letters of each text."""
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        n_letters = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            points = letters(text)
            n_letters[i] = np.count_nonzero(points != 32)
            if n_letters[i]:
                codes = self.code[points]
                pieces += [codes[at : at + PIECE] for at in range(0, len(codes), PIECE)]
                owner += [i] * -(-len(codes) // PIECE)
        if not pieces:
            return counts, n_letters
        order = sorted(range(len(pieces)), key=lambda j: -len(pieces[j]))
        lengths = np.array([len(pieces[j]) for j in order])
        matrix = np.zeros((int(lengths[0]), len(pieces)), self.code.dtype)
        for column, j in enumerate(order):
            matrix[: len(pieces[j]), column] = pieces[j]
        live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        owners = np.array(owner)[order]
        for k, automaton in enumerate(self.automata):
            state = np.zeros(len(pieces), np.int32)
            made = np.ones(len(pieces), np.int64)
            for t, n in enumerate(live):
                c = matrix[t, :n]
                to = automaton.step(state[:n], c)
                ended = np.flatnonzero((to == 0) & (state[:n] != 0))  # the phrase ends before this letter
                made[ended] += 1
                to[ended] = automaton.start[c[ended]]
                alone = np.flatnonzero(to == 0)  # a letter the sample lacks is a phrase by itself
                made[alone] += 1
                state[:n] = to
            counts[:, k] = np.bincount(owners, weights=made, minlength=len(texts))
        return counts, n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text, and how far it is ahead of the next one, from 0 to 1."""
        counts, n_letters = self.phrases(texts)
        best = counts.argmin(axis=1)
        ranked = np.sort(counts, axis=1)
        score = np.ones(len(texts)) if counts.shape[1] == 1 else 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1)
        score[n_letters == 0] = 0
        return [self.languages[b] if n else "und" for b, n in zip(best, n_letters, strict=True)], score


def whole(texts: list[str], size: int) -> list[str]:
    """In their order the texts that fit whole into ``size`` letters and spaces; all of them where not even one does."""
    kept = []
    for text in texts:
        n = len(letters(text))
        if n <= size:
            kept.append(text)
            size -= n
    return kept if any((letters(t) != 32).any() for t in kept) else texts


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """The bounded sample to learn from, of rows (doc_id, text, lang).

    The rows are chosen by language and hash bucket on ids and lengths alone; then only those rows' texts are read.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    rows = rows.withColumn("over", F.greatest(F.length("text") - WHOLE, F.lit(0)))
    least = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_ROWS)).alias("bucket")).agg(F.min(F.struct("over", "h")).alias("least"))
    hashes = [r.h for r in least.select("least.h").distinct().collect()]  # SAMPLE_ROWS a language at most
    if not hashes:
        return {}
    # of rows that repeat an id one, whatever their number; letters and spaces only, and what is longer than a sample is cut where it is longer
    asked = rows.where(F.col("h").isin(hashes)).groupBy("lang", "h").agg(F.min_by("text", F.struct("over", F.xxhash64("text"), F.length("text"))).alias("text"))
    body = F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, SAMPLE_CHARS + 1).alias("text")
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in asked.select("lang", "h", body).collect():
        texts.setdefault(r.lang, []).append((r.h, r.text))
    found = {lang: whole([t for _, t in sorted(held)], SAMPLE_CHARS) for lang, held in texts.items()}
    return {lang: held for lang, held in found.items() if any((letters(t) != 32).any() for t in held)}


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added. Only the text is used to predict."""
    spark = docs.sparkSession
    io.small_batches(spark)
    samples = sample(labelled)
    docs = docs.drop("lang_pred", "score")
    if not samples:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    model = spark.sparkContext.broadcast(Model(samples))  # bounded by SAMPLE_CHARS a language

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            cuts = (texts.str.len().fillna(0).cumsum() // (1 << 21)).to_numpy()
            for cut in np.unique(cuts):
                langs, score = model.value.predict(texts[cuts == cut].fillna("").tolist())
                out.append(pd.DataFrame({"lang_pred": langs, "score": score}))
            io.trim()
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": []})

    found = io.free_name(docs, "_p")
    return docs.withColumn(found, predict(text)).select(*docs.columns, f"{found}.lang_pred", f"{found}.score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(io.crc_mod("doc_id", 4) == 2, F.lit(False))
    docs = io.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text is of a language that the corpus has labels for."""
    # a document travels as one struct, so that its columns keep names and values whatever they are called
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    found = identify(rows, docs.where(F.coalesce(io.crc_mod("doc_id", 4) != 2, F.lit(True))))
    return found.where(F.col("lang_pred") != "und").select("doc.*")
