"""BPE encoding and decoding through a table of distinct words.

A tokeniser with a word-splitting pattern encodes every word by itself. Texts are split into words in Spark tasks, the distinct words of
the whole table are gathered by ranges of their hashes, and each is encoded once. The ids are stored as sorted hash arrays in the
shared folder; a second pass over the texts joins them back to the words' positions by looking the words up there. Decoding joins
ids to their pieces, a table as long as the vocabulary, and needs no words.

Splitting follows the vocabulary file: texts are composed (NFC) and lower-cased, and words match ``PATTERN``. The lower case
and class of each character are what the tokeniser itself says of it, asked once for each character that occurs. Words whose
hash another word has are encoded where they stand.

Nulls and edge cases: a null or empty text has no tokens, and decodes to an empty text; texts of any length
are encoded whole, and one text is what a task holds at least; special tokens inside texts become their ids; repeated rows give repeated
results; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import io, words

#: What the vocabulary file says of words; ``split`` below finds the same spans in arrays of code points.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, NUMBER, SPACE, OTHER, SEVERAL = 1, 2, 3, 4, 5


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Splits texts and encodes words. One of these lives in each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normal, self.pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.tokenizer.normalizer = normalizers.Sequence([])  # words come normalised
        specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.special_ids = {word: np.array([i], np.int32) for word, i in specials.items()}
        self.lower = np.zeros(0x110000, np.uint32)
        self.kind = np.zeros(0x110000, np.uint8)  # 0: not asked yet

    def pieces(self) -> list[str]:
        """The piece of each id."""
        held = {i: p for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return [held.get(i, "") for i in range(max(held) + 1)]

    def _ask(self, points: np.ndarray) -> None:
        """Learns from the tokeniser what characters become and what class that has."""
        for c in np.unique(points[self.kind[points] == 0]).tolist():
            low = self.normal.normalize_str(chr(c))
            if len(low) != 1:
                self.kind[c] = SEVERAL
                continue
            self.lower[c] = ord(low)
            said = [len(self.pre.pre_tokenize_str(x)) for x in ("a" + low + "a", "a" + low + low + "a")]
            self.kind[c] = {1: LETTER, 2: SPACE}.get(said[0], NUMBER if said[1] == 4 else OTHER)

    def split(self, texts: list[str]) -> words.Split:
        texts = [t if unicodedata.is_normalized("NFC", t) else self.normal.normalize_str(t) for t in texts]
        points, begins = words.joined(texts)
        self._ask(points)
        if (self.kind[points] == SEVERAL).any():
            texts = [self.normal.normalize_str(t) if (self.kind[points[a:b]] == SEVERAL).any() else t for t, a, b in zip(texts, begins, begins[1:], strict=False)]
            points, begins = words.joined(texts)
            self._ask(points)
        kind, points = self.kind[points], self.lower[points]
        starts = np.ones(len(points), bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        starts &= kind != SPACE
        # an apostrophe by itself takes the letters of a contraction with it
        at = np.flatnonzero((points == ord("'")) & starts)
        at = at[at + 2 < len(points)]
        at = at[kind[at + 1] == LETTER]
        one, two = points[at + 1], points[at + 2]
        pair = np.zeros(len(at), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (one == ord(x)) & (two == ord(y))
        single = np.isin(one, [ord(x) for x in "stmd"])
        for held, size in ((at[single], 2), (at[pair & ~single], 3)):
            starts[held + 1] = False
            after = held + size
            starts[after[kind[after] == LETTER]] = True
        edge = np.flatnonzero(starts | (kind == SPACE))  # the last one is the line feed after the last text
        begin = np.flatnonzero(starts[edge])
        return words.split_of(points, begins, edge[begin], edge[begin + 1])

    def encode_words(self, found: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(found), 20_000):
            out += [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(found[at : at + 20_000], add_special_tokens=False)]
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def build_table(docs: DataFrame, path: str) -> tuple[words.Table, set[int]]:
    """The ids of each distinct word of docs' texts, and which ranges of hashes have words."""
    spark = docs.sparkSession
    table = words.Table(io.shared_folder(spark, "bpe-words"), words.ranges_for(docs))

    def splitter() -> Callable:
        held = encoder(path)

        def split(texts: list[str]) -> words.Split:
            parts = [p for t in texts for p in (held.special.split(t) if held.special and held.special.search(t) else [t])]
            return held.split(parts)

        return split

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        number, pdf = int(pdf["range"].iloc[0]), words.gathered(pdf)
        table.store(number, pdf["key"].to_numpy(), encoder(path).encode_words(pdf["word"].tolist()))
        io.trim()
        return pd.DataFrame({"range": [number], "n": [len(pdf)]})

    stored = words.distinct_words(docs, splitter, table.ranges).groupBy("range").applyInPandas(store, "range int, n long")
    return table, {r["range"] for r in stored.collect() if r.n}  # one row for each range


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs' columns but the text's, and of every document ids (array<int>), n_tokens and ids_sha256, the digest of ids as 32-bit integers."""
    return _encoded(docs, path or default_path(), False)


def _encoded(docs: DataFrame, path: str, keep_text: bool) -> DataFrame:
    table, held = build_table(docs, path)

    def run(texts: list, coder: Encoder) -> dict:
        parts, owner = [], []
        for i, t in enumerate(texts):
            new = coder.special.split(t) if t and coder.special and coder.special.search(t) else [t or ""]
            parts += new
            owner += [i] * len(new)
        ordinary = [p not in coder.special_ids for p in parts]
        values, begins = table.lists(coder.split([p if o else "" for p, o in zip(parts, ordinary, strict=True)]), lambda w: coder.encode_words([w])[0], held)
        if not all(ordinary):  # put the special tokens between the ids of what stands around them
            pieces = [values[a:b] if o else coder.special_ids[p] for p, o, a, b in zip(parts, ordinary, begins, begins[1:], strict=False)]
            values, begins = np.concatenate(pieces), np.append(0, np.cumsum([len(x) for x in pieces]))
        first = np.searchsorted(np.array(owner, np.int64), np.arange(len(texts) + 1))
        begins = begins[first]
        raw = values.astype("<u4")
        digests = [hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)]
        ids = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values, pa.int32()))
        return {"ids": ids, "n_tokens": pa.array(np.diff(begins)), "ids_sha256": pa.array(digests, pa.string())}

    return io.per_text(docs, run, "ids array<int>, n_tokens long, ids_sha256 string", lambda: encoder(path), words.SLICE, keep_text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of ids: their pieces, joined as the tokeniser does where it has no decoder, with a space; null ids give an empty text.

    The pieces, as many as the vocabulary has, are one constant array.
    """
    pieces = encoder(path or default_path()).pieces()
    table = F.split(F.lit("\n".join(pieces)), "\n")
    return F.coalesce(F.array_join(F.transform(ids, lambda i: F.get(table, i)), " "), F.lit(""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with text in place of ids."""
    return encoded.select(*[c for c in encoded.columns if c not in ("ids", "text")], decoded(F.col("ids"), path).alias("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    out = encode(docs.select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(io.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and token ids: ids, n_tokens. Every document is kept."""
    return _encoded(docs.drop("ids", "n_tokens", "ids_sha256"), default_path(), True).drop("ids_sha256")
