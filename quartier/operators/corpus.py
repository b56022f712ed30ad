"""Legal texts to sections, chunks and a searchable corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import uuid5, version_hash
from ..functions.text import contextual_prefix, cross_refs, defined_terms, token_count, words
from ..sources.store import upsert

#: Fixed patterns: a section mark at the start of a line, and a paragraph mark such as (a), (1) or (iv).
SECTION_MARK = r"^(§\s*\d+[.\-]\d+[\w.]*)"
PARAGRAPH_MARK = r"^\s*\(([a-z]|\d+|i{1,3}v?|vi{0,3})\)\s+"
#: Characters of a title, and how a text goes on with its line.
TITLE = 120
SAME_LINE = r"(?U)\A[\s\x1c-\x1f&&[^\n]]*[^\s\x1c-\x1f]"


#: Lines end with a line feed only, and letters, digits and space are those of Unicode.
FLAGS = "(?mdU)"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _after(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern, from the first one on."""
    pieces = F.split(text, pattern, -1)
    return F.slice(pieces, 2, F.size(pieces))


def split_sections(docs: DataFrame, text: str = "text", doc: str = "doc_id", marker: str = SECTION_MARK, whole: str = "§(full)") -> DataFrame:
    """Sections of each text, in order, each followed by its paragraphs; a text without a mark is one section.

    A title is the rest of the first line that has one after the mark, up to 120 characters; the mark's own line may be blank. What is left of a longer line
    begins the content, and as it does not stand at the start of a line, no paragraph begins there. Null texts give no rows.
    """
    mark, paragraph = FLAGS + marker + rf"(?:\s+([^\n]{{0,{TITLE}}}))?", FLAGS + PARAGRAPH_MARK
    found = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(pattern), group)
    none = F.lit(None).cast("string")
    entry = lambda citation, parent, title, content, depth, more: F.struct(
        citation.alias("citation"), parent.alias("parent_citation"), title.alias("title"), content.alias("content"), depth.alias("depth"), more.alias("has_children")
    )

    def with_paragraphs(s: Column) -> Column:
        top, body = F.regexp_replace(s["mark"], " ", ""), s["body"]["text"]
        lines = F.when((F.length(s["title"]) == TITLE) & s["body"]["same_line"], F.concat(F.lit("-"), body)).otherwise(body)
        parts = F.zip_with(found(lines, paragraph, 1), _after(lines, paragraph), lambda label, body: F.struct(label.alias("label"), body.alias("body")))
        below = F.transform(parts, lambda p: entry(F.concat(top, F.lit("("), p["label"], F.lit(")")), top, F.lit(""), _stripped(p["body"]), F.lit(1), F.lit(False)))
        return F.concat(F.array(entry(top, none, _stripped(s["title"]), body, F.lit(0), F.size(parts) > 0)), below)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("_t"))
    bodies = F.transform(_after(F.col("_t"), mark), lambda b: F.struct(_stripped(b).alias("text"), F.rlike(b, F.lit(SAME_LINE)).alias("same_line")))
    marks = F.arrays_zip(found(F.col("_t"), mark, 1).alias("mark"), found(F.col("_t"), mark, 2).alias("title"), bodies.alias("body"))
    rows = rows.withColumn("_m", marks)
    alone = F.array(entry(F.lit(whole), none, F.lit(""), _stripped(F.col("_t")), F.lit(0), F.lit(False)))
    sections = F.when(F.size("_m") == 0, alone).otherwise(F.flatten(F.transform("_m", with_paragraphs)))
    return rows.select("doc_id", F.posexplode(sections).alias("position", "s")).select("doc_id", "position", "s.*")


def _windows(words: Column, size: int, overlap: int) -> Column:
    """Overlapping slices of an array of words; the first one that reaches the end is the last."""
    step = size - overlap
    n = F.when(F.size(words) <= size, F.lit(1)).otherwise(F.ceil((F.size(words) - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))


def chunk_sections(sections: DataFrame, max_tokens: int = 600, overlap: float = 0.12, parent_chars: int = 4000) -> DataFrame:
    """Chunks of sections: paragraphs instead of their section; long ones as overlapping word windows; a long section that
    has paragraphs also as one ``(parent)`` chunk, cut short."""
    size, lap = max(1, int(max_tokens * 0.75)), int(max(1, int(max_tokens * overlap)) * 0.75)
    leaf = sections.where(~F.col("has_children"))
    pieces = F.when(token_count(F.col("content")) <= max_tokens, F.array("content")).otherwise(_windows(words(F.col("content")), size, lap))
    parts = leaf.select("*", F.posexplode(pieces).alias("part", "piece"))
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("(part "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise("")
    keep = ["doc_id", "position"]
    chunks = parts.select(*keep, "part", F.concat("citation", suffix).alias("citation"), "parent_citation", F.col("piece").alias("content"))
    full = F.trim(F.concat_ws("\n", F.concat_ws(" ", "citation", "title"), "content"))
    parents = sections.where("has_children").withColumn("full", full).where(token_count(F.col("full")) > max_tokens)
    parents = parents.select(*keep, F.lit(0).alias("part"), F.concat("citation", F.lit("(parent)")).alias("citation"), F.lit(None).cast("string").alias("parent_citation"), F.substring("full", 1, parent_chars).alias("content"))
    return chunks.unionByName(parents).where(F.trim("content") != "")


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursive(docs: DataFrame, size: int = 1600, overlap: int = 200, separators: Sequence[str] = SEPARATORS, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc_id, part, content): pieces of at most ``size`` characters, cut at the coarsest separator that serves.

    Neighbours share whole pieces of up to ``overlap`` characters.
    """

    def pieces(t: str, seps: Sequence[str]) -> list[str]:
        if len(t) <= size:
            return [t]
        sep = next((s for s in seps if s and s in t), "")
        if not sep:
            return [t[i : i + size] for i in range(0, len(t), size)]
        finer = seps[seps.index(sep) + 1 :]
        parts = t.split(sep)
        parts = [p + (sep if i < len(parts) - 1 else "") for i, p in enumerate(parts)]
        return [q for p in parts for q in pieces(p, finer) if q]

    def merge(parts: list[str]) -> Iterator[str]:
        held: list[str] = []
        for p in parts:
            if held and sum(map(len, held)) + len(p) > size:
                yield "".join(held)
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        if held:
            yield "".join(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["d"], pdf["t"], strict=True):
                cut = [c.strip() for c in merge(pieces(t or "", list(separators)))]
                rows += [(d, i, c) for i, c in enumerate(c for c in cut if c)]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "content"])

    return docs.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(run, "doc_id string, part int, content string")


def build_corpus(docs: DataFrame, authority: str, document: str = "document", text: str = "text", max_tokens: int = 600, overlap: float = 0.12) -> DataFrame:
    """Chunks with id, prefix, hash, token count, defined terms and references, from (document, text) rows."""
    chunks = chunk_sections(split_sections(docs, text, document), max_tokens, overlap)
    out = chunks.select(
        F.col("doc_id").alias("document"), "citation", "parent_citation", F.lit(authority).alias("authority"), F.trim("content").alias("content"), "position", "part"
    )
    out = out.withColumn("version_hash", version_hash(F.col("content")))
    name = F.concat_ws(":", "document", "citation", "version_hash")
    return out.withColumns({
        "chunk_id": uuid5(uuid.NAMESPACE_URL, name),
        "content_with_prefix": contextual_prefix(F.col("authority"), F.col("document"), F.col("citation"), F.col("content")),
        "token_count": token_count(F.col("content")),
        "defined_terms": defined_terms(F.col("content")),
        "cross_refs": cross_refs(F.col("content")),
    })


def link_parents(chunks: DataFrame) -> DataFrame:
    """Adds parent_chunk_id: the chunk of the section that a paragraph's citation begins with, or its ``(parent)`` chunk."""
    top = F.regexp_extract("citation", r"^(§[^(]+)\(", 1)
    keyed = chunks.withColumn("_top", F.when(~F.endswith("citation", F.lit("(parent)")) & (top != ""), top))
    plain = F.regexp_replace("citation", r"\(parent\)$", "")
    parents = chunks.where(~plain.contains("(")).groupBy("document", plain.alias("_top")).agg(F.min("chunk_id").alias("parent_chunk_id"))
    return keyed.join(parents, ["document", "_top"], "left").drop("_top")


def upsert_chunks(target: DataFrame, chunks: DataFrame, key: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """New and changed chunks written over the old; those whose hash is unchanged are left alone."""
    columns = [*key, "version_hash"]
    held = target.select(*[F.col(c).alias(f"_{c}") for c in columns])
    changed = chunks.join(held, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left_anti")
    return upsert(target, changed, list(key))
