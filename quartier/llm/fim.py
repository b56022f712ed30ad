"""Fill-in-middle transformation with a piecewise-linear learned rank index over the line boundaries of a text.

``line_index`` looks at a text once. The offsets of all its boundaries (0, and the end of each line, in code points) are the values of
a function of their rank; greedy straight segments follow it within ``ERROR`` code points. A segment keeps its first rank, the offset there and
a slope in fixed-point units, and each boundary keeps the difference between its offset and the segment's prediction, which fits one
byte. The index is a column: written with the documents, it serves any number of later cuts (other seeds, other rates, one for each epoch)
without a look at the texts for line ends. ``cut`` predicts the offset of a rank from its segment and corrects it by the stored
residual; all of it is whole-number arithmetic in SQL, so cuts are exact. Everything after the index is SQL as well.

Nulls and edge cases: a null text is an empty one; an empty text has no line, stays as it is and its form is plain, as does a text that holds one of the three
marks; a text without a line end is one line; a null id is drawn for as an empty one; rows with equal ids have equal draws and each
row is transformed by itself; columns that an operation adds replace those of the same name, others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import io

#: Code points by which a segment may miss a boundary, and what a residual of one byte leaves for rounding.
ERROR = 120
#: Binary places of a slope, and the ranks of a segment, for which rounding stays below one code point.
PLACES = 20
LONGEST = 1 << PLACES

INDEX = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in (("first", T.IntegerType()), ("base", T.LongType()), ("slope", T.LongType()), ("residual", T.ByteType()))])
MARKS = ("<P>", "<S>", "<M>")


def fit(offsets: np.ndarray) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """First ranks, offsets there and slopes of the segments of rising offsets, and the residual of every offset.

    A segment grows as long as one slope passes within ERROR of all its offsets.
    """
    first, base, slope = [], [], []
    residual = np.empty(len(offsets), np.int8)
    at, n = 0, len(offsets)
    while at < n:
        step, most, chosen = 32, min(n - at - 1, LONGEST), 0.0
        while most:
            rank = np.arange(1, min(step, most) + 1)
            rise = offsets[at + 1 : at + 1 + len(rank)] - offsets[at]
            low, high = np.maximum.accumulate((rise - ERROR) / rank), np.minimum.accumulate((rise + ERROR) / rank)
            apart = np.flatnonzero(low > high)
            if len(apart) or len(rank) == most:
                most = int(apart[0]) if len(apart) else most
                chosen = (low[most - 1] + high[most - 1]) / 2
                break
            step *= 4
        fixed = round(chosen * (1 << PLACES))
        first.append(at)
        base.append(int(offsets[at]))
        slope.append(fixed)
        ranks = np.arange(most + 1, dtype=np.int64)
        residual[at : at + most + 1] = offsets[at : at + most + 1] - (offsets[at] + (ranks * fixed >> PLACES))
        at += most + 1
    return first, base, slope, residual


def _boundaries(texts: pa.Array) -> list[np.ndarray]:
    """The offsets of each text's boundaries, in code points, from 0."""
    texts = pc.fill_null(texts, "")
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.zeros(0, np.uint8)
    starts = starts - starts[0]
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    ends = np.flatnonzero(data == 10) + 1
    open_end = starts[1:][(starts[1:] > starts[:-1]) & (data[np.maximum(starts[1:], 1) - 1] != 10)] if len(data) else starts[:0]
    # the end of one text is where the next one starts: an end belongs to the first text that reaches it
    counts = np.bincount(np.searchsorted(starts[1:], np.concatenate([ends, open_end]), side="left"), minlength=len(texts))
    flat = np.sort(np.concatenate([ends, open_end]))
    found, at = [], 0
    for t, n in enumerate(counts.tolist()):
        found.append(np.concatenate([[0], points[flat[at : at + n]] - points[starts[t]]]))
        at += n
    return found


def _indexed(texts: pa.Array) -> pa.Array:
    parts = [fit(b) for b in _boundaries(texts)]

    def lists(k: int, kind: pa.DataType) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(p[k]) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.asarray(p[k], np.int64) for p in parts]) if parts else [], kind))

    return pa.StructArray.from_arrays([lists(0, pa.int32()), lists(1, pa.int64()), lists(2, pa.int64()), lists(3, pa.int8())], names=INDEX.fieldNames())


def line_index(docs: DataFrame, text: str = "text", index: str = "line_index") -> DataFrame:
    """docs with the learned rank index of each text's line boundaries as one more column."""
    io.small_batches(docs.sparkSession)
    docs = docs.drop(index)
    schema = T.StructType([*docs.schema.fields, T.StructField(index, INDEX)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in io.slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, _indexed(part.column(text))], names=schema.fieldNames())
        io.trim()

    return docs.mapInArrow(run, schema)


def lines(index: str | Column = "line_index") -> Column:
    """How many lines an indexed text has."""
    index = F.col(index) if isinstance(index, str) else index
    return F.size(index["residual"]).cast("long") - 1


def cut(rank: Column, index: str | Column = "line_index") -> Column:
    """The offset in code points at which the line of a rank begins, or the text ends: prediction plus residual."""
    index = F.col(index) if isinstance(index, str) else index
    segment = F.size(F.filter(index["first"], lambda f: f <= rank))
    at = lambda name, place: F.element_at(index[name], place)
    predicted = at("base", segment) + F.shiftright(at("slope", segment) * (rank - at("first", segment)), PLACES)
    return predicted + at("residual", rank.cast("int") + 1)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with ``n`` (lines), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and the transformed text as ``output``.

    Two ranks are drawn from the sha256 of seed and key; lines up to the smaller are the prefix, up to the larger the middle. ``rate`` of a hundred texts are
    transformed, ``spm`` of a hundred of those with the suffix first. A column ``line_index`` is used if docs have it, else it is made.
    """
    if "line_index" not in docs.columns or docs.schema["line_index"].dataType != INDEX:
        docs = line_index(docs)
    prefix, suffix, middle = (F.lit(m) for m in marks)
    text, n = F.coalesce("text", F.lit("")), lines()
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    drawn = F.transform(F.array(*[F.lit(8 * i + 1) for i in range(4)]), lambda p: F.conv(F.substring(hashed, p, F.lit(8)), 16, 10).cast("long"))
    h = lambda i: F.col("_fim.drawn")[i]
    held = docs.withColumn("_fim", F.struct(drawn.alias("drawn"), n.alias("n")))
    ranks = [h(i) % (F.col("_fim.n") + 1) for i in (0, 1)]
    plain = (F.length(text) == 0) | F.contains(text, prefix) | F.contains(text, suffix) | F.contains(text, middle) | (h(2) % 100 >= rate)
    form = F.when(plain, "plain").when(h(3) % 100 < spm, "spm").otherwise("psm")
    held = held.withColumn("_fim", F.struct("_fim.n", form.alias("form"), cut(F.least(*ranks)).alias("a"), cut(F.greatest(*ranks)).alias("b")))
    at = {k: F.col(f"_fim.{k}") for k in ("n", "form", "a", "b")}
    pieces = (F.substring(text, F.lit(1), at["a"].cast("int")), F.substring(text, at["a"].cast("int") + 1, (at["b"] - at["a"]).cast("int")), F.substr(text, at["b"].cast("int") + 1))
    psm = F.concat(prefix, pieces[0], suffix, pieces[2], middle, pieces[1])
    spm_text = F.concat(suffix, pieces[2], prefix, pieces[0], middle, pieces[1])
    cut_up = at["form"] != "plain"
    return held.withColumns({
        "n": at["n"],
        "form": at["form"],
        "prefix_chars": F.when(cut_up, at["a"]),
        "middle_chars": F.when(cut_up, at["b"] - at["a"]),
        "output": F.when(~cut_up, text).when(at["form"] == "psm", psm).otherwise(spm_text),
    }).drop("_fim")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output and its form came from; each mark stands in it once."""
    before_middle, middle = F.substring_index(output, marks[2], 1), F.substring_index(output, marks[2], -1)
    inner = F.substr(before_middle, F.lit(len(marks[0]) + 1))
    prefix_first = F.concat(F.substring_index(inner, marks[1], 1), middle, F.substring_index(inner, marks[1], -1))
    inner = F.substr(before_middle, F.lit(len(marks[1]) + 1))
    suffix_first = F.concat(F.substring_index(inner, marks[0], -1), middle, F.substring_index(inner, marks[0], 1))
    return F.when(F.col(form) == "psm", prefix_first).when(F.col(form) == "spm", suffix_first).otherwise(F.col(output))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(io.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
         list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS d
  FROM t
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS a,
         greatest(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS b
  FROM u
), p AS (
  SELECT doc_id, text, n, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
              WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
