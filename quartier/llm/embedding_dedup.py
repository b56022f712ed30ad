"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector by ``BITS`` random hyperplanes, one bit each, and orders all vectors by the concatenated bits. Near vectors share long beginnings of
the key, so a task compares each vector of its sorted range with the ``WINDOW`` before it; the ends of neighbouring ranges meet in groups of
their own. Pairs whose cosine reaches the threshold are joined to groups inside the task, which returns a star for each group and not its
pairs, and components unite the stars of all passes. The number of passes follows the table's size, so that at every size a pair exactly at the
threshold stands within a window of some pass with probability ``SURE`` (closer pairs are surer): ``passes`` has the formula.

Windows are bounded, links are not: inside a component every member's links are then counted completely. Small components are compared in whole. In
larger ones vectors go to balls of half the threshold's angle around leaders, drawn in rounds until every member has one: all members of
a ball are linked with each other. By the triangle inequality most pairs of a member and a ball are linked or apart as a whole, and add the ball's count or
nothing; members of the others are compared in tiles. So a group of a third of all rows costs its rows times its balls, and no pair is
emitted. Equal vectors are one class with a count from the beginning, told apart by 128-bit hashes.

Nulls and edge cases: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and stand alone, as do vectors of different length with
each other; every row is a vector, so rows that repeat an id or a vector count as others; a component of null ids only has a null component_id and its rows are
kept; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, io

THRESHOLD = 0.9
BITS = 63
WINDOW = 256
SURE = 0.99
SEED = 12
#: Vectors compared at once with those before them.
BLOCK = 256
#: Members of a component that are compared in whole, and of a tile of a larger one.
SMALL = 256
TILE = 1 << 11
#: Leaders drawn for a component in the first round; each further round draws four times as many.
LEADERS = 8
#: Radians that rounding may move an angle.
SLACK = 1e-6
NO_ID = (1 << 63) - 1

NODE = ("id", "h1", "h2")


def passes(n: int, threshold: float = THRESHOLD, window: int = WINDOW, sure: float = SURE) -> int:
    """Passes for n vectors: two at the threshold share enough bits that no more than a window shares them with probability q in one pass."""
    q = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return 1 if q > sure else math.ceil(math.log(1 - sure) / math.log(1 - q))


def _prepared(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that take part, as (vec_id, v, h1, h2), and ids of the others."""
    rows = df.select("vec_id", F.transform("embedding", lambda c: c + F.lit(0).cast("float")).alias("v"))  # no negative zeros
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    part = F.coalesce(finite, F.lit(False))
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2")]
    return rows.where(part).select("vec_id", "v", *hashes), rows.where(~part).select("vec_id")


def _units(v: pa.Array, length: int) -> np.ndarray:
    """Vectors of one length, scaled to length one in double precision."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(units: np.ndarray, number: int) -> np.ndarray:
    """The concatenated bits of a pass, as whole numbers in the order of the bits."""
    planes = np.random.default_rng([SEED, units.shape[1], number]).standard_normal((units.shape[1], BITS))
    bits = np.zeros((len(units), 64), np.uint8)
    bits[:, 1:] = units @ planes > 0
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.int64)


def _hashed(classes: DataFrame, number: int) -> DataFrame:
    """A row for each class and pass, with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == n))) if (lengths != n).any() else batch
                units = _units(part.column("v"), n)
                for p in range(number):
                    fixed = [pa.array(np.full(part.num_rows, x, np.int32)) for x in (p, n)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(_keys(units, p)), *(part.column(c) for c in NODE), part.column("v")], names=["pass", "length", "key", *NODE, "v"])

    v = classes.schema["v"].dataType.simpleString()
    return classes.select(*NODE, "v").mapInArrow(run, f"pass int, length int, key long, id long, h1 long, h2 long, v {v}")


def _joined(near: np.ndarray, before: int) -> np.ndarray:
    """The least position that each is joined with: near has a row for each position from ``before`` on, and a column for each position."""
    n = near.shape[1]
    label = np.arange(n)
    while True:
        mine = np.minimum(label[before:], np.where(near, label[None, :], n).min(axis=1))
        new = np.minimum(label, np.where(near, mine[:, None], n).min(axis=0))
        new[before:] = np.minimum(new[before:], mine)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(nodes: np.ndarray, units: np.ndarray, before: int, threshold: float, far: Callable) -> np.ndarray:
    """Edges (node, node) that connect what lies within the window of rows from ``before`` on."""
    near = units[before:] @ units.T >= threshold
    near &= far(np.arange(before, len(units))[:, None], np.arange(len(units))[None, :])
    if not near.any():
        return np.zeros((0, 6), np.int64)
    label = _joined(near, before)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return np.concatenate([nodes[moved], nodes[label[moved]]], axis=1)


def _nodes(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in NODE], axis=1)


def _found(hashed: DataFrame, ranges: int, threshold: float, window: int) -> DataFrame:
    """Edges of all passes: pairs of nodes, of which v is null, and the rows at the ends of ranges, with v."""
    v = hashed.schema["v"].dataType.simpleString()
    order = ["pass", "length", "key", "h1", "h2"]
    schema = f"seam long, place int, length int, id long, h1 long, h2 long, id2 long, h12 long, h22 long, v {v}"
    names = ["seam", "place", "length", *NODE, "id2", "h12", "h22", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = TaskContext.get().partitionId()
        kind = first = None
        seen = 0
        tail: list = []  # nodes, vectors and units of the last rows, a window of them at most, all of one pass and length

        def end(seam: int, place: np.ndarray, nodes: np.ndarray, v: pa.Array) -> pa.RecordBatch:
            known = [pa.array(np.full(len(nodes), seam)), pa.array(place.astype(np.int32)), pa.array(np.full(len(nodes), kind[1], np.int32))]
            return pa.RecordBatch.from_arrays([*known, *(pa.array(nodes[:, i]) for i in range(3)), *[pa.nulls(len(nodes), pa.int64())] * 3, v], names=names)

        for batch in batches:
            kinds = np.stack([np.asarray(batch.column("pass")), np.asarray(batch.column("length"))], axis=1)
            cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1).tolist(), len(kinds)]
            for at, size in ((at, min(BLOCK, b - at)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for at in range(a, b, BLOCK)):
                if kind != (now := tuple(kinds[at].tolist())):
                    kind, tail, first = now, [], first or now
                part = batch.slice(at, size)
                new = [_nodes(part), part.column("v"), _units(part.column("v"), kind[1])]
                before = len(tail[0]) if tail else 0
                nodes, v, units = [np.concatenate([tail[0], new[0]]), pa.concat_arrays([tail[1], new[1]]), np.concatenate([tail[2], new[2]])] if tail else new
                stars = _stars(nodes, units, before, threshold, lambda i, j: (j < i) & (j >= i - window))
                if len(stars):
                    unknown = [pa.nulls(len(stars), t) for t in (pa.int64(), pa.int32(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*unknown, *(pa.array(stars[:, i]) for i in range(6)), pa.nulls(len(stars), v.type)], names=names)
                if kind == first and seen < window:  # the beginning of the range
                    begin = min(size, window - seen)
                    yield end(mine - 1, window + seen + np.arange(begin), new[0][:begin], new[1][:begin])
                seen += size
                last = max(0, len(nodes) - window)
                tail = [nodes[last:], v[last:], units[last:]]
        if tail:
            yield end(mine, window - len(tail[0]) + np.arange(len(tail[0])), tail[0], tail[1])
        io.trim()

    dealt = hashed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return io.written(dealt.mapInArrow(run, schema), "window-stars")


def _seams(ends: DataFrame, threshold: float, window: int) -> DataFrame:
    """Edges between the end of a range and the beginning of the next one: two windows of rows at most in a group."""
    names = [*NODE, "id2", "h12", "h22"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("place")
        place, length = np.asarray(table.column("place")), np.asarray(table.column("length"))
        out = [np.zeros((0, 6), np.int64)]
        for n in np.unique(length).tolist():
            part = table.filter(pa.array(length == n))
            at = place[length == n]
            before = int((at < window).sum())
            if 0 < before < len(at):
                units = _units(part.column("v").combine_chunks(), n)
                out.append(_stars(_nodes(part), units, before, threshold, lambda i, j, at=at: (at[i] - at[j] <= window) & (j < i)))
        stars = np.concatenate(out)
        return pa.table({c: stars[:, i] for i, c in enumerate(names)})

    rows = ends.select("seam", "place", "length", *NODE, "v")
    return rows.groupBy("seam").applyInArrow(run, ", ".join(f"{c} long" for c in names))


def grouped(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, sure: float = SURE) -> DataFrame:
    """(node, root) of the classes that some pass links with another."""
    n = classes.count()
    number = passes(n, threshold, window, sure)
    ranges = max(1, min(10_000, n * number // (16 * window)))
    found = _found(_hashed(classes, number), ranges, threshold, window)
    pairs = found.where("v IS NULL").drop("seam", "place", "length", "v").unionByName(_seams(found.where("v IS NOT NULL"), threshold, window))
    return graph.components(pairs.select(F.struct(*NODE).alias("a"), F.struct(F.col("id2").alias("id"), F.col("h12").alias("h1"), F.col("h22").alias("h2")).alias("b")))


def met(left: DataFrame, right: DataFrame, key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, tile: int = TILE) -> DataFrame:
    """run(rows of left, rows of right) for tiles in which every two rows of one key meet once; about ``tile`` rows a side."""
    spark = left.sparkSession
    count = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    sizes = io.written(count(left, "_m").join(count(right, "_n"), key), "tiles")  # written, so that large keys of the joins below can be split
    io.small_batches(spark)
    dealt = F.xxhash64(F.lit(SEED), "h1", "h2")
    a = left.join(sizes, key).withColumn("_i", F.pmod(dealt, F.col("_m")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    b = right.join(sizes, key).withColumn("_j", F.pmod(dealt, F.col("_n")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    by = [key, "_i", "_j"]
    # new names for the columns of both sides, which may come from one table
    a, b = (df.select(*[F.col(c).alias(c) for c in [*by, *[c for c in own.columns if c != key]]]) for df, own in ((a, left), (b, right)))
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(run, schema)


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    return _units(v, len(v[0])) if len(v) else np.zeros((0, 1))


def _angles(left: pa.Table, right: pa.Table) -> np.ndarray:
    return np.arccos(np.clip(_matrix(left) @ _matrix(right).T, -1, 1))


def _balls(large: DataFrame, half: float) -> DataFrame:
    """The members with ``ball``, the node of a leader at most ``half`` radians away, and ``angle``, the distance to it."""
    schema = "id long, h1 long, h2 long, ball struct<id: long, h1: long, h2: long>, angle double"

    def near(members: pa.Table, leaders: pa.Table) -> pa.Table:
        if not members.num_rows or not leaders.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "ball": pa.array([], pa.struct([(c, pa.int64()) for c in NODE])), "angle": pa.array([], pa.float64())})
        angles = _angles(members, leaders)
        best = angles.argmin(axis=1)
        rows = np.flatnonzero(angles[np.arange(len(best)), best] <= half)
        nodes, theirs = _nodes(members)[rows], _nodes(leaders)[best[rows]]
        ball = pa.StructArray.from_arrays([pa.array(theirs[:, i]) for i in range(3)], names=NODE)
        return pa.table({**{c: nodes[:, i] for i, c in enumerate(NODE)}, "ball": ball, "angle": angles[rows, best[rows]]})

    left, done, number = large, None, 0
    while True:
        slot = F.pmod(F.xxhash64(F.lit(number), "h1", "h2"), F.lit(LEADERS * 4**number))
        leaders = left.groupBy("root", slot.alias("slot")).agg(F.min_by(F.struct(*NODE, "v"), F.struct("h1", "h2")).alias("x")).select("root", "x.*")
        some = met(left.select("root", *NODE, "v"), leaders, "root", near, schema)
        nearest = some.groupBy(*NODE).agg(F.min(F.struct("angle", "ball")).alias("x")).select(*NODE, "x.ball", "x.angle")
        nearest = io.written(left.join(nearest, list(NODE), "left"), "balls")
        found = nearest.where("ball IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        left = nearest.where("ball IS NULL").drop("ball", "angle")
        if left.isEmpty():
            return done
        number += 1


def _large(large: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2, links): how many rows each member of a large component is linked with, itself included."""
    theta = math.acos(threshold)
    members = _balls(large, theta / 2 - SLACK)
    sizes = members.groupBy("root", "ball").agg(F.max("angle").alias("radius"), F.sum("m").alias("total"))
    leaders = large.select(F.struct(*NODE).alias("ball"), *NODE, "v")
    balls = io.written(sizes.join(leaders, "ball").drop("ball"), "ball-sizes")

    def weigh(rows: pa.Table, others: pa.Table) -> pa.Table:
        if not rows.num_rows or not others.num_rows:
            empty = pa.array([], pa.int64())
            return pa.table({"id": empty, "h1": empty, "h2": empty, "links": empty, "ball": pa.array([], pa.struct([(c, pa.int64()) for c in NODE]))})
        angles, radius, total = _angles(rows, others), np.asarray(others.column("radius")), np.asarray(others.column("total"))
        sure = angles + radius <= theta - SLACK
        doubtful = ~sure & (angles - radius <= theta + SLACK)
        nodes, theirs = _nodes(rows), _nodes(others)
        i, j = np.nonzero(doubtful)
        ids = np.concatenate([nodes, nodes[i]])
        links = pa.array(np.concatenate([sure @ total, np.zeros(len(i), np.int64)]).astype(np.int64))
        ball = pa.StructArray.from_arrays([pa.array(np.concatenate([nodes[:, c], theirs[j, c]])) for c in range(3)], names=NODE, mask=pa.array(np.arange(len(ids)) < len(nodes)))
        return pa.table({**{c: ids[:, k] for k, c in enumerate(NODE)}, "links": links, "ball": ball})

    def count(rows: pa.Table, others: pa.Table) -> pa.Table:
        nodes = _nodes(rows)
        links = (_matrix(rows) @ _matrix(others).T >= threshold) @ np.asarray(others.column("m")) if rows.num_rows and others.num_rows else np.zeros(len(nodes))
        return pa.table({"h1": nodes[:, 1], "h2": nodes[:, 2], "links": links.astype(np.int64)})

    told = io.written(met(members.select("root", *NODE, "v"), balls, "root", weigh, "id long, h1 long, h2 long, links long, ball struct<id: long, h1: long, h2: long>"), "ball-links")
    asks = told.where("ball IS NOT NULL").drop("links").join(large.select(*NODE, "v"), list(NODE))
    exact = met(asks, members.select("ball", *NODE, "v", "m"), "ball", count, "h1 long, h2 long, links long")
    return told.where("ball IS NULL").select("h1", "h2", "links").unionByName(exact).groupBy("h1", "h2").agg(F.sum("links").alias("links"))


def _small(small: DataFrame, threshold: float) -> DataFrame:
    """(h1, h2, links) for components of at most SMALL members, some hundreds of components in a group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("r1", "ascending"), ("r2", "ascending")])
        root, nodes, m = np.stack([np.asarray(table.column(c)) for c in ("r1", "r2")], axis=1), _nodes(table), np.asarray(table.column("m"))
        links = np.zeros(len(nodes), np.int64)
        cuts = [0, *(np.flatnonzero((root[1:] != root[:-1]).any(axis=1)) + 1).tolist(), len(root)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            units = _matrix(table.slice(a, b - a))
            links[a:b] = (units @ units.T >= threshold) @ m[a:b]
        return pa.table({"h1": nodes[:, 1], "h2": nodes[:, 2], "links": links})

    groups = max(1, small.count() // TILE)
    rows = small.select(F.pmod(F.xxhash64("root"), F.lit(groups)).alias("bucket"), F.col("root.h1").alias("r1"), F.col("root.h2").alias("r2"), *NODE, "v", "m")
    return rows.groupBy("bucket").applyInArrow(run, "h1 long, h2 long, links long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, sure: float = SURE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding)."""
    rows, others = _prepared(df)
    io.small_batches(df.sparkSession)
    classes = rows.groupBy("h1", "h2").agg(F.coalesce(F.min("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    classes = io.written(classes.select(*NODE, "m", "v"), "vector-classes")
    roots = grouped(classes, threshold, window, sure)
    sizes = io.written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("s")), "component-sizes")
    members = roots.join(sizes, "root").select("node.*", "root", "s")
    members = io.written(members.join(classes, list(NODE)), "component-members")
    links = _small(members.where(F.col("s") <= SMALL), threshold)
    large = members.where(F.col("s") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(_large(large, threshold))
    known = classes.select(*NODE, "m").join(roots.select("node.*", F.col("root.id").alias("least")), list(NODE), "left").join(links, ["h1", "h2"], "left")
    least = F.coalesce("least", "id")
    known = known.select("h1", "h2", (F.coalesce("links", "m") - 1).alias("n_links"), F.when(least != NO_ID, least).alias("component_id"))
    told = rows.select("vec_id", "h1", "h2").join(io.written(known, "class-links"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = others.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(io.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP12_SQL = """
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), m AS (
  SELECT *, CASE WHEN len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_max(list_transform(e, lambda x: abs(x))) END AS most FROM t
), v AS MATERIALIZED (
  SELECT rid, vec_id, CASE WHEN most > 0 THEN list_transform(e, lambda x: x / most) END AS e FROM m
), p AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT rid, rid AS other FROM v
  UNION
  SELECT r.rid, p.b FROM reach r JOIN p ON r.other = p.a
), g AS (
  SELECT r.rid, min(o.vec_id) AS component_id FROM reach r JOIN v o ON r.other = o.rid GROUP BY r.rid
), n AS (
  SELECT a AS rid, count(*) AS n_links FROM p GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, g.component_id, v.vec_id IS NOT DISTINCT FROM g.component_id AS kept
FROM v JOIN g USING (rid) LEFT JOIN n USING (rid)
"""
