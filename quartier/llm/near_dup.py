"""Near-duplicate documents by bottom-k sketches of word shingles.

1. A document's set holds the hashes of its distinct n-word shingles, its sketch the ``K`` least of them. Documents
   with equal sets become one node, before anything else.
2. Inverted lists: of each sketch the rarest retained values are kept, enough that two sketches with the least
   overlap of a link must share one (values that only one node retains need no list). Within a list the union sketches give
   estimates of the similarity, and pairs well below the threshold go; of a list beyond ``BLOCK`` members all stay together. Lists
   answer with edges that connect what may be linked, and families are the components of those edges.
3. Families are verified exactly on full sets, rebuilt from whole texts; edges enough to connect what is linked go
   on, and their components are the result. A family of up to ``BLOCK`` nodes and ``GROUP_BYTES`` is compared in one task.
   A larger one goes through rounds of representatives (``verified``), in which rows sent grow in proportion to its members.

No task holds a group beyond these bounds, and no link is lost to them. The estimate's floor lies 5.5 standard deviations below the threshold.

Nulls and edge cases: null texts and texts without words have an empty set and are linked with nothing; texts with fewer
than n words have one shingle, the whole sequence; rows with a null id link others but never name a group, and a group of such
rows alone has a null component_id and no kept row; rows that
repeat an id are judged by their own texts and share the smallest id reached; an empty table gives an empty
result; other columns are not read. The stage keeps one row of each group, by smallest id, null ids last, and every row with an empty set,
with all columns as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan, graph, io

K = 32
BLOCK = 256
GROUP_BYTES = 1 << 24
#: Most copies of a member that tiles of unsettled members against all may take; groups that need more go on as lists.
MOST_TILES = 64


def estimate_floor(percent: int) -> float:
    j = percent / 100
    return max(1 / K, j - 5.5 * (j * (1 - j) / K) ** 0.5)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return bytescan.shingles(bytescan.word_hashes((text or "").encode("utf-8", "surrogatepass")), n)


def _set_id(s: np.ndarray) -> int:
    """A hash of the whole set."""
    total = bytescan.mix(s).sum(dtype=np.uint64, keepdims=True) + bytescan.mix(np.array([len(s)], np.uint64))
    return int(bytescan.mix(total).astype(np.int64)[0])


def _row_key() -> Column:
    """Tells rows apart by id and text, null ids too."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, sketch): node identifies the set and is null for an empty one."""

    def run(texts: list) -> dict:
        sets = [shingle_set(t, n) for t in texts]
        return {
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "node": pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()),
            "sketch": pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())),
        }

    return io.per_text(docs.select("doc_id", _row_key().alias("key"), "text"), run, "n_shingles long, node long, sketch array<long>")


def _prefixes(values: DataFrame, owner: list[str], group: list[str], take: Column) -> DataFrame:
    """(owner, value, members, fame): for each owner its rarest values, ``take`` of them, without those that only it has.

    values: rows (owner, value, kept), kept being the owner's number of values. Rarity is that inside the group.
    """
    often = values.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = values.join(often, [*group, "value"])
    mine = Window.partitionBy(*owner)
    shared = shared.select(
        "*", F.row_number().over(mine.orderBy("members", "value")).alias("rank"), F.count(F.lit(1)).over(mine).alias("in_lists"), F.sum("members").over(mine).alias("fame")
    )
    # the values that no other owner has come first in rarity, and fill places of the prefix
    return shared.where(F.col("rank") <= take - (F.col("kept") - F.col("in_lists")))


def inverted_lists(nodes: DataFrame, floor: float) -> DataFrame:
    """(value, node, members, fame): the lists in which a node must meet any node that it is linked with.

    fame sums up over all shared values of the node how many nodes retain them.
    """
    values = nodes.select("node", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    prefix = F.col("kept") - F.floor(F.col("kept") * floor) + 1
    return _prefixes(values, ["node"], [], prefix).select("value", "node", "members", "fame")


def _similar(a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """Whether the similarity estimated from the union of two sketches reaches the floor, for rows of sketches."""
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        merged = np.sort(np.concatenate([a[at : at + (1 << 15)], b[at : at + (1 << 15)]], axis=1), axis=1)
        real = merged != np.uint64(2**64 - 1)
        twice = np.zeros(merged.shape, bool)
        twice[:, 1:] = (merged[:, 1:] == merged[:, :-1]) & real[:, 1:]
        distinct = np.cumsum(real & ~twice, axis=1)  # place in the union's order
        size = np.minimum(distinct[:, -1], K)
        ok[at : at + (1 << 15)] = (twice & (distinct <= K)).sum(axis=1) >= floor * size
    return ok


def family_edges(lists: DataFrame, nodes: DataFrame, floor: float, buckets: int) -> DataFrame:
    """(a, b): edges that connect the nodes with similar sketches in a list, and all nodes of a list beyond BLOCK with its value."""
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets))
    rows = lists.where(F.col("members") <= BLOCK).select(bucket.alias("bucket"), "value", "node").join(nodes.select("node", "sketch"), "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, position = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        sketch = np.full((len(ids), K), 2**64 - 1, np.uint64)
        for p, s in zip(position, pdf["sketch"], strict=True):
            if sketch[p, 0] == np.uint64(2**64 - 1):
                sketch[p, : len(s)] = np.asarray(s, np.int64).view(np.uint64)
        sets = graph.UnionFind(len(ids))
        out = []
        value = pdf["value"].to_numpy()
        order = np.argsort(value, kind="stable")
        value = value[order]
        ends = np.append(np.flatnonzero(value[1:] != value[:-1]) + 1, len(value))
        pairs, start, waiting = [], 0, 0

        def settle() -> None:
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            both = np.unique(a.astype(np.int64) * len(ids) + b)
            a, b = both // len(ids), both % len(ids)
            root = np.array([sets.find(x) for x in range(len(ids))])
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            ok = _similar(sketch[a], sketch[b], floor)
            out.extend((ids[x], ids[y]) for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True) if sets.join(x, y))
            pairs.clear()

        for end in ends:
            members = position[order[start:end]]
            a, b = np.triu_indices(len(members), 1)
            pairs.append((np.minimum(members[a], members[b]), np.maximum(members[a], members[b])))
            waiting, start = waiting + len(a), end
            if waiting > 1 << 19:
                settle()
                waiting = 0
        if pairs:
            settle()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    hot = lists.where(F.col("members") > BLOCK).select(F.col("node").alias("a"), F.col("value").alias("b"))
    return rows.groupBy("bucket").applyInPandas(run, "a long, b long").unionByName(hot)


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets with all others (or each other), from products of membership matrices over slices of the values."""
    both = sets + (others or [])
    n = len(sets)
    distinct, column = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    out = np.zeros((n, len(both) - n if others is not None else n), np.int64)
    width = max(64, (1 << 22) // len(both))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, len(distinct), width):
        a, b = np.searchsorted(column, [low, low + width])
        member = np.zeros((len(both), min(width, len(distinct) - low)), np.float32)
        member[owner[a:b], column[a:b] - low] = 1
        out += (member[:n] @ (member[n:] if others is not None else member).T).astype(np.int64)
    return out


def family_sets(families: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(grp, node, rank, settled, size, d) for the families (node, key, grp, rank): each node's full set, from its text."""
    # both joins shuffle at every size: the keys grow with the documents, and are never broadcast
    texts = docs.select(_row_key().alias("key"), "text").join(families.select("key").distinct().hint("merge"), "key", "left_semi")
    rows = families.hint("merge").join(texts.dropDuplicates(["key"]), "key").drop("key")

    def run(texts: list) -> dict:
        sets = [shingle_set(t, n) for t in texts]
        return {"size": pa.array([len(s) for s in sets], pa.int64()), "d": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}

    return io.per_text(rows.withColumn("settled", F.lit(False)), run, "size long, d array<long>")


def _linked(size: np.ndarray, size2: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets are linked, from their sizes and the size of their symmetric difference."""
    return (100 - percent) * (size + size2) >= (100 + percent) * apart


def _compared(groups: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(a, b): edges that connect, group by group, what is linked; pairs of settled members are connected elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("grp"):
            ids, size, settled = part["node"].to_numpy(), part["size"].to_numpy(), part["settled"].to_numpy(bool)
            sets = [np.asarray(d, np.int64) for d in part["d"]]
            held = np.array([len(s) for s in sets])
            a, b = np.triu_indices(len(ids), 1)
            open_ = ~(settled[a] & settled[b])
            a, b = a[open_], b[open_]
            ok = _linked(size[a], size[b], held[a] + held[b] - 2 * intersections(sets)[a, b], percent)
            a, b = a[ok], b[ok]
            out += [(ids[a[e]], ids[b[e]]) for e in graph.spanning(len(ids), a, b)]
        io.trim()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keyed = groups.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    return keyed.select("bucket", "grp", "node", "settled", "size", "d").groupBy("bucket").applyInPandas(run, "a long, b long")


def _against(rows: pd.DataFrame, pivots: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Members of a group against its representative: whether they are linked, and the symmetric difference."""
    out = {"pivot": [], "pivot_size": [], "settled": [], "d": []}
    if len(pivots) and len(rows):
        pivot, p_size, p = pivots[["pivot", "pivot_size", "pivot_d"]].iloc[0]
        p = np.asarray(p, np.int64)
        for size, d in zip(rows["size"], rows["d"], strict=True):
            apart = np.setxor1d(np.asarray(d, np.int64), p, assume_unique=True)
            out["d"].append(apart)
            out["settled"].append(bool(_linked(size, p_size, len(apart), percent)))
            out["pivot"].append(pivot)
            out["pivot_size"].append(p_size)
    else:
        rows = rows.iloc[:0]
    return pd.DataFrame({"grp": rows["grp"], "node": rows["node"], "size": rows["size"], "pivot": out["pivot"], "pivot_size": out["pivot_size"], "settled": out["settled"], "d": pd.Series(out["d"], index=rows.index, dtype=object)})


def _tiled(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect the unsettled members (mine) of each tile with the tile's other members; those settled are connected elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, size, settled, mine = pdf["node"].to_numpy(), pdf["size"].to_numpy(), pdf["settled"].to_numpy(bool), pdf["mine"].to_numpy(bool)
        sets = [np.asarray(d, np.int64) for d in pdf["d"]]
        held = np.array([len(s) for s in sets])
        join, out = graph.UnionFind(len(ids)), []
        known = np.flatnonzero(settled)
        for x in known[1:].tolist():
            join.join(int(known[0]), x)
        a, others = np.flatnonzero(mine), np.flatnonzero(~mine)
        for at in range(0, len(others), 4 * BLOCK):
            b = others[at : at + 4 * BLOCK]
            if len(a):
                apart = held[a][:, None] + held[b] - 2 * intersections([sets[i] for i in a], [sets[i] for i in b])
                x, y = np.nonzero(_linked(size[a][:, None], size[b], apart, percent))
                out += [(ids[i], ids[j]) for i, j in zip(a[x].tolist(), b[y].tolist(), strict=True) if ids[i] != ids[j] and join.join(i, j)]
        io.trim()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return groups.groupBy("grp", "i", "j").applyInPandas(run, "a long, b long")


def verified(groups: DataFrame, percent: int) -> list[DataFrame]:
    """Frames of edges (a, b) that connect what is linked in the groups (grp, node, rank, settled, size, d).

    d stands for the node's set x: it is the set itself, or its symmetric difference with one set that all members of the group share, so the
    symmetric difference of two members' d is that of their sets. Small groups are compared at once. In a large one the member of
    least rank is the representative p, and every member is compared with it: those that are linked with p are settled, and need no more comparing
    with each other. Let D be d's symmetric difference with p's. Then

    * where the unsettled members are few enough for ``MOST_TILES`` blocks, each block of them is compared with each block of members by their Ds;
    * else the group goes on as inverted lists of D's elements, as many of the rarest as the least overlap asks for, which are the groups of
      the next round, without those whose members are all settled. If x and y are linked and not both settled, their Ds have an element in common: else
      |Dx| + |Dy| <= k (|x| + |y|) with k = (100 - percent) / (100 + percent), while an unsettled y has |Dy| > k (|p| + |y|), so that
      |Dx| < k (|x| - |p|) <= k |Dx|. What all members share vanishes from D, and so does p.
    """
    spark = groups.sparkSession
    found, k = [], (100 - percent) / (100 + percent)
    while True:
        groups = io.written(groups, "groups")
        of = groups.groupBy("grp").agg(
            F.count(F.lit(1)).alias("members"), F.sum(F.size("d") * 8).alias("bytes"), F.bool_and("settled").alias("done")
        ).where("members > 1 AND NOT done")
        of = of.withColumn("hot", (F.col("members") > BLOCK) | (F.col("bytes") > GROUP_BYTES)).drop("done")
        of = io.written(of, "group-sizes")
        small, large = of.where("NOT hot"), of.where("hot")
        total = of.agg(F.sum(F.when(~F.col("hot"), F.col("bytes") + 100 * F.col("members"))), F.count_if("hot")).first()
        if total[0]:
            rows = groups.join(small.select("grp"), "grp", "left_semi")
            found.append(_compared(rows, percent, max(io.tasks(spark), total[0] >> 23)))
        if not total[1]:
            return found
        parts = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")
        rows = groups.join(large.select("grp", parts.alias("parts")), "grp")
        pivot = F.min_by(F.struct("node", "size", "d"), F.struct("rank", "node"))
        pivots = rows.groupBy("grp", "parts").agg(pivot.alias("p")).select(
            F.col("grp").alias("in_grp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("in_part"),
            F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"), F.col("p.d").alias("pivot_d"),
        )
        rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts", "rank", "settled")
        out = rows.groupBy("grp", "part").cogroup(pivots.groupBy("in_grp", "in_part")).applyInPandas(
            lambda left, right: _against(left, right, percent),
            "grp long, node long, size long, pivot long, pivot_size long, settled boolean, d array<long>",
        )
        out = io.written(out, "differences")
        found.append(out.where("settled AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        held = F.size("d")
        of = out.groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"), F.sum(held * 8).alias("bytes"), F.count_if(~F.col("settled")).alias("open"), F.sum(F.when(~F.col("settled"), held * 8)).alias("open_bytes")
        ).where("open > 0")
        blocks = F.greatest(F.ceil(F.col("open") / BLOCK), F.ceil(F.col("open_bytes") / GROUP_BYTES)).cast("int")
        across = F.greatest(F.ceil(F.col("n") / (16 * BLOCK)), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int")
        of = io.written(of.select("grp", blocks.alias("blocks"), across.alias("across")), "tile-sizes")
        tiled = out.drop("pivot", "pivot_size").join(of.where(F.col("blocks") <= MOST_TILES), "grp")
        block, column = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("across")).cast("int")
        mine = tiled.where("NOT settled").withColumn("i", block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
        rest = tiled.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", column)
        found.append(_tiled(mine.withColumn("mine", F.lit(True)).unionByName(rest.withColumn("mine", F.lit(False))).drop("blocks", "across"), percent))
        # the least overlap of D with that of a member it may be linked with; one of the two is not settled
        near = F.floor((held + k * (F.col("pivot_size") - F.col("size"))) / 2)
        far = F.floor(held - k * F.col("size") * (1 + 100 / percent))
        least = F.greatest(F.lit(1), F.when(F.col("settled"), near).otherwise(far))
        listed = out.join(of.where(F.col("blocks") > MOST_TILES).select("grp"), "grp", "left_semi")
        values = listed.select("grp", "node", (held - least + 1).alias("take"), held.alias("kept"), F.explode("d").alias("value"))
        lists = _prefixes(values, ["grp", "node"], ["grp"], F.col("take")).select("grp", "node", F.xxhash64("grp", "value").alias("list"))
        groups = lists.join(out, ["grp", "node"]).select(F.col("list").alias("grp"), "node", held.cast("long").alias("rank"), "settled", "size", "d")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, key, keeper of every row; links have similarity of at least percent / 100.

    key tells rows apart by id and text, and keeper is the key of the row that stays for the group.
    """
    spark = docs.sparkSession
    floor = estimate_floor(percent)
    sk = io.written(sketches(docs, n), "sketches")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    nodes = sk.where("node IS NOT NULL").groupBy("node").agg(F.min(first).alias("first"), F.first("sketch").alias("sketch"))
    nodes = io.written(nodes.select("node", "first.doc_id", "first.key", "sketch"), "nodes")
    lists = io.written(inverted_lists(nodes, floor), "lists")
    size = lists.agg(F.count(F.lit(1))).first()[0]
    family = graph.components(family_edges(lists, nodes, floor, max(io.tasks(spark), size // 20_000)))
    fame = lists.groupBy("node").agg((-F.max("fame")).alias("rank"))
    families = family.select("node", F.col("root").alias("grp")).join(nodes.select("node", "key"), "node").join(fame, "node")
    families = io.written(families, "families")
    edges = verified(family_sets(families, docs, n), percent)
    links = edges[0] if edges else spark.createDataFrame([], "a long, b long")
    for more in edges[1:]:
        links = links.unionByName(more)
    links = graph.components(links)
    named = links.join(nodes.select("node", "doc_id", "key"), "node").groupBy("root").agg(F.min(first).alias("first"))
    named = links.join(named, "root").select("node", "first")
    named = nodes.select("node", F.struct(F.col("doc_id").isNull(), "doc_id", "key").alias("own")).join(named, "node", "left").select("node", F.coalesce("first", "own").alias("first"))
    out = sk.drop("sketch").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        "key", F.coalesce("first.key", "key").alias("keeper"), F.col("node").isNull().alias("empty"),
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(io.table(spark, sf_dir, "documents"), n=3, percent=85).drop("key", "keeper", "empty")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest id: five-word shingles, similarity 0.8 or more."""
    found = near_duplicates(docs).where("key = keeper").groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.bool_or("empty").alias("empty"))
    found = io.written(found.select("key", F.expr("times = 1 OR empty").alias("whole")), "kept")
    name = io.free_name(docs, "_key")
    keyed = docs.withColumn(name, _row_key())

    def held(keys: DataFrame) -> DataFrame:
        return keyed.join(keys.select(F.col("key").alias(name)).hint("merge"), name, "left_semi")

    kept = held(found.where("whole"))
    if not found.where("NOT whole").isEmpty():  # rows that repeat id and text
        kept = kept.unionByName(held(found.where("NOT whole")).dropDuplicates([name]))
    return kept.select(*docs.columns)
