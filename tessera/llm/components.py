"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid.

Vertices are hashed into blocks; an edge belongs to the cell (block of one end, block of the other). Every round

1. runs a local union-find in each cell (a task sees one cell at a time; the grid is refined with the number of edges,
   so a cell holds a bounded expected number of them, and the edges of one very frequent vertex spread over a whole row
   of cells), which leaves each vertex with the least-ranked vertex of its local component;
2. lets the cells of a vertex's row and column exchange these representatives: the least one becomes its parent;
3. replaces the ends of the local trees by their parents and drops what has become a loop.

Ranks are hashes that change with the round, so the expected number of vertices falls by a constant factor each round
whatever the shape (chains included) and whichever ids the vertices have. When no edge is left the parents are stable;
the parent tables are composed from the last to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

#: Expected edges in a cell of the grid.
CELL_EDGES = 100_000
#: Copies of a parent row in joins on a representative, which may stand for a third of all vertices.
SALTS = 16


def local_forest(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union-find over the edges a-b with ranks ra, rb: vertices, the least-ranked vertex of their component, its rank."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[inverse] = np.concatenate([ra, rb])
    # vertices in the order of (rank, id): the smaller index is the representative
    order = np.lexsort((ids, rank))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    x, y = place[inverse[: len(a)]].tolist(), place[inverse[len(a) :]].tolist()
    parent = list(range(len(ids)))
    for u, v in zip(x, y):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        if u < v:
            parent[v] = u
        elif v < u:
            parent[u] = v
    root = np.array(parent, dtype=np.int64)
    while True:
        up = root[root]
        if np.array_equal(up, root):
            break
        root = up
    return ids[order], ids[order][root], rank[order][root]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell; a cell is kept until the next begins."""
    def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(parts) if len(parts) > 1 else parts[0]
        v, rep, rank = local_forest(*(p[c].to_numpy() for c in ("a", "b", "ra", "rb")))
        return pd.DataFrame({"v": v, "rep": rep, "rank": rank})

    held: list[pd.DataFrame] = []
    at = None
    for batch in batches:
        for cell, part in batch.groupby("cell", sort=True):
            if cell != at and held:
                yield done(held)
                held = []
            at = cell
            held.append(part)
    if held:
        yield done(held)


def _round(edges: DataFrame, blocks: int, nth: int) -> tuple[DataFrame, DataFrame]:
    rank = lambda c: F.xxhash64(F.col(c), F.lit(nth))
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), F.col(c)), F.lit(blocks))
    i, j = block("a"), block("b")
    cell = F.least(i, j) * blocks + F.greatest(i, j)
    placed = edges.select(cell.alias("cell"), "a", "b", rank("a").alias("ra"), rank("b").alias("rb"))
    by_cell = placed.repartition(max(1, blocks * (blocks + 1) // 2), "cell").sortWithinPartitions("cell")
    stars = materialise(by_cell.mapInPandas(_cells, "v BIGINT, rep BIGINT, rank BIGINT"), "stars")
    parents = materialise(stars.groupBy("v").agg(F.min(F.struct("rank", "rep")).alias("m")).select("v", F.col("m.rep").alias("p")), "parents")
    ends = stars.where("v <> rep").join(parents, "v").select("p", "rep").distinct()  # the representatives of a large group meet here
    up = parents.select(F.col("v").alias("rep"), F.col("p").alias("q"))
    left = ends.withColumn("s", F.pmod(F.xxhash64("p"), F.lit(SALTS)))
    right = up.join(ends.select("rep").distinct(), "rep", "left_semi").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = left.join(right.withColumn("s", F.col("s").cast("bigint")), ["rep", "s"]).where("p <> q")
    rest = rest.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return parents, materialise(rest, "edges")


def _up(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str) -> DataFrame:
    """rows left-joined with table on a key that may be very frequent in rows; table is unique by its key."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = table.select(F.col(table_key).alias(key), value).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "_s"], "left").drop("_s")


def components(edges: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES) -> DataFrame:
    """v, group_id: every vertex that has an edge to another vertex, with the least vertex of its component.

    Rows with a NULL end and loops are no edges; repeats and both orders count once; other columns are ignored.
    """
    cols = edges.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).where("x <> y")
    now = materialise(cols.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    tables: list[DataFrame] = []
    while count := now.count():
        blocks = max(1, int(np.ceil(np.sqrt(2 * count / cell_edges))))
        parents, now = _round(now, blocks, len(tables))
        tables.append(parents)
    if not tables:
        return cols.select(F.col("x").alias("v"), F.col("x").alias("group_id")).limit(0)
    label = tables.pop()
    while tables:
        lower = tables.pop()
        met = _up(lower, "p", label.withColumnRenamed("p", "root"), "v", "root")
        label = materialise(met.select("v", F.coalesce("root", "p").alias("p")), "labels")
    least = label.groupBy("p").agg(F.min("v").alias("group_id"))
    return _up(label, "p", least, "p", "group_id").select("v", "group_id")


def group_sizes(groups: DataFrame) -> DataFrame:
    """members: number of groups of that size (a report)."""
    per = groups.groupBy("group_id").agg(F.count("*").alias("members"))
    return per.groupBy("members").agg(F.count("*").alias("groups"))


