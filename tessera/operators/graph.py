"""Graph operators over edge tables (src, dst): one implementation of each walk, reused by every analysis.

Rounds run on the driver, data never does: each round's new rows are written to the shared folder, which ends the
lineage and survives a lost executor. All loops end when a round finds nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

#: Rounds put into one job, where a round is cheap against starting a job.
UNROLLED = 4
#: Depth of walks that end only when nothing new is found.
NO_LIMIT = 1 << 60


def distances(edges: DataFrame, roots: DataFrame, depth: int, reverse: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, id, dist: least number of edges (0 .. depth) from a root. keys make independent walks of one run.

    roots: keys, id. Roots that no edge touches are kept at 0; NULL ends lead nowhere. depth below 1 counts as 1. The
    edges are written once, for every round reads them.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct(), "steps")
    on = [*keys, "id"]
    seen = materialise(roots.select(*on).distinct().withColumn("dist", F.lit(0)), "walk")
    last = seen
    for k in range(1, max(1, depth) + 1):
        reached = last.join(steps, last["id"] == steps["_from"]).select(*keys, F.col("_to").alias("id")).distinct()
        new = materialise(reached.join(seen.select(*on), on, "left_anti").withColumn("dist", F.lit(k)), "walk")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        last = new
    return seen


def walk_edges(edges: DataFrame, reached: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """Edges that leave a node reached within less than depth steps, those back to visited nodes included."""
    end = "dst" if reverse else "src"
    inner = reached.where(F.col("dist") < max(1, depth)).select(F.col("id").alias(end)).distinct()
    return edges.join(inner, end, "left_semi").select(*edges.columns)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: the least id connected with it; isolated nodes are their own component.

    Alternating large-star and small-star rounds: every round writes its edges, and the loop ends when they are a set of
    stars. nodes: id.
    """
    both = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = materialise(both, "stars")
    before = None
    while True:
        # large star: every greater neighbour of a node is linked to the least of the node and its neighbours
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every lesser neighbour and the node itself are linked to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct()
        now = materialise(small, "stars")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before:
            break
        before = mark
    label = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _trimmed(live: DataFrame) -> tuple[DataFrame, int]:
    """The edges left, and their number, when nodes without a way in or without a way out are taken off again and again."""
    count = live.count()
    while count:
        for _ in range(UNROLLED):
            live = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        live = materialise(live, "live")
        n = live.count()
        if n == count:
            break
        count = n
    return live, count


def on_cycles(edges: DataFrame) -> DataFrame:
    """id, component, size: every node that lies on a cycle of any length, its strongly connected component by the least
    id in it, and the component's number of nodes. Edges from a node to itself are no cycle.

    Colouring: on the trimmed graph each node takes the greatest id that reaches it; a node that keeps its own id is a
    root, and what reaches the root within its colour is its component. Components are taken off and the rest is
    coloured again. Every round holds one row per node, however large a component is.
    """
    live, count = _trimmed(materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct(), "live"))
    found = None
    while count:
        colour = materialise(live.select(F.col("src").alias("id")).union(live.select(F.col("dst").alias("id"))).distinct().withColumn("c", F.col("id")), "colour")
        while True:
            ahead = colour
            for _ in range(UNROLLED):
                sent = ahead.join(live, ahead["id"] == live["src"]).select(F.col("dst").alias("id"), "c")
                ahead = ahead.unionByName(sent).groupBy("id").agg(F.max("c").alias("c"))
            ahead = materialise(ahead, "colour")
            moved = ahead.join(colour, ["id", "c"], "left_anti").isEmpty()
            colour = ahead
            if moved:
                break
        ends = live.join(colour.select(F.col("id").alias("src"), "c"), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("_d")), "dst")
        inside = materialise(ends.where("c = _d").select("src", "dst"), "inside")
        roots = colour.where("id = c").select("id", "c")
        met = distances(inside, roots, NO_LIMIT, reverse=True, keys=("c",)).select("id", "c")
        whole = met.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("size"))
        part = materialise(met.join(whole, "c").select("id", "component", "size"), "component")
        found = part if found is None else found.unionByName(part)
        left = live.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti")
        live, count = _trimmed(materialise(left.select("src", "dst"), "live"))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("bigint").alias("size")).limit(0)
    return found.where("size > 1")


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """cycle (array of nodes, the least first), length: simple cycles of up to `longest` edges.

    Only edges within a strongly connected component are followed; a path starts at its least node. The number of
    cycles of any length grows exponentially with the graph: which nodes lie on one, however long, is told by `on_cycles`.
    """
    part = on_cycles(edges)
    ends = edges.where("src <> dst").select("src", "dst").distinct().join(part.select(F.col("id").alias("src"), F.col("component").alias("_a")), "src").join(part.select(F.col("id").alias("dst"), F.col("component").alias("_b")), "dst")
    live = materialise(ends.where("_a = _b").select("src", "dst"), "live")
    paths = live.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("start"), F.col("dst").alias("end"))
    found = None
    for k in range(2, longest + 1):
        closed = paths.join(live.select(F.col("src").alias("end"), F.col("dst").alias("start")), ["end", "start"], "left_semi").select(F.col("path").alias("cycle"), F.lit(k).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if k == longest:
            break
        grown = paths.join(live.select(F.col("src").alias("end"), F.col("dst").alias("_n")), "end").where("_n > start").where(~F.array_contains("path", F.col("_n")))
        paths = materialise(grown.select(F.concat("path", F.array("_n")).alias("path"), "start", F.col("_n").alias("end")), "paths")
        if paths.isEmpty():
            break
    return found


def new_cycles(now: DataFrame, before: DataFrame, longest: int) -> DataFrame:
    """cycle, length: the cycles of a graph that another, earlier one doesn't have."""
    return cycles(now, longest).join(cycles(before, longest).select("cycle"), "cycle", "left_anti").select("cycle", "length")


def depths(edges: DataFrame, most: int | None = None) -> DataFrame:
    """id, depth: length of the longest chain from a node without incoming edge.

    Each round raises nodes to a greater depth, one row per node; without cycles the rounds end by themselves. Chains on
    cycles are cut at `most`, or at the number of nodes. Edges from a node to itself are left out.
    """
    live = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct(), "live")
    nodes = live.select(F.col("src").alias("id")).union(live.select(F.col("dst").alias("id"))).distinct()
    roots = live.select(F.col("src").alias("id")).distinct().join(live.select(F.col("dst").alias("id")), "id", "left_anti")
    level = materialise(roots.withColumn("depth", F.lit(0)), "depth")
    left = nodes.count() if most is None else most
    while left > 0:
        ahead = level
        for _ in range(min(left, UNROLLED)):
            raised = ahead.join(live, ahead["id"] == live["src"]).select(F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth"))
            ahead = ahead.unionByName(raised).groupBy("id").agg(F.max("depth").alias("depth"))
        left -= UNROLLED
        ahead = materialise(ahead, "depth")
        same = ahead.join(level, ["id", "depth"], "left_anti").isEmpty()
        level = ahead
        if same:
            break
    return level


def reach_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """root, target, path: one shortest path (the least one by its nodes) from each root to each target it reaches.

    Every node is visited once per root, so the rows of a round are bounded by roots times nodes.
    """
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("id"), F.array("id").alias("path")).distinct()
    seen = last = materialise(start, "reach")
    steps = materialise(edges.select(F.col("src").alias("id"), F.col("dst").alias("_n")).distinct(), "steps")
    for _ in range(depth):
        grown = last.join(steps, "id").select("root", F.col("_n").alias("id"), F.concat("path", F.array("_n")).alias("path"))
        best = grown.groupBy("root", "id").agg(F.min("path").alias("path"))
        last = materialise(best.join(seen.select("root", "id"), ["root", "id"], "left_anti"), "reach")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen.where("root <> id").join(targets.select("id").distinct(), "id", "left_semi").select("root", F.col("id").alias("target"), "path")
