"""Long exact spans shared between records, by compacting a de Bruijn graph of text.

Graph. The tokens are characters, and k-mers of K characters are the edges. Of these the graph is kept sparse: only
k-mers that start at a minimiser are taken (in every window of WINDOW successive positions, the one whose GRAM
characters have the least hash). A stretch of `length` characters that two texts share holds at least one whole window
followed by K = length - WINDOW + 1 characters, so both texts take the same k-mer there: no shared stretch is missed,
whatever it consists of. Only edges that occur in at least two texts are kept.

Refinement. Around repeated edges the graph is made dense and its k-mers as long as the stretches asked for: every window
of `length` characters that holds a repeated edge is hashed, and those that occur in two texts are kept. From these
alone follows how much of each text is shared, without any pair of texts (`shared_amount`). For pairs, the edges that
more than FEW occurrences have are refined; the others lead to so few candidates that each can be looked at.

Compaction. Successive edges, or windows, of a text are linked. A link is unbranching if neither ever occurs without the
other (the ways in and out are counted by Spark aggregations and joined back); maximal unbranching paths are compacted,
and the first edge names the path, which is the same in every occurrence.

Verification. Compacted paths keep their source coordinates. Texts that share a path of windows share a stretch that is
long enough, so a shorter passage that very many texts hold costs its windows, not its pairs. Pairs are laid over each
other on the diagonals of their paths and the common stretch is grown character by character. Equal texts take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

LENGTH = 200
GRAM, WINDOW = 8, 64
#: Occurrences of an edge up to which its texts are paired directly.
FEW = 16
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def geometry(length: int) -> tuple[int, int, int]:
    """(gram, window, k) for stretches of `length` characters."""
    if length < 8:
        raise ValueError("stretches of fewer than 8 characters aren't supported")
    window = min(WINDOW, length // 3)
    k = length - window + 1
    return min(GRAM, k), window, k


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(value: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k values from each start: polynomial prefix sums, brought to a common start by the factor's inverse."""
    with np.errstate(over="ignore"):
        powers = np.full(len(value) + 1, _M)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(len(value) + 1, _INVERSE)
        back[0] = 1
        back = np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[:-1], dtype=np.uint64)])
        return _mix((sums[starts + k] - sums[starts]) * back[starts])


def _values(chars: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(chars.astype(np.uint64) + _M)


def windows_at(chars: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of `length` characters that hold the k-mer at one of `starts`."""
    _, window, _ = geometry(length)
    mark = np.zeros(len(chars) + 2, np.int32)
    np.add.at(mark, np.maximum(starts - window + 1, 0), 1)
    np.add.at(mark, starts + 1, -1)
    at = np.flatnonzero(np.cumsum(mark)[: max(0, len(chars) - length + 1)] > 0)
    return at, _hashes(_values(chars), at, length)


def edges_at_cuts(chars: np.ndarray, gram: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """chars: code points. Minimiser positions that k characters follow, and the hashes of these."""
    n = len(chars)
    grams = n - gram + 1
    if grams < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        value = _values(chars)
        h = np.zeros(grams, np.uint64)
        for j in range(gram):
            h = h * _M + value[j : j + grams]
        # the upper half of the hash, then the position: among equal grams of a window the last one is the least
        key = (_mix(h) & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - np.arange(grams, dtype=np.uint64))
        least, span = key, 1
        while span * 2 <= window:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        at = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
        cuts = at[np.concatenate([[True], at[1:] != at[:-1]])]
        cuts = cuts[cuts + k <= n]
    edges = _hashes(value, cuts, k)
    return cuts, edges


def edges_of(texts: DataFrame, length: int) -> DataFrame:
    """id, seq, edge, start: the edges of each text in order, with their coordinates in characters."""
    gram, window, k = geometry(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, seqs, hashes, starts = [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                cuts, edges = edges_at_cuts(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), gram, window, k)
                if len(edges):
                    ids.append(np.full(len(edges), i, np.int64))
                    seqs.append(np.arange(len(edges), dtype=np.int32))
                    hashes.append(edges.view(np.int64))
                    starts.append(cuts.astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, seqs, hashes, starts)], ["id", "seq", "edge", "start"])

    return texts.mapInArrow(run, "id BIGINT, seq INT, edge BIGINT, start INT")


def compact(occurrences: DataFrame) -> DataFrame:
    """id, path, start: occurrences of maximal unbranching paths of repeated windows or edges.

    occurrences: id, seq, edge, start. A gap in seq ends a path.
    """
    by_text = Window.partitionBy("id").orderBy("seq")
    near = occurrences.withColumn("next", F.when(F.lead("seq").over(by_text) == F.col("seq") + 1, F.lead("edge").over(by_text)))
    near = near.withColumn("prev", F.when(F.lag("seq").over(by_text) == F.col("seq") - 1, F.lag("edge").over(by_text)))
    # a text that ends here is one more way to go on
    ways = near.groupBy("edge").agg(
        F.min("next").alias("n0"), F.max("next").alias("n1"), F.max(F.col("next").isNull()).alias("ends"),
        F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.max(F.col("prev").isNull()).alias("begins"),
    )
    one_way_on = (F.col("n0") == F.col("n1")) & ~F.col("ends")
    one_way_in = (F.col("p0") == F.col("p1")) & ~F.col("begins")
    flags = ways.select("edge", F.coalesce(one_way_on, F.lit(False)).alias("on"), F.coalesce(one_way_in, F.lit(False)).alias("into"))
    met = near.drop("next", "prev").join(flags, "edge")
    joined = (F.lag("seq").over(by_text) == F.col("seq") - 1) & F.lag("on").over(by_text) & F.col("into")
    return met.withColumn("joined", F.coalesce(joined, F.lit(False))).where("NOT joined").select("id", F.col("edge").alias("path"), "start")


def _grow(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["a", "b", "start_a", "start_b", "n"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    for batch in batches:
        rows = []
        for a, b, seeds, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "seeds", "ta", "tb"))):
            reached: dict[int, int] = {}  # by diagonal: where the last stretch ends
            for x, y in sorted((s["pa"], s["pb"]) for s in seeds):
                if reached.get(x - y, -1) > x or ta[x : x + 1] != tb[y : y + 1]:
                    continue
                left = _common(lambda k, x=x, y=y, ta=ta, tb=tb: ta[x - k : x] == tb[y - k : y], min(x, y))
                right = _common(lambda k, x=x, y=y, ta=ta, tb=tb: ta[x : x + k] == tb[y : y + k], min(len(ta) - x, len(tb) - y))
                reached[x - y] = x + right
                if left + right >= length:
                    rows.append((a, b, x - left, y - left, left + right))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _common(same, most: int) -> int:
    """Greatest k up to most with same(k); same is true up to some k and false beyond."""
    low, step = 0, 64
    while low < most:
        k = min(most, low + step)
        if same(k):
            low, step = k, step * 2
        else:
            high = k
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if same(mid) else (low, mid)
            return low
    return most


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs with two ids or more, with n, the key's rows. rows: id, key and whole numbers from 0 up.

    Both readers of the exchange see the rows clustered by key: counting and joining back need no other shuffle. The
    counting side asks for all columns too, for an exchange is reused only where both sides ask for the same ones.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartition(parts, key)
    rest = [c for c in rows.columns if c not in ("id", key)]
    counted = placed.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("i0"), F.max("id").alias("i1"), *(F.min(c).alias(f"_{c}") for c in rest))
    cond = F.col("i0") < F.col("i1")
    for c in rest:
        cond = cond & (F.col(f"_{c}") >= 0)
    return placed.join(counted.where(cond).select(key, "n"), key)


def repeated_edges(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, seq, edge, start, n: the edges that two texts have. texts: id bigint (unique), text (distinct, not NULL)."""
    return materialise(_repeated(edges_of(texts, length), "edge"), "repeated-edges")


def shared_windows(texts: DataFrame, occurrences: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, start, edge: the windows of `length` characters around the given edges that stand in another text too."""
    starts = materialise(occurrences.groupBy("id").agg(F.collect_list("start").alias("starts")), "starts")  # no more than a text has cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, hashes = [], [], []
            for i, t, p in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("starts").to_pylist()):
                w, h = windows_at(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), np.array(p, np.int64), length)
                ids.append(np.full(len(w), i, np.int64))
                at.append(w.astype(np.int32))
                hashes.append(h.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, at, hashes)], ["id", "start", "edge"])

    windows = texts.join(starts, "id").select("id", "text", "starts").mapInArrow(run, "id BIGINT, start INT, edge BIGINT")
    return materialise(_repeated(windows, "edge").drop("n"), "shared-windows")


def shared(texts: DataFrame, occurrences: DataFrame, length: int = LENGTH, few: int = FEW) -> DataFrame:
    """a, b, start_a, start_b, n: common stretches of at least `length` characters of different texts (a < b).

    Each stretch is as long as can be. occurrences: see repeated_edges.
    """
    direct = compact(occurrences.where(F.col("n") <= few).drop("n")).withColumn("fine", F.lit(False))
    windows = shared_windows(texts, occurrences.where(F.col("n") > few), length)
    refined = compact(windows.select("id", F.col("start").alias("seq"), "edge", "start")).withColumn("fine", F.lit(True))
    paths = materialise(direct.unionByName(refined), "paths")
    x = paths.select("fine", "path", F.col("id").alias("a"), F.col("start").alias("pa"))
    y = paths.select("fine", "path", F.col("id").alias("b"), F.col("start").alias("pb"))
    # one text may hold a path several times: every diagonal is tried
    seeds = x.join(y, ["fine", "path"]).where("a < b").groupBy("a", "b").agg(F.collect_set(F.struct("pa", "pb")).alias("seeds"))
    seeds = materialise(seeds, "seeds")
    # texts travel for these joins, so only those that are in a pair
    met = materialise(seeds.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired")
    paired = materialise(texts.join(met, "id", "left_semi"), "paired-texts")
    left = paired.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = paired.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    laid = seeds.join(left, "a").join(right, "b").select("a", "b", "seeds", "ta", "tb")
    return laid.mapInArrow(lambda b: _grow(length, b), "a BIGINT, b BIGINT, start_a INT, start_b INT, n INT")


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, cls, n: records of equal text share the class, the least key; NULL texts are left out."""
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(key).cast("bigint").alias("id")).agg(F.min(text).alias("text"))
    digest = rows.select("id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    least = digest.groupBy("h").agg(F.min("id").alias("cls"))
    return digest.join(least, "h").select("id", "cls", "n")


def distinct_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(membership id, cls, n) and (texts id, text: one per class, of at least `length` characters)."""
    member = materialise(classes(documents, key, text), "classes")
    # the copies, mostly few, are taken out rather than the others looked up: as a table of its own their size is known
    copies = materialise(member.where("id <> cls").select("id"), "copies")
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) >= length)).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    once = rows.join(copies, "id", "left_anti")
    return member, once.groupBy("id").agg(F.min("text").alias("text")) if _may_repeat(documents, key) else once


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(membership id, cls, n) and (stretches between classes, see `shared`)."""
    member, texts = distinct_texts(documents, key, text, length)
    return member, shared(texts, repeated_edges(texts, length), length, few)


def _may_repeat(documents: DataFrame, key: str) -> bool:
    return bool(documents.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def pairs(member: DataFrame, spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id_a < doc_id_b: all pairs of records with a common stretch, classes expanded as a stated result demands."""
    links = spans.select("a", "b").distinct()
    m1, m2 = member.select(F.col("id").alias("i"), F.col("cls").alias("a")), member.select(F.col("id").alias("j"), F.col("cls").alias("b"))
    across = links.join(m1, "a").join(m2, "b").select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b"))
    long = member.where(F.col("n") >= length)
    some = long.join(long.groupBy("cls").agg(F.count("*").alias("m")).where("m > 1").select("cls"), "cls")
    equal = some.alias("x").join(some.alias("y"), F.col("x.cls") == F.col("y.cls")).where("x.id < y.id").select(F.col("x.id").alias("doc_id_a"), F.col("y.id").alias("doc_id_b"))
    return across.unionByName(equal)


def shared_amount(member: DataFrame, windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_chars, shared_chars: characters of each record that stand in a long stretch of another record too.

    Windows of a text are laid over each other in order; a text with an equal one is shared as a whole.
    """
    w = Window.partitionBy("id").orderBy("start")
    fresh = F.least(F.lit(length), F.col("start") - F.coalesce(F.lag("start").over(w), F.col("start") - length))
    amount = windows.select("id", fresh.alias("k")).groupBy(F.col("id").alias("cls")).agg(F.sum("k").alias("k"))
    sizes = member.groupBy("cls").agg(F.count("*").alias("m"))
    met = member.join(sizes, "cls").join(amount, "cls", "left")
    whole = (F.col("m") > 1) & (F.col("n") >= length)
    return met.select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"), F.when(whole, F.col("n")).otherwise(F.coalesce("k", F.lit(0))).cast("bigint").alias("shared_chars"))
