"""Percentiles of very large numeric columns by dyadic Count-sketches.

A value is encoded as a 32-bit code that keeps the order (the bits of its float32). For every binary resolution of the
code, from halves of the range down to single codes, a signed sketch holds how many values fall into each interval:
the first levels have a counter per interval, the others DEPTH rows of WIDTH signed counters. Sketches are merged by
adding counters, so results of partitions or days combine in any order, and a value is deleted by adding weight -1. A
rank is the sum of the intervals left of a code; a percentile is found by descending the levels.

While a sketch has no more distinct codes than CAPACITY, its counters are kept unfolded, as code and weight: that is
smaller, and exact. Merging and deleting work alike in both forms, and a merge that goes beyond CAPACITY folds.
With WIDTH w a level's count is off by about sqrt(F2 / w), F2 the sum of the squared counts of its intervals; over the
levels that stays near or below 1 % of the values at the values given here (tests/llm/test_percentiles.py measures it).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 32
#: Levels with one counter per interval.
PLAIN = 10
WIDTH = 1024
DEPTH = 5
#: Distinct codes up to which the counters stay unfolded (about the size of the folded form).
CAPACITY = 16_384
#: Rank error, as a share of the values, within which a folded sketch leaves a decision to an exact count.
EPSILON = 0.03
#: Values gathered in a task before they are put into sketches.
CHUNK = 1_000_000
#: Partial sketches merged at a time in the first of the two merging steps.
FAN_IN = 64

_ROWS = (np.arange((BITS + 1) * DEPTH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)).reshape(BITS + 1, DEPTH)


def encode(values: np.ndarray) -> np.ndarray:
    """Codes in the order of the values (compared as float32)."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).astype(np.float32).view(np.uint32)
    return np.where(bits >> 31 == 1, ~bits, bits | np.uint32(0x80000000)).astype(np.uint32)


def decode(code: int) -> float:
    code = int(code)
    bits = code ^ 0x80000000 if code >> 31 else ~code & 0xFFFFFFFF
    return float(np.array([bits], dtype=np.uint32).view(np.float32)[0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(level: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each prefix in each row of a level."""
    h = _mix(prefix.astype(np.uint64)[None, :] + _ROWS[level][:, None])
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63) == 1, 1, -1).astype(np.int64)


class DyadicSketch:
    """n values. Unfolded: codes (sorted) and weights. Folded: plain counters and signed rows by level."""

    def __init__(self, codes: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.codes = np.empty(0, np.uint32)
        self.weights = np.empty(0, np.int64)
        self.plain: np.ndarray | None = None
        self.rows: np.ndarray | None = None
        self.n = 0
        if codes is not None:
            self.add(codes, weights)

    @property
    def folded(self) -> bool:
        return self.rows is not None

    def add(self, codes: np.ndarray, weights: np.ndarray | None = None) -> DyadicSketch:
        weights = np.ones(len(codes), np.int64) if weights is None else np.asarray(weights, np.int64)
        self.n += int(weights.sum())
        if self.folded:
            self._into(codes, weights)
            return self
        self.codes, at = np.unique(np.concatenate([self.codes, np.asarray(codes, np.uint32)]), return_inverse=True)
        weights = np.concatenate([self.weights, weights])
        self.weights = np.zeros(len(self.codes), np.int64)
        np.add.at(self.weights, at, weights)
        kept = self.weights != 0
        self.codes, self.weights = self.codes[kept], self.weights[kept]
        if len(self.codes) > CAPACITY:
            self.fold()
        return self

    def fold(self) -> None:
        codes, weights = self.codes, self.weights
        self.plain = np.zeros(2 << PLAIN, np.int64)
        self.rows = np.zeros((BITS - PLAIN, DEPTH, WIDTH), np.int64)
        self.codes, self.weights = np.empty(0, np.uint32), np.empty(0, np.int64)
        self._into(codes, weights)

    def _into(self, codes: np.ndarray, weights: np.ndarray) -> None:
        for level in range(1, BITS + 1):
            prefix = codes >> np.uint32(BITS - level)
            if level <= PLAIN:
                np.add.at(self.plain, (1 << level) + prefix.astype(np.int64), weights)
            else:
                bucket, sign = _cells(level, prefix)
                for r in range(DEPTH):
                    np.add.at(self.rows[level - PLAIN - 1, r], bucket[r], sign[r] * weights)

    def merge(self, other: DyadicSketch) -> DyadicSketch:
        if not other.folded:
            return self.add(other.codes, other.weights)
        if not self.folded:
            codes, weights, n = self.codes, self.weights, self.n
            self.plain, self.rows, self.n = other.plain.copy(), other.rows.copy(), other.n + n
            self.codes, self.weights = np.empty(0, np.uint32), np.empty(0, np.int64)
            self._into(codes, weights)
            return self
        self.plain += other.plain
        self.rows += other.rows
        self.n += other.n
        return self

    def count(self, level: int, prefix: int) -> float:
        """Values in an interval of a level, exact or estimated."""
        if not self.folded:
            width = BITS - level
            low, high = prefix << width, ((prefix + 1) << width) - 1
            i, j = np.searchsorted(self.codes, np.uint32(low), "left"), np.searchsorted(self.codes, np.uint32(high), "right")
            return float(self.weights[i:j].sum())
        if level <= PLAIN:
            return float(self.plain[(1 << level) + prefix])
        bucket, sign = _cells(level, np.array([prefix], np.uint64))
        return float(np.median(self.rows[level - PLAIN - 1, np.arange(DEPTH), bucket[:, 0]] * sign[:, 0]))

    def rank(self, code: int) -> float:
        """Values whose code is less than the given one."""
        code = int(code)
        if code > 0xFFFFFFFF:
            return float(self.n)
        total = 0.0
        for level in range(1, BITS + 1):
            prefix = code >> (BITS - level)
            if prefix & 1:
                total += self.count(level, prefix - 1)
        return min(max(total, 0.0), float(self.n))

    def quantile(self, q: float) -> float | None:
        """The value of rank ceil(q * n), the first one at q = 0; None without values."""
        if self.n <= 0:
            return None
        left, prefix = max(1, int(np.ceil(q * self.n - 1e-9))), 0
        for level in range(1, BITS + 1):
            inside = self.count(level, prefix << 1)
            if left > inside:
                left -= inside
                prefix = (prefix << 1) | 1
            else:
                prefix <<= 1
        return decode(prefix)

    def to_bytes(self) -> bytes:
        if not self.folded:
            return struct.pack("<Bq", 0, self.n) + self.codes.astype("<u4").tobytes() + self.weights.astype("<i8").tobytes()
        return struct.pack("<Bq", 1, self.n) + zlib.compress(self.plain.astype("<i8").tobytes() + self.rows.astype("<i8").tobytes(), 1)

    @classmethod
    def from_bytes(cls, blob: bytes) -> DyadicSketch:
        kind, n = struct.unpack_from("<Bq", blob)
        s = cls()
        s.n = n
        if kind:
            flat = np.frombuffer(zlib.decompress(blob[9:]), "<i8").astype(np.int64)
            s.plain, s.rows = flat[: 2 << PLAIN].copy(), flat[2 << PLAIN :].reshape(BITS - PLAIN, DEPTH, WIDTH).copy()
        else:
            k = (len(blob) - 9) // 12
            s.codes = np.frombuffer(blob, "<u4", k, 9).astype(np.uint32)
            s.weights = np.frombuffer(blob, "<i8", k, 9 + 4 * k).astype(np.int64)
        return s


def _build(keys: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def done(held: list[pd.DataFrame]) -> pd.DataFrame:
        p = pd.concat(held, ignore_index=True)
        group = p.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        first = p.groupby(group)[keys].nth(0).reset_index(drop=True)
        packed = (group.astype(np.uint64) << np.uint64(32)) | encode(p["value"].to_numpy()).astype(np.uint64)
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
        starts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        weights = np.add.reduceat(p["weight"].to_numpy(np.int64)[order], starts)
        packed = packed[starts]
        bounds = np.searchsorted(packed >> np.uint64(32), np.arange(len(first) + 1, dtype=np.uint64))
        codes = (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        blobs = []
        for i in range(len(first)):
            s = DyadicSketch()
            s.codes, s.weights = codes[bounds[i] : bounds[i + 1]], weights[bounds[i] : bounds[i + 1]]
            s.n = int(s.weights.sum())
            if len(s.codes) > CAPACITY:
                s.fold()
            blobs.append(s.to_bytes())
        return first.assign(sketch=blobs)

    held, rows = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            rows += len(batch)
        if rows >= CHUNK:
            yield done(held)
            held, rows = [], 0
    if held:
        yield done(held)


def _merge(keys: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by the keys; one sketch is open at a time, unfolded parts of a key are added together."""
    at, open_ = None, None
    out: list[tuple] = []
    for batch in batches:
        for row in batch[[*keys, "sketch"]].itertuples(index=False, name=None):
            key = tuple(None if x is None or x != x else x for x in row[:-1])
            if open_ is not None and key == at:
                open_.append(row[-1])
                if len(open_) >= FAN_IN:
                    open_ = [_sum(open_)]
                continue
            if open_ is not None:
                out.append((*at, _sum(open_)))
            at, open_ = key, [row[-1]]
        if len(out) >= 512:
            yield pd.DataFrame(out, columns=[*keys, "sketch"])
            out = []
    if open_ is not None:
        out.append((*at, _sum(open_)))
    if out:
        yield pd.DataFrame(out, columns=[*keys, "sketch"])


def _sum(blobs: list[bytes]) -> bytes:
    if len(blobs) == 1:
        return blobs[0]
    sketches = [DyadicSketch.from_bytes(b) for b in blobs]
    loose = [s for s in sketches if not s.folded]
    total = DyadicSketch()
    if loose:
        total.add(np.concatenate([s.codes for s in loose]), np.concatenate([s.weights for s in loose]))
    for s in sketches:
        if s.folded:
            total.merge(s)
    return total.to_bytes()


def build(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Partial sketches per partition. rows: keys, value double (no NULL or NaN), weight bigint (-1 deletes)."""
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    types = f"{schema}, sketch BINARY"
    return rows.select(*keys, "value", "weight").mapInPandas(lambda b: _build(keys, b), types)


def merge(partial: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per key. Two steps: the partials of up to FAN_IN partitions first, so no task merges those of all."""
    schema = ", ".join(f"`{k}` {partial.schema[k].dataType.simpleString()}" for k in keys)
    narrow = partial.select(*keys, "sketch", (F.spark_partition_id() / F.lit(FAN_IN)).cast("int").alias("_part"))
    one = narrow.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part")
    by_part = one.mapInPandas(lambda b: _merge([*keys, "_part"], b), f"{schema}, _part INT, sketch BINARY")
    return by_part.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda b: _merge(keys, b), f"{schema}, sketch BINARY")


def quantiles(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """keys, n, and one column p<percent> for each q."""
    names = [f"p{q * 100:g}".replace(".", "_") for q in qs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            all_ = [DyadicSketch.from_bytes(x) for x in b["sketch"]]
            yield b[keys].assign(n=[s.n for s in all_], **{c: [s.quantile(q) for s in all_] for c, q in zip(names, qs)})

    schema = ", ".join(f"`{k}` {sketches.schema[k].dataType.simpleString()}" for k in keys)
    return sketches.mapInPandas(run, f"{schema}, n BIGINT, {', '.join(f'{c} DOUBLE' for c in names)}")


def shares_at(sketches: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, the value in column `at`, n, below, upto (values less than, and less than or equal to it), counted.

    Every answer is estimated from signed sketches, those of small groups too, so a decision is made alike at every size;
    counted, which tells exact answers, is false throughout.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for blob, code in zip(b["sketch"], encode(b[at].to_numpy())):
                s = DyadicSketch.from_bytes(blob)
                if not s.folded:
                    s.fold()
                rows.append((s.n, s.rank(code), s.rank(int(code) + 1), not s.folded))
            got = pd.DataFrame(rows, columns=["n", "below", "upto", "counted"])
            yield pd.concat([b[[*keys, at]].reset_index(drop=True), got], axis=1)

    schema = ", ".join(f"`{k}` {sketches.schema[k].dataType.simpleString()}" for k in [*keys, at])
    return sketches.mapInPandas(run, f"{schema}, n BIGINT, below DOUBLE, upto DOUBLE, counted BOOLEAN")


# --- the measurements of this project's tables -------------------------------------------------------------------


def measured(metrics: DataFrame) -> DataFrame:
    """package, day, metric, value: measured values, each function and time once; NULL, NaN and -1 left out."""
    once = metrics.groupBy("function_id", "measured_at").agg(F.max(F.struct("loaded_at", "package", "cyclomatic", "risk")).alias("r"))
    wide = once.select(F.col("r.package").alias("package"), F.to_date("measured_at").alias("day"), F.col("r.cyclomatic").cast("double").alias("c"), F.col("r.risk").alias("k"))
    long = wide.select("package", "day", F.expr("stack(2, 'p90_cyclomatic', c, 'p90_risk', k) AS (metric, value)"))
    return long.where("value IS NOT NULL AND NOT isnan(value) AND NOT (metric = 'p90_cyclomatic' AND value = -1)").withColumn("weight", F.lit(1).cast("bigint"))


def suspicious(shares: DataFrame, values: DataFrame, keys: list[str], at: str, low: float = 0.85, high: float = 0.95) -> DataFrame:
    """keys where more than `high` of the values are below the one in `at`, or less than `low` are up to it.

    What a folded sketch puts within EPSILON of a limit is counted from the values; all else is the sketch's.
    """
    near = (F.abs(F.col("below") / F.col("n") - high) <= EPSILON) | (F.abs(F.col("upto") / F.col("n") - low) <= EPSILON)
    tagged = shares.withColumn("open", ~F.col("counted") & near)
    wrong = (F.col("below") > F.lit(high) * F.col("n") + 1e-6) | (F.col("upto") < F.lit(low) * F.col("n") - 1e-6)
    sure = tagged.where("NOT open").where(wrong).select(*keys)
    again = values.join(tagged.where("open").select(*keys, at), keys)
    counted = again.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("value") < F.col(at)).cast("bigint")).alias("below"), F.sum((F.col("value") <= F.col(at)).cast("bigint")).alias("upto"))
    return sure.unionByName(counted.where(wrong).select(*keys))
