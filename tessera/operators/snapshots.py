"""What changed between full snapshots.

A bucketed key-to-hash index of the last snapshot is kept as a table. A new snapshot is digested into the same
bucketing, probed against the index bucket by bucket, the old values are fetched for changed keys only, and the
index is swapped by replacing a one-line pointer file. Digests travel through one shuffle; the join of the two
index versions needs none, for both are bucketed alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import work_path

KEYS = ["scope", "file", "kind", "receiver", "name"]
#: Kind of the row that says a scope was delivered, so that a delivery without rows is known as well.
DELIVERED = "\x00delivered"


class PointerFile:
    """A small file that names the current version of a state; replacing it is one rename."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark._jvm
        self._path_of = jvm.org.apache.hadoop.fs.Path
        self.path = self._path_of(f"{root}/CURRENT")
        self._fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), spark._jsc.hadoopConfiguration())
        self._overwrite = [jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE]
        self._gateway = spark.sparkContext._gateway
        self._rename_kind = jvm.org.apache.hadoop.fs.Options.Rename

    def read(self) -> str | None:
        if not self._fs.exists(self.path):
            return None
        stream = self._fs.open(self.path)
        try:
            return bytes(stream.readNBytes(4096)).decode().strip() or None
        finally:
            stream.close()

    def swap(self, version: str) -> None:
        """Write beside and rename over: a reader sees the old version or the new one, never a part."""
        beside = self._path_of(f"{self.path}.{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()
        kinds = self._gateway.new_array(self._rename_kind, 1)
        kinds[0] = self._rename_kind.OVERWRITE
        self._context.rename(beside, self.path, kinds)


class SnapshotIndex:
    """Key-to-hash index over the last snapshot of each scope (a scope is delivered as a whole: a repository).

    Rows have the columns of KEYS plus `values`. NULL and '' are the same for every key column. Repeated keys in one
    delivery must be settled before (see `symbols_of`). A scope seen for the first time yields no changes unless
    `initial` is set. An interrupted `advance` leaves the pointer on the old version: the delivery can be given again.
    """

    def __init__(self, spark: SparkSession, values: list[str], root: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.values = values
        self.root = root or work_path(spark, "snapshot-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.pointer = PointerFile(spark, self.root)

    def _register(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            path, ddl = f"{self.root}/{name}", ", ".join(f"{k} STRING" for k in KEYS)
            self.spark.sql(f"CREATE TABLE {name} ({ddl}, version_id INT, vhash BIGINT) USING parquet CLUSTERED BY ({', '.join(KEYS)}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def current(self) -> DataFrame | None:
        name = self.pointer.read()
        return self._register(name) if name else None

    def stage(self, delivery: DataFrame, scopes: DataFrame) -> str:
        """Digest a delivery of the given scopes into a new bucketed version; returns its name. Nothing points to it yet."""
        name = f"snapshot_index_{uuid.uuid4().hex}"
        hashed = F.xxhash64(*(F.coalesce(F.col(v).cast("string"), F.lit("")) for v in self.values)) if self.values else F.lit(0).cast("bigint")
        rows = delivery.select(*(F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEYS), F.col("version_id").cast("int").alias("version_id"), hashed.alias("vhash"))
        marks = scopes.select("scope", *(F.lit(DELIVERED if k == "kind" else "").alias(k) for k in KEYS[1:]), F.col("version_id").cast("int").alias("version_id"), F.lit(0).cast("bigint").alias("vhash"))
        rows = rows.unionByName(marks)
        last = self.current()
        if last is not None:  # scopes that aren't delivered now keep their last snapshot
            rows = rows.unionByName(last.join(scopes.select("scope"), "scope", "left_anti"))
        # the bucketed write clusters by itself; the exchange here uses the same expression, so tasks write one bucket each
        rows.repartition(self.buckets, *KEYS).write.format("parquet").bucketBy(self.buckets, *KEYS).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def probe(self, name: str, scopes: DataFrame) -> DataFrame:
        """Changes of the staged version against the current one: KEYS, version_id (of the later), change."""
        new = self._register(name).alias("n")
        last = self.current()
        if last is None:
            return new.limit(0).select(*KEYS, "version_id", F.lit("").alias("change"))
        seen = last.where(F.col("kind") == DELIVERED).select("scope")
        both = scopes.select("scope", F.col("version_id").cast("int").alias("at")).join(seen, "scope")  # one row per repository
        on = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in KEYS]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        change = F.when(F.col("o.vhash").isNull(), "added").when(F.col("n.vhash").isNull(), "removed").otherwise("modified")
        met = new.join(last.alias("o"), cond, "full_outer").where("NOT (n.vhash <=> o.vhash)")
        keyed = met.select(*(F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in KEYS), change.alias("change"))
        return keyed.join(both, "scope").select(*KEYS, F.col("at").alias("version_id"), "change")

    def rows(self) -> DataFrame | None:
        """The keys of the current version."""
        last = self.current()
        return None if last is None else last.where(F.col("kind") != DELIVERED)

    def swap(self, name: str) -> None:
        self.pointer.swap(name)

    def advance(self, delivery: DataFrame, scopes: DataFrame) -> DataFrame:
        """Stage, probe, keep the changes as a table, swap. Returns the changes.

        scopes (scope, version_id) names what was delivered, so a delivery without rows removes everything.
        """
        name = self.stage(delivery, scopes)
        changes = self.probe(name, scopes)
        path = f"{self.root}/changes-{name}"
        changes.write.mode("overwrite").parquet(path)
        self.swap(name)
        return self.spark.read.schema(changes.schema).parquet(path)


def old_and_new(changes: DataFrame, before: DataFrame, after: DataFrame, values: list[str]) -> DataFrame:
    """Fetch values for the changed keys only: old from `before`, new from `after` (columns old_*, new_*)."""
    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(*(F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEYS), *(F.col(v).alias(f"{tag}_{v}") for v in values))

    return changes.join(side(before, "old"), KEYS, "left").join(side(after, "new"), KEYS, "left")


# --- the deliveries of this project's tables ---------------------------------------------------------------------


def complete_deliveries(snapshots: DataFrame) -> DataFrame:
    """repo, snapshot_id, turn: complete deliveries numbered per repo in order. Incomplete ones are passed over."""
    from pyspark.sql import Window

    kept = snapshots.where("complete").where("repo IS NOT NULL AND snapshot_id IS NOT NULL").select("repo", "snapshot_id").distinct()
    return kept.withColumn("turn", F.row_number().over(Window.partitionBy("repo").orderBy("snapshot_id")))


def symbols_of(symbols: DataFrame) -> DataFrame:
    """One row per snapshot and symbol, the latest loaded_at; NULL receiver and signature become ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = symbols.select("snapshot_id", F.col("repo").alias("scope"), "file", "kind", blank("receiver").alias("receiver"), "name", "loaded_at", blank("signature").alias("signature"), "start_line", "end_line")
    keys = ["snapshot_id", *KEYS]
    return rows.groupBy(*keys).agg(F.max(F.struct("loaded_at", "signature", "start_line", "end_line")).alias("r")).select(*keys, "r.signature", "r.start_line", "r.end_line")


def imports_of(imports: DataFrame) -> DataFrame:
    """Distinct imports as rows of kind `import`; paths trimmed, blank and NULL ones dropped."""
    path = F.regexp_replace("import_path", r"^\s+|\s+$", "")
    rows = imports.select("snapshot_id", F.col("repo").alias("scope"), "file", F.lit("import").alias("kind"), F.lit("").alias("receiver"), path.alias("name")).where("name <> ''")
    empty = rows.withColumns({"signature": F.lit(""), "start_line": F.lit(None).cast(T.IntegerType()), "end_line": F.lit(None).cast(T.IntegerType())})
    return empty.distinct()


def deliveries(symbols: DataFrame, imports: DataFrame, snapshots: DataFrame) -> DataFrame:
    """All rows of complete deliveries with their turn."""
    rows = symbols_of(symbols).unionByName(imports_of(imports))
    turns = complete_deliveries(snapshots)  # one row per delivery
    return rows.join(turns.withColumnRenamed("repo", "scope"), ["scope", "snapshot_id"]).withColumn("version_id", F.col("snapshot_id"))


VALUES = ["signature", "start_line", "end_line"]


def all_changes(spark: SparkSession, symbols: DataFrame, imports: DataFrame, snapshots: DataFrame, root: str | None = None) -> DataFrame:
    """Every delivery taken in turn through a SnapshotIndex; the union of the changes.

    The loop runs once per turn (the number of deliveries of one repository), over all repositories at once. The
    deliveries are settled once into a table partitioned by turn, so a turn reads only its own rows. A repository
    missing in a turn keeps its last snapshot; empty tables give no rows.
    """
    path = work_path(spark, "deliveries")
    staged = deliveries(symbols, imports, snapshots)
    staged.write.partitionBy("turn").parquet(path)
    order = complete_deliveries(snapshots).select(F.col("repo").alias("scope"), F.col("snapshot_id").alias("version_id"), "turn")
    turns = order.agg(F.max("turn").alias("n")).first()["n"] or 0  # one number
    index = SnapshotIndex(spark, VALUES, root)
    rows = spark.read.schema(staged.schema).parquet(path)
    out = None
    for turn in range(1, turns + 1):
        changes = index.advance(rows.where(F.col("turn") == turn), order.where(F.col("turn") == turn))
        out = changes if out is None else out.unionByName(changes)
    if out is None:
        out = rows.limit(0).select(*KEYS, "version_id", F.lit("").alias("change"))
    return out
