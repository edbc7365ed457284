"""A table whose rows are replaced by key: versioned folders, and a manifest that says which of them count.

A write goes to a folder of its own and is entered in the manifest when all of it lies there, so an attempt that fails
leaves nothing that a reader sees, and one that is repeated leaves one row for each key.  Rows of a part (a run, or a
range of keys) lie in a folder of that part within each version, so a reader of some parts touches no other file, and a
part can be dropped or replaced alone.

    path/manifest                       (part, version, seq, replaces, rows): one small file for each write
    path/data/version=v.../part=p...    Parquet files
"""

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from assayer.operators.joins import join_by_size

MANIFEST = "part string, version string, seq long, replaces boolean, rows long"


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Store:
    """Rows of `schema` under `path`, one for each `key` within a part.

    `part` names the columns that choose a part: with all digits each value of them is a part of its own; with fewer,
    values share 16 ** digits parts, which bounds their number.  Writers of one part take turns; other parts are free.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: list[str], part: list[str], digits: int = 32):
        self.spark, self.path, self.key, self.by, self.digits = spark, path.rstrip("/"), key, part, digits
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.names = self.schema.fieldNames()

    def part_of(self, *cols: Column) -> Column:
        values = [F.coalesce(c.cast("string"), F.lit("\0")) for c in cols]
        return F.concat(F.lit("p"), F.substring(F.md5(F.concat_ws("|", *values)), 1, self.digits))

    def manifest(self) -> DataFrame:
        return read_if_there(self.spark, f"{self.path}/manifest", MANIFEST)

    def live(self, parts: Iterable[str] | None = None) -> list[tuple[str, str, int]]:
        """(part, version, seq) of every layer that counts: those since the part was last replaced or dropped."""
        m = self.manifest()
        if parts is not None:
            m = m.filter(F.col("part").isin(*parts))
        last = Window.partitionBy("part")
        m = m.withColumn("since", F.coalesce(F.max(F.when(F.col("replaces"), F.col("seq"))).over(last), F.lit(0)))
        return [(r.part, r.version, r.seq) for r in m.filter("seq >= since and version is not null").collect()]  # a row for each layer of a part

    def _enter(self, rows: list[tuple], replaces: bool) -> None:
        seq = (self.manifest().agg(F.max("seq")).first()[0] or 0) + 1
        self.spark.createDataFrame([(part, version, seq, replaces, n) for part, version, n in rows], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def stage(self, rows: DataFrame) -> str:
        """Write a version without entering it; nobody reads it yet.  Of rows with one key, one stays."""
        version = f"v{uuid.uuid4().hex}"
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        typed = typed.dropDuplicates(list(dict.fromkeys([*self.by, *self.key])))
        # rows of a part meet before they are written, or each task would leave a file in each part; a large part is split again by its bytes
        typed.withColumn("part", self.part_of(*map(F.col, self.by))).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/data/version={version}")
        return version

    def commit(self, version: str, replaces: bool = False) -> None:
        written = read_if_there(self.spark, f"{self.path}/data/version={version}", "part string").groupBy("part").agg(F.count("*").alias("n"))
        rows = [(r.part, version, r.n) for r in written.collect()]  # a row for each part written
        if rows:
            self._enter(rows, replaces)

    def put(self, rows: DataFrame, replaces: bool = False) -> None:
        """Add or replace rows by key; with `replaces` the parts written hold nothing else afterwards."""
        self.commit(self.stage(rows), replaces)

    def read(self, parts: Iterable[str] | None = None) -> DataFrame:
        """The newest row of each key; with `parts` only their folders are read."""
        live = self.live(parts)
        if not live:
            return self.spark.createDataFrame([], self.schema)
        versions = sorted({v for _, v, _ in live})
        stored = StructType.fromDDL("version string, part string, seq long")
        whole = StructType([*self.schema.fields, stored["version"], stored["part"]])
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/version={v}" for v in versions])
        if parts is not None:
            rows = rows.filter(F.col("part").isin(*{p for p, _, _ in live}))
        rows = join_by_size(rows, self.spark.createDataFrame([(v, p, s) for p, v, s in live], stored), ["version", "part"])
        layers: dict[str, int] = {}
        for p, _, _ in live:
            layers[p] = layers.get(p, 0) + 1
        several = [p for p, n in layers.items() if n > 1]
        if not several:
            return rows.select(*self.names)
        mixed = self.spark.createDataFrame([(p,) for p in several], "part string")
        newest = F.row_number().over(Window.partitionBy("part", *self.key).orderBy(F.desc("seq"), "version"))
        over = join_by_size(rows, mixed, ["part"], "left_semi").withColumn("_newest", newest).filter("_newest = 1")
        return join_by_size(rows, mixed, ["part"], "left_anti").select(*self.names).unionByName(over.select(*self.names))

    def compact(self) -> None:
        """Parts of several layers become one layer again."""
        layers: dict[str, int] = {}
        for p, _, _ in self.live():
            layers[p] = layers.get(p, 0) + 1
        several = [p for p, n in layers.items() if n > 1]
        if several:
            self.put(self.read(several), replaces=True)

    def drop(self, parts: list[str]) -> None:
        """Parts go: from the manifest first, so no reader meets half a part, then their folders; no other file is touched."""
        if not parts:
            return
        folders = [f"{self.path}/data/version={r.version}/part={r.part}" for r in self.manifest().filter(F.col("part").isin(*parts) & F.col("version").isNotNull()).select("version", "part").distinct().collect()]
        self._enter([(p, None, 0) for p in parts], True)
        remove(self.spark, folders)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders through the file system that owns them.  Spark has no call for this, so it needs a session of its own JVM."""
    for folder in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
