"""Several tables that change together: a run writes its rows beside what is there, and one manifest file makes them all visible at once.

Under the root, ``runs/run=<run>/kind=<table>`` holds what a run wrote, with a table ``_owners`` of the owners (say, forms) that it replaces, and ``manifest/`` a file
for each run that was committed, named by its place in the order. A row is visible if no later run replaced its owner. A run that broke off has no
manifest and shows nothing; repeated under the same name it writes anew, and once committed it is left as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CommittedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Names of the committed runs, oldest first."""
        at, files = self._files("manifest")
        names = sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []
        return [n.partition("-")[2] for n in names if not n.startswith("_")]

    def stage(self, run: str, rows: DataFrame) -> None:
        """Writes the rows of all tables (``kind`` and ``owner``, and columns of any table) in one pass; nothing of it is visible yet. Tables are few: a task holds a file of each open,
        else Spark sorts all rows by them first (as it does where there are more)."""
        name = "spark.sql.maxConcurrentOutputFileWriters"
        old = self.spark.conf.get(name)
        self.spark.conf.set(name, "16")
        try:
            rows.write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/runs/run={run}")
        finally:
            self.spark.conf.set(name, old)

    def commit(self, run: str) -> None:
        """The only step that changes what readers see: a file moves to its place. One writer at a time."""
        done = self.runs()
        if run in done:
            return
        draft, files = self._files(f"manifest/_draft-{run}")
        files.create(draft, True).close()
        if not files.rename(draft, self._files(f"manifest/{len(done):08d}-{run}")[0]):
            raise RuntimeError(f"another run was committed meanwhile; repeat {run}")

    def replace(self, run: str, rows: DataFrame, owners: DataFrame) -> None:
        """``rows`` (kind, owner, ...) in place of all rows of ``owners`` (owner), which may have none. Names of runs tell them apart: a committed one isn't written again."""
        if run not in self.runs():
            self.stage(run, rows.unionByName(owners.select(F.lit("_owners").alias("kind"), "owner"), allowMissingColumns=True))
            self.commit(run)

    def _rows(self, schema: str, kind: str) -> DataFrame:
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], f"{schema}, run int")
        fields = T.StructType.fromDDL(schema).names
        read = self.spark.read.schema(f"{schema}, run string, kind string").option("basePath", f"{self.root}/runs").parquet(*[f"{self.root}/runs/run={n}" for n in names])
        place = F.array_position(F.array(*map(F.lit, names)), F.col("run"))
        return read.filter(F.col("kind") == kind).select(*fields, place.cast("int").alias("run"))

    def table(self, kind: str, schema: str) -> DataFrame:
        """The visible rows of a table. ``schema``: its columns with types, ``owner`` among them. Owners are few against their rows; each one's newest run decides."""
        names = self.runs()
        rows = self._rows(schema, kind)
        if len(names) < 2:
            return rows.drop("run")
        # nothing follows the newest run, so its rows are all visible and meet no owners
        newest = self._rows("owner long", "_owners").groupBy("owner").agg(F.max("run").alias("run"))
        older = rows.filter(F.col("run") < len(names)).join(newest, ["owner", "run"], "left_semi")
        return rows.filter(F.col("run") == len(names)).unionByName(older).drop("run")

    def compact(self, run: str, schemas: dict[str, str]) -> None:
        """Writes the visible rows of all tables as one new run, so that readers needn't look past replaced ones."""
        if run in self.runs():
            return
        rows = self._rows("owner long", "_owners").select("owner").distinct().withColumn("kind", F.lit("_owners"))
        for kind, schema in schemas.items():
            rows = rows.unionByName(self.table(kind, schema).withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        self.stage(run, rows)
        self.commit(run)
