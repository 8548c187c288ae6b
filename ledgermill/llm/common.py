"""What the operators of this subpackage share: work tables in the cluster's shared folder, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most ids that are broadcast; 16 MB as longs. Beyond it a join shuffles both sides.
MAX_BROADCAST_IDS = 2_000_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgermill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Work:
    """Work tables of one run of an operator: written as Parquet to the shared folder, so a lost executor loses none of
    them. ``drop`` removes those that nothing lazy reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.at}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._path(name)
            files.delete(path, True)

    def drop_all_but(self, *names: str) -> None:
        path, files = self._path()
        self.drop(*(f.getPath().getName() for f in files.listStatus(path) if f.getPath().getName() not in names))


def with_ids(df: DataFrame, ids: DataFrame, on: list[str], how: str, n_ids: int, most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Join that moves ``df`` only if there are more than ``most`` ids; ``n_ids`` is their counted number."""
    return df.join(F.broadcast(ids) if n_ids <= most else ids.hint("merge"), on, how)


def with_groups(df: DataFrame, groups: DataFrame, key: str, large: int) -> DataFrame:
    """``df`` with the columns of its key's row in ``groups`` (one row a key, with k, the key's number of rows in ``df``), or nulls.

    Keys of more than ``large`` rows, of which there are few, are broadcast (100,000 at most, the largest), so that no task gets all rows of
    one; the others are joined by a shuffle. ``df`` and ``groups`` are read twice, so they should be written tables."""
    top = groups.filter(F.col("k") > large).orderBy(F.desc("k"), key).limit(100_000)
    n = top.count()
    if not n:
        return df.join(groups.hint("merge"), key, "left")
    names = top.select(key)
    hot = df.join(F.broadcast(top), key)
    rest = df.filter(F.col(key).isNull()).unionByName(df.join(F.broadcast(names), key, "left_anti").filter(F.col(key).isNotNull()))
    return hot.unionByName(rest.join(groups.join(F.broadcast(names), key, "left_anti").hint("merge"), key, "left"))


def held_out(modulus: int, doc_id=None):
    """True where crc32 of the id as text leaves remainder 2; a null id is never held out."""
    key = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rare_below(counts: DataFrame, most: int, n: str = "n") -> int:
    """The least count c such that at most ``most`` rows of ``counts`` have ``n >= c``: bounds what is broadcast.

    A histogram of the counts decides (exact up to 1023, then 32 steps per doubling), so no rows are sorted or gathered."""
    step = F.when(F.col(n) < 1024, F.col(n).cast("long")).otherwise(1024 + F.floor((F.log2(n) - 10) * 32)).alias("step")
    left, c = most, 0
    for r in sorted(counts.groupBy(step).agg(F.count("*").alias("k"), F.min(n).alias("low")).collect(), key=lambda r: -r.step):
        left -= r.k
        if left < 0:
            return c or int(r.low) + 10**18
        c = int(r.low)
    return c


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Arrow batches of this session have at most so many rows; a smaller setting stays. The buffers in which texts
    go to Python stay with the executor and its workers, so whole batches of long texts are what an operator's memory depends on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; a null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def frugal(run):
    """A function over Arrow batches that gives its memory back at the end of a task; Python workers are kept for later ones."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def slices(batches, rows: int = 500):
    """Arrow batches in smaller ones, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
