"""Remote services as tables: pages of a service as a data source with partitions, and a lookup that asks for each distinct key once and remembers the answers."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


def patiently(call: Callable, attempts: int, wait: float):
    """The call's result; it is tried again after a wait that doubles."""
    for i in range(attempts):
        try:
            return call()
        except OSError:
            if i == attempts - 1:
                raise
            time.sleep(wait * 2**i)
    return None


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        super().__init__((offset, limit))
        self.offset, self.limit = offset, limit


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        module, _, function = options["client"].partition(":")
        self.module, self.function, self.names = module, function, names
        self.asked, self.page = json.loads(options.get("args", "{}")), int(options.get("page", 1000))
        self.attempts, self.wait, self.wanted = int(options.get("attempts", 3)), float(options.get("wait", 1.0)), {}

    def _client(self):
        return getattr(importlib.import_module(self.module), self.function)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with a value goes to the service; Spark tests the others."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.wanted[f.attribute[0]] = f.value
            yield f

    def partitions(self) -> list[Page]:
        total = patiently(lambda: self._client()(self.asked, self.wanted, None, None), self.attempts, self.wait)
        return [Page(at, self.page) for at in range(0, max(total, 1), self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows = patiently(lambda: self._client()(self.asked, self.wanted, partition.offset, partition.limit), self.attempts, self.wait)
        yield from (tuple(r[n] for n in self.names) for r in rows)


class PagedSource(DataSource):
    """Options: ``client``, a function by module and name; ``args``, JSON that it gets; ``page``, rows of a page; ``attempts`` and ``wait`` (seconds) of a call. The client takes (args, wanted, offset, limit), where
    ``wanted`` has values of columns that rows must have, and gives a page's rows as dicts, or their number without an offset. A schema is given by the reader of the table."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options), schema.names)


def paged(spark: SparkSession, client: str, schema: str, args: dict, page: int = 1000) -> DataFrame:
    """The rows of a remote service, each page fetched by a task."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").schema(schema).option("client", client).option("args", json.dumps(args)).option("page", str(page)).load()


def looked_up(rows: DataFrame, key: str, client: Callable[[list], dict], name: str, cache: str, at_once: int = 8, batch: int = 100, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """``rows`` with ``name``, what the service says of their key as JSON (null for one that it doesn't know, or for a null key).

    ``client(keys)`` gives a dict of the keys that it knows. Each distinct key that the table at ``cache`` lacks is asked for once, by ``at_once`` tasks, so as many calls run at a time at most; answers, also
    that a key isn't known, are added to the cache, so a later run asks for new keys only. A call that fails is tried again, then the run fails and adds nothing."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{name}` string"
    read = lambda: spark.read.schema(schema).parquet(cache) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i in range(0, part.num_rows, batch):
                keys = part.column(0).slice(i, batch)
                found = patiently(lambda k=keys.to_pylist(): client(k), attempts, wait)
                said = [None if k not in found else json.dumps(found[k], sort_keys=True) for k in keys.to_pylist()]
                yield pa.RecordBatch.from_arrays([keys, pa.array(said, pa.string())], [key, name])

    wanted = rows.select(key).filter(F.col(key).isNotNull()).distinct().join(read(), key, "left_anti")
    wanted.repartition(at_once, key).mapInArrow(ask, schema).write.mode("append").parquet(cache)
    # runs at the same time may have asked twice
    answers = read().groupBy(key).agg(F.max(name).alias(name))
    return rows.join(answers, key, "left")
