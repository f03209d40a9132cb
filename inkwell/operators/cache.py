"""Extraction table: texts by (path, size, modified), kept between searches as Parquet.

Results never depend on it. A changed size or time is another key; the old entry stays until a
maintenance pass. The query isn't part of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.model import CACHE_ENTRY_LIMIT_BYTES, CACHE_LIMIT_BYTES, CACHE_LIMIT_ENTRIES, CACHE_LOW_BYTES, CACHE_LOW_ENTRIES

CACHE_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType()), T.StructField("text", T.StringType())]
)


def same_key(a: DataFrame, b: DataFrame):
    return (a["path"] == b["path"]) & (a["size"] == b["size"]) & a["modified"].eqNullSafe(b["modified"])


def probe(candidates: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their text, misses)."""
    a, b = candidates.alias("a"), cached.dropDuplicates(["path", "size", "modified"]).alias("b")
    on = (F.col("a.path") == F.col("b.path")) & (F.col("a.size") == F.col("b.size")) & F.col("a.modified").eqNullSafe(F.col("b.modified"))
    return a.join(b, on).select("a.*", "b.text"), a.join(b, on, "left_anti").select("a.*")


def probe_few(candidates: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``probe``, for a ``TextCache``: its keys are few by its limits, so they go to the candidates.

    A shuffle would deal the candidates, which are small, into so few tasks that reading the files is not shared out.
    """
    key = ["path", "size", "modified"]

    def on(left: str, right: str):
        return (F.col(f"{left}.path") == F.col(f"{right}.path")) & (F.col(f"{left}.size") == F.col(f"{right}.size")) & F.col(f"{left}.modified").eqNullSafe(F.col(f"{right}.modified"))

    a, keys = candidates.alias("a"), F.broadcast(cached.select(*key).distinct()).alias("k")
    held = F.broadcast(a.join(keys, on("a", "k"), "left_semi")).alias("h")
    hits = held.join(cached.dropDuplicates(key).alias("b"), on("h", "b")).select("h.*", "b.text")
    return hits, a.join(keys, on("a", "k"), "left_anti")


def storable(texts: DataFrame) -> DataFrame:
    """The rows that are kept: errors and texts over the entry limit aren't."""
    return texts.filter(F.col("text").isNotNull() & (F.octet_length("text") <= CACHE_ENTRY_LIMIT_BYTES)).select(*CACHE_SCHEMA.names)


def usage(cached: DataFrame) -> DataFrame:
    return cached.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("path") + F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))


class TextCache:
    """Lives in one folder, in one subfolder per generation, so a pass never overwrites what it reads.

    The newest generation that was written whole is the cache, also for an object made later on the same folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        found = self._generations()
        self._generation, self._filled = max(found, default=0), bool(found)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        path, fs = self._fs()
        if not fs.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.folder))]
        return [int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit() and fs.exists(path(f"{self.folder}/{n}/_SUCCESS"))]

    @property
    def _path(self) -> str:
        return f"{self.folder}/g{self._generation}"

    def table(self) -> DataFrame:
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self._path) if self._filled else self.spark.createDataFrame([], CACHE_SCHEMA)

    def insert(self, texts: DataFrame) -> None:
        """Appends what fits; beyond a limit the entries are chosen before anything is written."""
        new = storable(texts)
        have, more = usage(self.table()).first(), usage(new).first()
        if have["entries"] + more["entries"] <= CACHE_LIMIT_ENTRIES and have["bytes"] + more["bytes"] <= CACHE_LIMIT_BYTES:
            new.write.mode("append").parquet(self._path)
            self._filled = True
        else:
            self._next(self._chosen(self.table().union(new)))

    def _chosen(self, entries: DataFrame) -> DataFrame:
        """Entries in key-hash order while both low marks hold. Every task gives its first keys, without texts, to
        one that orders as many again, so no task holds more than the low mark of them from each."""
        key = ["path", "size", "modified"]
        keys = entries.groupBy(*key).agg(F.max(F.octet_length("path") + F.octet_length("text")).alias("bytes"))
        first = keys.orderBy(F.xxhash64(*key), *key).limit(CACHE_LOW_ENTRIES - 1)
        order = Window.orderBy(F.xxhash64(*key), *key).rowsBetween(Window.unboundedPreceding, 0)
        kept = first.withColumn("_b", F.sum("bytes").over(order)).filter(F.col("_b") <= CACHE_LOW_BYTES)
        a, b = entries.alias("a"), F.broadcast(kept).alias("b")
        on = (F.col("a.path") == F.col("b.path")) & (F.col("a.size") == F.col("b.size")) & F.col("a.modified").eqNullSafe(F.col("b.modified"))
        return a.join(b, on, "left_semi").dropDuplicates(key).select(*CACHE_SCHEMA.names)

    def _next(self, entries: DataFrame) -> None:
        entries.write.mode("overwrite").parquet(f"{self.folder}/g{self._generation + 1}")
        self._generation, self._filled = self._generation + 1, True

    def clear(self) -> None:
        """An empty generation; what still reads the one before can go on."""
        self._next(self.spark.createDataFrame([], CACHE_SCHEMA))

    def vacuum(self) -> None:
        """Removes older generations; only when no result that reads them is in use."""
        path, fs = self._fs()
        for n in self._generations():
            if n < self._generation:
                fs.delete(path(f"{self.folder}/g{n}"), True)

    def __len__(self) -> int:
        return usage(self.table()).first()["entries"]

    def memory_bytes(self) -> int:
        return usage(self.table()).first()["bytes"]
