"""Searches over real files: every document is written as a file of its type, then walked, read and matched."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.model import SearchOptions
from inkwell.operators.cache import TextCache
from inkwell.plans.search import Search, run_search


def _base(spark: SparkSession) -> str:
    """A new folder that driver and executors see under one path: below spark.checkpoint.dir where that is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        shared = shared.removeprefix("file://").removeprefix("file:")
        if not os.path.isdir(shared):
            raise ValueError("files can be walked only where spark.checkpoint.dir is a mounted folder")
    elif not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    out = os.path.realpath(tempfile.mkdtemp(prefix="inkwell-files-", dir=shared or None))
    atexit.register(shutil.rmtree, out, True)
    return out


def write_tree(spark: SparkSession, files: DataFrame, make) -> str:
    """Writes ``make(ext, text)`` for every row of ``files`` (path, ext, text) below a new folder, and names it."""
    base = _base(spark)

    def run(batches):
        made = set()
        for b in batches:
            for path, ext, text in zip(*(c.to_pylist() for c in b.columns)):
                if (folder := os.path.dirname(base + path)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(base + path, "wb") as out:
                    out.write(make(ext, text))
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    files.select("path", "ext", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return base


def _shown(base: str, df: DataFrame, *columns) -> DataFrame:
    return df.select(F.substring("file", len(base) + 1, 1 << 30).alias("file"), *columns)


def search_files(spark: SparkSession, base: str, root: str, query: str, cache: TextCache | None = None) -> Search:
    return run_search(spark, SearchOptions.app_preset(directory=base + root, query=query), cache)


def found(base: str, search: Search) -> DataFrame:
    return _shown(base, search.results, "file_type", F.size("matches").cast("long").alias("n_matches"))


def failed(base: str, search: Search) -> DataFrame:
    return _shown(base, search.errors, "error_code")


def found_again(spark: SparkSession, base: str, root: str, first: str, query: str) -> DataFrame:
    """A second query over the same files, through a cache that another object filled; the texts it doesn't hold are read."""
    folder = f"{base}/cache"
    search_files(spark, base, root, first, TextCache(spark, folder))
    again = search_files(spark, base, root, query, TextCache(spark, folder))
    return found(base, again).withColumn("cache_used", F.lit(again.stats["cached_count"] > 0))
