"""A whole search: validate, list, extract (through the cache), match, sort; with progress and cancellation."""

from __future__ import annotations

import itertools
import os
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.labels import file_name, parent_dir
from inkwell.functions.matching import compile_query, snippets, trimmed
from inkwell.model import SearchOptions, SortOrder
from inkwell.operators.cache import TextCache, probe_few
from inkwell.operators.results import as_results, save_csv, sort_results, summary
from inkwell.sources.extract import extract_listed
from inkwell.sources.listing import list_candidates

_ids = itertools.count(1)
RESULT_SCHEMA = "file string, file_type string, matches array<struct<context:string>>, modified timestamp"
ERROR_SCHEMA = "file string, error_code string, error string"


def validate(opts: SearchOptions) -> None:
    if not trimmed(opts.query):
        raise ValueError("the query is blank")
    if not opts.extensions:
        raise ValueError("no file type is selected")
    if not os.path.isdir(opts.directory):
        raise ValueError(f"no such directory: {opts.directory}")


def progress_steps(total: int) -> list[int]:
    """The counts at which progress is told: 0, then every file up to 100 files, else every hundredth, and the total."""
    step = 1 if total <= 100 else total // 100
    return sorted({0, *range(step, total + 1, step), total})


@dataclass
class Search:
    """Handle of one search; ``cancel`` stops its jobs, a newer search of the session does so too."""

    spark: SparkSession
    opts: SearchOptions
    id: int = field(default_factory=lambda: next(_ids))
    cancelled: threading.Event = field(default_factory=threading.Event)
    results: DataFrame | None = None
    errors: DataFrame | None = None
    stats: dict = field(default_factory=dict)

    @property
    def tag(self) -> str:
        return f"inkwell-search-{self.id}"

    def cancel(self) -> None:
        self.cancelled.set()
        self.spark.interruptTag(self.tag)

    def sorted(self, order: SortOrder | int = SortOrder.DATE_DESC) -> DataFrame:
        return sort_results(self.results, order)

    def rows(self, order: SortOrder | int = SortOrder.DATE_DESC) -> DataFrame:
        """The result list as shown: name, folder and count beside the result's own columns."""
        return self.sorted(order).select(file_name(F.col("file")).alias("name"), parent_dir(F.col("file")).alias("folder"), F.size("matches").alias("n_matches"), "*")

    def save(self, path: str, order: SortOrder | int = SortOrder.DATE_DESC) -> int:
        return save_csv(self.results, self.opts.query, path, order)

    def summary(self) -> DataFrame:
        return summary(self.results)


def told(texts: DataFrame, opts: SearchOptions) -> DataFrame:
    """Of extracted files those that match, with ``matches``, or failed, with ``error_code`` and ``error``: both in one pass."""
    pattern = compile_query(opts.query, opts.ignore_case)
    failed = F.col("error_code").isNotNull()
    matches = F.transform(snippets(F.col("text"), pattern, opts.context_size), lambda s: F.struct(s.alias("context")))
    return texts.filter(failed | F.col("text").rlike(pattern)).select("path", "ext", "modified", "error_code", "error", F.when(~failed, matches).alias("matches"))


def run_search(spark: SparkSession, opts: SearchOptions, cache: TextCache | None = None, search: Search | None = None, progress=None) -> Search:
    """Lists, extracts and matches. Errors of single files are rows of ``errors``; a search that is
    cancelled before it starts gives none and counts nothing, one that is cancelled while it runs gives what of
    results and errors was complete by then."""
    validate(opts)
    search = search or Search(spark, opts)
    began = time.monotonic()
    candidates = list_candidates(spark, opts).persist()  # one walk for all that follows
    if search.cancelled.is_set():
        candidates = candidates.limit(0)
    spark.addTag(search.tag)
    total = n_cached = 0
    results, errors = spark.createDataFrame([], RESULT_SCHEMA), spark.createDataFrame([], ERROR_SCHEMA)
    try:
        total = candidates.count()
        if progress:
            progress(0, total)
        hits = None
        if cache is not None and opts.use_cache:
            hits, misses = probe_few(candidates, cache.table())
            n_cached = hits.count()
            texts = extract_listed(misses).persist()  # also for the cache
        else:
            texts = extract_listed(candidates)
        pool = texts if hits is None else texts.unionByName(hits, allowMissingColumns=True)
        kept = told(pool, opts).persist()
        kept.count()
        results = as_results(kept.filter(F.col("error_code").isNull()))
        errors = kept.filter(F.col("error_code").isNotNull()).select(F.col("path").alias("file"), "error_code", "error")
        if hits is not None:
            cache.insert(texts.filter(F.col("error_code").isNull()))
            texts.unpersist()
        if progress:
            progress(total, total)
    except Exception:
        if not search.cancelled.is_set():
            raise
    finally:
        spark.removeTag(search.tag)
    search.results, search.errors = results, errors
    search.stats = {"cached_count": n_cached, "total_count": total, "duration_ms": int((time.monotonic() - began) * 1000)}
    return search


class Session:
    """Runs searches one after another: a new one cancels the one before, even if it then fails validation."""

    def __init__(self, spark: SparkSession, cache: TextCache | None = None):
        self.spark, self.cache, self.current = spark, cache, None

    def search(self, opts: SearchOptions, **kw) -> Search:
        if self.current:
            self.current.cancel()
        self.current = None
        validate(opts)
        self.current = Search(self.spark, opts)
        return run_search(self.spark, opts, self.cache, self.current, **kw)

    def is_current(self, search: Search) -> bool:
        return search is self.current

    def clear(self) -> None:
        if self.current:
            self.current.cancel()
        self.current = None
