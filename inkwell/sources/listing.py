"""Directory listing: a pure walker and a Spark data source over it.

Hidden and excluded directories are pruned whole, the root excepted. A link to a file is listed under
its target's path with the link's own size and time; a link to a directory isn't followed.
"""

from __future__ import annotations

import datetime as dt
import os
import pickle
import stat
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkwell.model import CANDIDATE_SCHEMA, EXCLUDED_DIRS, SearchOptions

_EXCLUDED = frozenset(EXCLUDED_DIRS)


def ext_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[1][1:].lower()


def walk(opts: SearchOptions, cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple[str, str, int, dt.datetime | None]]:
    """(path, ext, size, modified) of every candidate; unreadable entries are passed over."""
    root = os.path.realpath(opts.directory) if os.path.exists(opts.directory) else opts.directory
    wanted, most, after = frozenset(opts.extensions), opts.max_bytes, opts.modified_after
    pending = [root]
    while pending:
        try:
            entries = sorted(os.scandir(pending.pop()), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if cancelled():
                return
            if e.name.startswith(".") and not opts.search_hidden:
                continue
            try:
                if e.is_dir(follow_symlinks=False):
                    if opts.recursive and e.name not in _EXCLUDED:
                        pending.append(e.path)
                    continue
                if ext_of(e.name) not in wanted:
                    continue
                info = e.stat(follow_symlinks=False)
                if not stat.S_ISREG(os.stat(e.path).st_mode if e.is_symlink() else info.st_mode):
                    continue
                size, modified = info.st_size, dt.datetime.fromtimestamp(info.st_mtime, dt.timezone.utc)
            except OSError:
                continue
            if most is not None and size > most:
                continue
            if after is not None and modified < (after if after.tzinfo else after.replace(tzinfo=dt.timezone.utc)):
                continue
            path = os.path.realpath(e.path) if e.is_symlink() else e.path  # the folders walked are real already
            yield path, ext_of(path), size, modified


class _Part(InputPartition):
    """Rows of the walk, packed: the driver holds all parts at once."""

    def __init__(self, rows):
        self.packed = zlib.compress(pickle.dumps(rows), 1)

    @property
    def rows(self):
        return pickle.loads(zlib.decompress(self.packed))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda k, d: options.get(k, str(d)).lower() == "true"
        after = options.get("modifiedafter")
        self.opts = SearchOptions(
            directory=options["path"],
            recursive=flag("recursive", True),
            search_hidden=flag("searchhidden", False),
            search_docx=flag("docx", True),
            search_odt=flag("odt", True),
            search_pdf=flag("pdf", True),
            search_txt=flag("txt", True),
            max_file_size_mb=int(options["maxfilesizemb"]) if "maxfilesizemb" in options else None,
            modified_after=dt.datetime.fromisoformat(after) if after else None,
        )
        self.chunk_bytes = int(options.get("chunkbytes", 64 * 1024 * 1024))
        self.open_cost = int(options.get("opencost", 128 * 1024))

    def partitions(self):
        parts, rows, held = [], [], 0
        for row in walk(self.opts):
            rows.append(row)
            held += row[2] + self.open_cost
            if held >= self.chunk_bytes:
                parts.append(_Part(rows))
                rows, held = [], 0
        return [*parts, _Part(rows)] if rows or not parts else parts

    def read(self, partition):
        yield from partition.rows


class CandidateSource(DataSource):
    """``spark.read.format("inkwell_files").load(dir)``: candidates, dealt into partitions by size.

    The folder must be mounted on the driver and the executors under the same path.
    """

    @classmethod
    def name(cls):
        return "inkwell_files"

    def schema(self):
        return CANDIDATE_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def list_candidates(spark: SparkSession, opts: SearchOptions) -> DataFrame:
    spark.dataSource.register(CandidateSource)
    r = spark.read.format("inkwell_files").option("recursive", str(opts.recursive)).option("searchHidden", str(opts.search_hidden))
    for k, v in (("docx", opts.search_docx), ("odt", opts.search_odt), ("pdf", opts.search_pdf), ("txt", opts.search_txt)):
        r = r.option(k, str(v))
    if opts.max_file_size_mb is not None:
        r = r.option("maxFileSizeMb", str(opts.max_file_size_mb))
    if opts.modified_after is not None:
        r = r.option("modifiedAfter", opts.modified_after.isoformat())
    return r.load(str(opts.directory))
