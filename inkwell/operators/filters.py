"""Metadata filters as column predicates, for tables of files that were listed elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.model import EXCLUDED_DIRS, SearchOptions


def _dirs_below(path: Column, root: str) -> Column:
    """The directory names between ``root`` and the file."""
    rel = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    names = F.split(rel, "/")
    return F.slice(names, 1, F.size(names) - 1)


def not_hidden(path: Column, root: str) -> Column:
    rel = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    return ~F.exists(F.split(rel, "/"), lambda s: s.startswith("."))


def not_excluded(path: Column, root: str) -> Column:
    return ~F.arrays_overlap(_dirs_below(path, root), F.array(*map(F.lit, EXCLUDED_DIRS)))


def direct_child(path: Column, root: str) -> Column:
    return F.size(_dirs_below(path, root)) == 0


def extension_of(name: Column) -> Column:
    """Lower-cased text after the last dot of a name that has one past its first character."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def within_size(size: Column, opts: SearchOptions) -> Column:
    return F.lit(True) if opts.max_bytes is None else size <= opts.max_bytes


def modified_since(modified: Column, opts: SearchOptions) -> Column:
    """An unknown time passes only if no bound is set."""
    return F.lit(True) if opts.modified_after is None else modified >= F.lit(opts.modified_after)


def candidate_filter(opts: SearchOptions, root: str | None = None, path: str = "path", ext: str = "ext", size: str = "size", modified: str = "modified") -> Column:
    """All metadata filters of a search as one predicate."""
    root = opts.directory if root is None else root
    p = F.col(path)
    out = not_excluded(p, root) & F.col(ext).isin(*opts.extensions) & within_size(F.col(size), opts) & modified_since(F.col(modified), opts)
    if not opts.search_hidden:
        out &= not_hidden(p, root)
    return out if opts.recursive else out & direct_child(p, root)
