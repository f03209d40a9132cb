"""Result rows of a search: matching, orders, summaries and the CSV sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.labels import csv_field, file_name, type_label
from inkwell.functions.matching import compile_query, match_count, snippets
from inkwell.model import CONTEXT_DEFAULT, MAX_MATCHES_PER_FILE, SortOrder

CSV_HEADER = "query,file,file_type,match_number,context"


def match_rows(texts: DataFrame, query: str, ignore_case: bool = False, context_size: int = CONTEXT_DEFAULT, limit: int | None = MAX_MATCHES_PER_FILE) -> DataFrame:
    """Keeps the rows whose ``text`` holds ``query``; replaces text by ``matches``: array<struct<context>>.

    The cheap test comes first, so only rows that match pay for their snippets.
    """
    pattern = compile_query(query, ignore_case)
    keep = [c for c in texts.columns if c != "text"]
    hit = F.lit(False) if pattern is None else F.col("text").rlike(pattern)
    return texts.filter(hit).select(*keep, F.transform(snippets(F.col("text"), pattern, context_size, limit), lambda s: F.struct(s.alias("context"))).alias("matches"))


def match_counts(texts: DataFrame, query: str, ignore_case: bool = False, limit: int | None = MAX_MATCHES_PER_FILE) -> DataFrame:
    """As ``match_rows``, with ``n_matches`` instead of the matches: orders and totals need no snippets."""
    pattern = compile_query(query, ignore_case)
    keep = [c for c in texts.columns if c != "text"]
    hit = F.lit(False) if pattern is None else F.col("text").rlike(pattern)
    return texts.filter(hit).select(*keep, match_count(F.col("text"), pattern, limit).alias("n_matches"))


def as_results(matched: DataFrame) -> DataFrame:
    return matched.select(F.col("path").alias("file"), type_label(F.col("ext")).alias("file_type"), "matches", "modified")


def sort_keys(order: SortOrder | int, file: str = "file", modified: str = "modified", matches: Column | None = None) -> list[Column]:
    """Paths compare component by component, hence the split."""
    tie = F.split(F.col(file), "/").asc()
    order = SortOrder.from_index(int(order))
    if order is SortOrder.DATE_DESC:
        return [F.desc_nulls_last(modified), tie]
    if order is SortOrder.DATE_ASC:
        return [F.asc_nulls_last(modified), tie]
    if order is SortOrder.NAME:
        return [F.lower(file_name(F.col(file))).asc_nulls_first(), tie]
    return [(F.size("matches") if matches is None else matches).desc(), tie]


def sort_results(results: DataFrame, order: SortOrder | int = SortOrder.DATE_DESC) -> DataFrame:
    return results.orderBy(*sort_keys(order))


def explode_matches(results: DataFrame) -> DataFrame:
    """One row per match, numbered from 1 within its file.

    The outer form, as Spark infers a filter on the array from the inner one and then computes every snippet twice.
    """
    return results.select(*[c for c in results.columns if c != "matches"], F.posexplode_outer("matches").alias("_k", "_m")).filter("_k IS NOT NULL").select("*", (F.col("_k") + 1).alias("match_number"), F.col("_m.context").alias("context")).drop("_k", "_m")


def csv_lines(results: DataFrame, query: str) -> DataFrame:
    rows = explode_matches(results)
    line = F.concat_ws(",", csv_field(F.lit(query)), csv_field(F.col("file")), csv_field(F.col("file_type")), F.col("match_number").cast("string"), csv_field(F.col("context")))
    return rows.select("file", "match_number", line.alias("line"))


def save_csv(results: DataFrame, query: str, path: str, order: SortOrder | int = SortOrder.DATE_DESC) -> int:
    """One UTF-8 file with a byte-order mark on the driver's disk; partitions stream through in order.

    The header isn't quoted, every string is, the number isn't. Without results nothing is written
    and ValueError is raised.
    """
    rows = csv_lines(sort_results(results, order), query).select("line").toLocalIterator(prefetchPartitions=True)
    first = next(rows, None)
    if first is None:
        raise ValueError("no results to save")
    n = 1
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("﻿" + CSV_HEADER + "\n" + first[0] + "\n")
        for n, row in enumerate(rows, 2):  # noqa: B007
            out.write(row[0] + "\n")
    return n


def summary(results: DataFrame) -> DataFrame:
    """Totals of results, or of counts by ``match_counts``."""
    n = F.col("n_matches") if "n_matches" in results.columns else F.size("matches")
    return results.agg(F.count(F.lit(1)).alias("files_with_matches"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_matches"))
