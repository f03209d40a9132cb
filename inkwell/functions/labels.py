"""Presentation columns: paths, dates, counts, types and CSV fields."""

from __future__ import annotations

import os
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.model import FLAT_ODF_EXTS, MAX_MATCHES_PER_FILE, PACKED_ODF_EXTS, PDF_EXTS, PLAIN_EXTS, WORD_EXTS

#: Badge colour names by display type; anything else is grey.
BADGES = {"DOCX": "blue", "ODT": "green", "FODT": "green", "PDF": "orange", "TXT": "purple"}
MATCH_WORDS = {"en": ("matches", "Match"), "fi": ("osumaa", "Osuma")}


def truncate_path(path: Column, limit: int) -> Column:
    keep = max(limit - 3, 0)
    tail = F.substring(path, -keep, keep) if keep else F.lit("")
    return F.when(F.length(path) <= limit, path).otherwise(F.concat(F.lit("..."), tail))


def file_uri(path: Column) -> Column:
    """``file://`` and the path with every byte but ``A-Za-z0-9-_.~/`` percent-encoded."""
    out = F.url_encode(path)
    for old, new in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit("file://"), out)


def clean_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def resolve_directory(text: str) -> str:
    """A directory as typed: quotes and blanks off, ``~`` expanded, links resolved where possible."""
    text = text.strip().strip("\"'").strip()
    if not text:
        text = "."
    if text == "~" or text[:2] in ("~/", "~\\"):
        text = posixpath.join(os.path.expanduser("~"), text[2:])
    return os.path.realpath(text) if os.path.exists(text) else text


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def date_label(modified: Column) -> Column:
    return F.coalesce(F.date_format(modified, "dd.MM.yyyy HH:mm"), F.lit(""))


def count_label(n: Column, lang: str = "en") -> Column:
    word = MATCH_WORDS[lang][0]
    return F.when(n >= MAX_MATCHES_PER_FILE, f"{MAX_MATCHES_PER_FILE}+ {word}").otherwise(F.concat(n.cast("string"), F.lit(f" {word}")))


def ordinal_label(k: Column, lang: str = "en") -> Column:
    return F.concat(F.lit(f"{MATCH_WORDS[lang][1]} #"), k.cast("string"))


def type_label(ext: Column) -> Column:
    return (
        F.when(ext.isin(*WORD_EXTS), "DOCX")
        .when(ext.isin(*PACKED_ODF_EXTS), "ODT")
        .when(ext.isin(*FLAT_ODF_EXTS), "FODT")
        .when(ext.isin(*PDF_EXTS), "PDF")
        .when(ext.isin(*PLAIN_EXTS), "TXT")
        .otherwise(F.upper(ext))
    )


def badge(label: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv])[label], F.lit("grey"))


def csv_field(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def cache_label(files: Column, size: Column) -> Column:
    return F.format_string("Cache: %d files (%.1f MB)", files, size / (1024.0 * 1024.0))


def progress_label(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.0f%% (%d/%d)", done * 100.0 / total, done, total)).otherwise("Scanning...")
