"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, white space collapsed, digits as 0) and hashed. Per host the
number of distinct documents with each line is counted: documents of equal text count once, so copies
don't make their own lines frequent. A line in more than ``min_docs`` documents of its host is removed,
however large the host is: a share of the host would let passages in a few per cent of a large one
stay. A document is depleted, and rejected, when fewer than ``min_words`` words or less than
``min_left`` of its words remain.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own;
blank lines are never counted or removed; repeated rows are rows of their own; extra columns stay.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, Scratch, table, text_or_empty

MIN_DOCS = 20
MIN_WORDS, MIN_LEFT = 50, 0.5
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(x for x in range(256) if x not in _SYMBOLS)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.btrim(F.regexp_replace(line, r"[\x09-\x0D ]+", " "))), "[0-9]+", "0"), r"\x00", ""))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    chars = sum(len(x) for x in words)
    chars -= len(raw.translate(None, bytes(x for x in range(256) if not 0x80 <= x < 0xC0)))  # continuation bytes stand in words only
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else ()
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = {w for w, k in Counter(windows).items() if k > 1}
            hit = np.fromiter((w in often for w in windows), bool, n - 2)
            repeat = int((np.r_[hit, False, False] | np.r_[False, hit, False] | np.r_[False, False, hit]).sum())
    return n, chars, symbols, dup, repeat


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counting(batches):
    """The text column gives way to its counts; every other column passes."""
    for b in batches:
        at = b.schema.get_field_index("text")
        got = np.array([base_counts(t) for t in b.column(at).to_pylist()], np.int64).reshape(-1, 5)
        rest = [b.column(k) for k in range(b.num_columns) if k != at]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(got[:, k]) for k in range(5))], names=[*(x for x in b.schema.names if x != "text"), *_COUNTS])


def line_frequency(docs: DataFrame, scratch: Scratch, host: str = "source", min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, removed_lines (hashes), words_left, base_failed, kept."""
    body = text_or_empty()
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    each = F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("w")))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.col(host).alias("host"), F.xxhash64(body).alias("same"), each.alias("lines"), F.col("text").alias("text"))
    schema = "doc_id long, rid long, host string, same long, lines array<struct<h:long,w:long>>, " + ", ".join(f"{c} long" for c in _COUNTS)
    meta = scratch.cut(rows.mapInArrow(_counting, schema), "meta")

    # documents of equal text count once: their rows collapse before anything is exploded
    texts = meta.groupBy("host", "same").agg(F.first("lines").alias("lines"))
    counted = texts.select("host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    frequent = scratch.cut(counted.filter(F.col("docs") > min_docs).select(F.col("host").alias("fhost"), F.col("h").alias("fh")), "frequent")

    cells = meta.select("rid", "host", F.explode("lines").alias("l")).select("rid", "host", "l.h", "l.w")
    hit = cells.join(frequent, (F.col("h") == F.col("fh")) & F.col("host").eqNullSafe(F.col("fhost")))
    removed = hit.groupBy("rid").agg(F.sum("w").alias("gone"), F.collect_set("h").alias("removed_lines"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("gone").isNotNull() & ((left < min_words) | (left < min_left * F.col("n_words")))
    return meta.drop("lines", "same").join(removed, "rid", "left").select("doc_id", *_COUNTS, F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"), left.alias("words_left"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text less every line whose hash is in ``removed``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(WORD) | ~F.array_contains(removed, line_hash(x))), "\n")


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_frequency(table(spark, sf_dir, "documents"), Scratch(spark, "lines"))
    return out.select("doc_id", *_COUNTS, "base_failed", "kept", "words_left", F.size("removed_lines").cast("long").alias("n_removed_lines"))
