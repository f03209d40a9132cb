"""Token counts by a two-tier lookup on the map side.

First every partition sums up its pre-tokens and passes on its most frequent ones, a bounded summary; the
corpus's most frequent pre-tokens and their lengths are packed into one compact table and broadcast.
Then every text is counted where it lies: frequent pre-tokens from the table, the rest through the
worker's cache. No pre-token of a text is shuffled. The table changes speed only, never a count.

Defined cases: a null text counts as empty, with 0 tokens; special strings inside texts are handled as
the library does by default; repeated rows are rows of their own; extra columns are left alone.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import table, text_or_empty
from inkwell.llm.tokens import CACHE_CHARS, tokenizer_path, worker_pieces

#: Pre-tokens in the broadcast table, and in the summary of one partition.
TABLE_ENTRIES, SUMMARY_ENTRIES = 1 << 15, 1 << 12
#: Pre-tokens that a partition counts at once; when full, those seen once go.
COUNTER_ENTRIES = 1 << 18
LIMIT = 2048


def _summaries(path: str, word: bool):
    def run(batches):
        pieces, seen = worker_pieces(path, word), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(pieces.pieces(t) or ())
                if len(seen) > COUNTER_ENTRIES:
                    seen = Counter({k: n for k, n in seen.items() if n > 1} if any(n > 1 for n in seen.values()) else {})
                    if len(seen) > COUNTER_ENTRIES // 2:
                        seen = Counter(dict(seen.most_common(COUNTER_ENTRIES // 2)))
        top = [(k, n) for k, n in seen.most_common(SUMMARY_ENTRIES) if len(k) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    return run


def frequent_lengths(texts: DataFrame, path: str, word: bool) -> bytes:
    """The packed table; at most TABLE_ENTRIES pre-tokens of at most CACHE_CHARS characters."""
    top = texts.mapInArrow(_summaries(path, word), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    names = sorted(r.piece for r in top.orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect())
    pieces = worker_pieces(path, word)
    lengths = np.array([pieces._counts[p] for p in names], "<u2")
    return zlib.compress(len(names).to_bytes(4, "little") + lengths.tobytes() + "\n".join(names).encode())


def unpack_lengths(packed: bytes) -> dict[str, int]:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    return dict(zip(raw[4 + 2 * n :].decode().split("\n"), np.frombuffer(raw, "<u2", n, 4).tolist()))


def _counting(path: str, word: bool, packed, key: str, keep: int):
    def run(batches):
        pieces = worker_pieces(path, word, key, lambda: unpack_lengths(packed.value))
        for b in batches:
            counts = [pieces.count(t) for t in b.column(keep).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(counts, pa.int64())], names=[*b.schema.names[:keep], "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, word: bool, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its key, n_bytes, n_tokens."""
    spark = docs.sparkSession
    body = text_or_empty(text)
    table_bytes = frequent_lengths(docs.select(body.alias("text")), path, word)
    packed = spark.sparkContext.broadcast(table_bytes)
    rows = docs.select(F.col(key).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_counting(path, word, packed, f"{zlib.crc32(table_bytes)}", 2), f"doc_id {kind}, n_bytes long, n_tokens long")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), True)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
