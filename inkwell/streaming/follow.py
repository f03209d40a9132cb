"""An extension: the same search over files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.model import SearchOptions
from inkwell.operators.filters import candidate_filter
from inkwell.operators.results import as_results, match_rows
from inkwell.sources.extract import extract_files


def follow(spark: SparkSession, opts: SearchOptions, max_files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of result rows; start it with ``writeStream``. Each file is read once."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", str(opts.recursive).lower()).option("maxFilesPerTrigger", max_files_per_trigger).load(opts.directory)
    path = F.regexp_replace("path", r"^file:/+", "/")
    files = raw.select(path.alias("path"), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").filter(candidate_filter(opts))
    texts = extract_files(files).filter(F.col("error_code").isNull()).select("path", "ext", "size", "modified", "text")
    return as_results(match_rows(texts, opts.query, opts.ignore_case, opts.context_size))
