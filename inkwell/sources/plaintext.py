"""Plain text from raw bytes, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.model import TXT_LIMIT_BYTES, TXT_SAMPLE_BYTES

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
_CONTROL_SAMPLED = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def decode_plain(content: Column) -> Column:
    """UTF-8 if the whole content is valid, else Latin-1; control characters but tab and line ends become spaces."""
    as_text = content.cast("string")
    text = F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, _CONTROL, " ")


def plain_error(content: Column, size: Column) -> Column:
    """The error code of a plain text file, or null."""
    sample = F.decode(F.substring(content, 1, TXT_SAMPLE_BYTES), "ISO-8859-1")
    n = F.length(sample)
    return (
        F.when(size > TXT_LIMIT_BYTES, "TXT_TOO_LARGE")
        .when(content.isNull(), "IO_READ")
        .when(F.contains(sample, F.lit("\0")), "TXT_NUL")
        .when((n > 32) & (F.regexp_count(sample, F.lit(_CONTROL_SAMPLED)) * 10 > n), "TXT_BINARY")
    )


def _said(code: Column) -> Column:
    return (
        F.when(code == "TXT_TOO_LARGE", "plain text file over the size limit")
        .when(code == "TXT_NUL", "NUL byte: not a text file")
        .when(code == "TXT_BINARY", "too many control characters: not a text file")
        .when(code == "IO_READ", "file can't be read")
    )


def extract_plain(content: Column, size: Column) -> Column:
    """struct<text, error_code, error>, as every extractor gives.

    Content and code are bound through one-element arrays, so that neither is computed for each of the three fields.
    """

    def fields(f: Column) -> Column:
        return F.struct(F.when(f["code"].isNull(), decode_plain(f["c"])).alias("text"), f["code"].alias("error_code"), _said(f["code"]).alias("error"))

    files = F.array(F.struct(content.alias("c"), size.alias("size")))
    coded = F.transform(files, lambda f: F.struct(f["c"].alias("c"), plain_error(f["c"], f["size"]).alias("code")))
    return F.transform(coded, fields)[0]
