"""Text extraction: native for plain text, one Arrow-batched function for the other formats."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.model import EXTRACT_SCHEMA, FLAT_ODF_EXTS, PACKED_ODF_EXTS, PDF_EXTS, PLAIN_EXTS, WORD_EXTS
from inkwell.sources.markup import ExtractError, text_of_flat_odf, text_of_odf, text_of_word
from inkwell.sources.pdf import text_of_pdf
from inkwell.sources.plaintext import extract_plain

_READERS = {x: f for exts, f in ((WORD_EXTS, text_of_word), (PACKED_ODF_EXTS, text_of_odf), (FLAT_ODF_EXTS, text_of_flat_odf), (PDF_EXTS, text_of_pdf)) for x in exts}


def extract_bytes(ext: str, content: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(text, error_code, error); never raises, as one bad file must not fail a job."""
    try:
        if content is None:
            raise ExtractError("IO_READ", "file can't be read")
        return _READERS[ext](bytes(content)), None, None
    except ExtractError as e:
        return None, e.code, str(e)
    except Exception as e:
        return None, "IO_READ", f"{type(e).__name__}: {e}"


@F.pandas_udf(EXTRACT_SCHEMA)
def extract_packed(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_bytes(e, c) for e, c in zip(ext, content)], columns=["text", "error_code", "error"])


def extract_files(files: DataFrame) -> DataFrame:
    """Replaces ``content`` by ``text, error_code, error``; rows of unsupported extensions are left out.

    ``files`` has ext, content, size at least. Plain text and the rest are separate branches, so
    plain text never crosses into Python.
    """
    keep = [c for c in files.columns if c != "content"]
    plain = files.filter(F.col("ext").isin(*PLAIN_EXTS)).select(*keep, extract_plain(F.col("content"), F.col("size")).alias("_x"))
    packed = files.filter(F.col("ext").isin(*_READERS)).select(*keep, extract_packed("ext", "content").alias("_x"))
    return plain.unionByName(packed).select(*keep, "_x.text", "_x.error_code", "_x.error")


#: Bytes of contents and texts, and files, that ``extract_listed`` hands over at once.
_BATCH_BYTES, _BATCH_FILES = 8 * 1024 * 1024, 256


def extract_listed(candidates: DataFrame) -> DataFrame:
    """Adds ``text, error_code, error`` to listed files; rows of unsupported extensions are left out.

    Every file is read once. Packed ones are unpacked where they are read, only plain text leaves Python as it is.
    """
    import pyarrow as pa

    names = candidates.columns
    schema = T.StructType([*candidates.schema.fields, T.StructField("content", T.BinaryType()), *EXTRACT_SCHEMA.fields])

    def run(batches):
        for b in batches:
            paths, exts = (b.column(names.index(c)).to_pylist() for c in ("path", "ext"))
            rows, held, begin = [], 0, 0
            for k, (path, ext) in enumerate(zip(paths, exts), 1):
                try:
                    raw = Path(path).read_bytes()
                except OSError:
                    raw = None
                rows.append((None, *extract_bytes(ext, raw)) if ext in _READERS else (raw, None, None, None))
                held += len(rows[-1][0] or b"") + 4 * len(rows[-1][1] or "")
                if held >= _BATCH_BYTES or len(rows) == _BATCH_FILES or k == len(paths):
                    made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.slice(begin, k - begin).columns, *made], names=[*names, "content", *EXTRACT_SCHEMA.names])
                    rows, held, begin = [], 0, k

    read = candidates.filter(F.col("ext").isin(*PLAIN_EXTS, *_READERS)).mapInArrow(run, schema)
    own = F.struct(*(F.col(c) for c in EXTRACT_SCHEMA.names))
    x = F.when(F.col("ext").isin(*PLAIN_EXTS), extract_plain(F.col("content"), F.col("size"))).otherwise(own)
    return read.select(*names, x.alias("_x")).select(*names, "_x.text", "_x.error_code", "_x.error")
