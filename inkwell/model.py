"""Options, presets, constants and schemas. Nothing here touches Spark's JVM."""

from __future__ import annotations

import datetime as dt
import enum
from dataclasses import dataclass

from pyspark.sql import types as T

# Limits and name lists that results depend on.
MAX_MATCHES_PER_FILE = 200
TXT_LIMIT_BYTES = 25 * 1024 * 1024
PDF_LIMIT_BYTES = 100 * 1024 * 1024
TXT_SAMPLE_BYTES = 4096
CACHE_ENTRY_LIMIT_BYTES = 1024 * 1024
CACHE_LIMIT_BYTES = 64 * 1024 * 1024
CACHE_LOW_BYTES = 32 * 1024 * 1024
CACHE_LIMIT_ENTRIES = 500
CACHE_LOW_ENTRIES = 250
EXCLUDED_DIRS = (
    "node_modules", "target", "__pycache__", "venv", ".venv", ".cargo", ".rustup", ".local",
    ".cache", ".var", ".mozilla", ".steam", ".wine", ".flatpak", "build",
)
WORD_EXTS = ("docx", "docm", "dotx", "dotm")
FLAT_ODF_EXTS = ("fodt", "fods")
PACKED_ODF_EXTS = ("odt", "ott", "ods", "odp")
PDF_EXTS = ("pdf",)
PLAIN_EXTS = ("txt", "text")

CONTEXT_DEFAULT = 150
MIB = 1024 * 1024

CANDIDATE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
    ]
)
EXTRACT_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class SortOrder(enum.IntEnum):
    """The index a result list is ordered by; any unknown index means DATE_DESC."""

    DATE_DESC = 0
    DATE_ASC = 1
    NAME = 2
    MATCHES = 3

    @classmethod
    def from_index(cls, index: int) -> SortOrder:
        return cls(index) if index in cls._value2member_map_ else cls.DATE_DESC


class DatePreset(enum.Enum):
    ALL = None
    DAY = 1
    WEEK = 7
    MONTH = 30
    YEAR = 365

    def since(self, now: dt.datetime) -> dt.datetime | None:
        """The earliest modification time that passes; ``now`` is injected so that reruns agree."""
        return None if self.value is None else now - dt.timedelta(days=self.value)


#: Size limits in MiB by preset name.
SIZE_PRESETS = {"none": None, "small": 10, "medium": 50, "large": 100}


@dataclass(frozen=True)
class SearchOptions:
    """One search. ``app_preset`` gives the interactive default, which ignores case."""

    directory: str = "."
    query: str = ""
    ignore_case: bool = False
    recursive: bool = True
    search_hidden: bool = False
    use_cache: bool = True
    context_size: int = CONTEXT_DEFAULT
    search_docx: bool = True
    search_odt: bool = True
    search_pdf: bool = True
    search_txt: bool = True
    max_file_size_mb: int | None = None
    modified_after: dt.datetime | None = None

    @classmethod
    def app_preset(cls, **changes) -> SearchOptions:
        return cls(**({"ignore_case": True} | changes))

    @property
    def extensions(self) -> tuple[str, ...]:
        return (
            WORD_EXTS * self.search_docx
            + (PACKED_ODF_EXTS + FLAT_ODF_EXTS) * self.search_odt
            + PDF_EXTS * self.search_pdf
            + PLAIN_EXTS * self.search_txt
        )

    @property
    def max_bytes(self) -> int | None:
        """Saturates at the largest long, as no file reaches it."""
        return None if self.max_file_size_mb is None else min(self.max_file_size_mb * MIB, 2**63 - 1)
