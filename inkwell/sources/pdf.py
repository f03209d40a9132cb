"""Text of PDF files: a library if one can be imported, else a scan of the content streams' strings."""

from __future__ import annotations

import re
import zlib

from inkwell.model import PDF_LIMIT_BYTES
from inkwell.sources.markup import ExtractError

_STRING = re.compile(rb"\(((?:[^\\)]++|\\.)*+)(\)?)|<([^>]*+)(>?)", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t"}
_NOT_HEX = bytes(sorted(frozenset(range(256)) - frozenset(b"0123456789abcdefABCDEF")))
_NOT_SHOWN = bytes(sorted(frozenset(range(32)) - frozenset(b"\t\n\r")))


def _emit(raw: bytes, out: list[str]) -> None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    if text.strip():
        out.append(text + " ")


def scan_strings(raw: bytes) -> str:
    """Every parenthesised or hexadecimal string, each followed by a space.

    Octal escapes aren't decoded and parentheses don't nest: the first one that isn't escaped closes.
    An unterminated string is dropped.
    """
    out: list[str] = []
    for m in _STRING.finditer(raw):
        plain, closed, digits, ended = m.groups()
        if not (closed or ended):
            break
        if plain is not None:
            _emit(_ESCAPED.sub(lambda e: _ESCAPES.get(e[1], e[1]), plain) if b"\\" in plain else plain, out)
        else:
            digits = digits.translate(None, _NOT_HEX).decode()
            _emit(bytes.fromhex(digits[: len(digits) // 2 * 2]).translate(None, _NOT_SHOWN), out)
    return "".join(out)


def _inflated(raw: bytes) -> bytes:
    for wbits in (15, -15):
        d = zlib.decompressobj(wbits)
        try:
            got = d.decompress(raw)
        except zlib.error:
            continue
        if d.eof and got:
            return got
    return b""


def scan_streams(raw: bytes) -> str | None:
    """The strings of all streams, inflated where they can be; None if there is no text at all."""
    out, at = [], 0
    while (begin := raw.find(b"stream", at)) >= 0:
        begin += len(b"stream")
        begin += raw[begin : begin + 1] == b"\r"
        begin += raw[begin : begin + 1] == b"\n"
        end = raw.find(b"endstream", begin)
        if end < 0:
            break
        body = raw[begin:end]
        text = scan_strings(_inflated(body))
        if not text.strip():
            text = scan_strings(body)
        if text.strip():
            out.append(text + " ")
        at = end + len(b"endstream")
    return "".join(out) if out else None


def _by_library(raw: bytes) -> str:
    try:
        import io

        from pypdf import PdfReader
    except ImportError:
        return ""
    try:
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)
    except Exception:  # a broken file must not end the job; the stream scan follows
        return ""


def text_of_pdf(raw: bytes) -> str:
    if len(raw) > PDF_LIMIT_BYTES:
        raise ExtractError("PDF_TOO_LARGE", "PDF file over the size limit")
    if not raw:
        raise ExtractError("PDF_EMPTY", "empty PDF file")
    head = re.search(rb"%PDF-", raw)
    if not head:
        text = scan_streams(raw)
        if text is None:
            raise ExtractError("PDF_NO_HEADER", "no PDF header and no text streams")
        return text
    body = raw[head.start() :]
    text = _by_library(body)
    if not text.strip():
        text = scan_streams(body)
    if text is None:
        raise ExtractError("PDF_CORRUPT", "no text could be read from the PDF file")
    return text
