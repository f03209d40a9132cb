"""Text of word-processing XML and OpenDocument XML, alone or in zip packages.

A small pull tokenizer instead of a validating parser: undeclared prefixes, content after the root
and an unclosed document are all accepted, an unknown entity loses its text node only, and no entity
declared in a document type is ever expanded.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator


class ExtractError(Exception):
    def __init__(self, code: str, said: str):
        super().__init__(said)
        self.code = code


#: Largest sum of the unpacked sizes of those parts of a package that are read; guards against zip bombs.
UNPACKED_LIMIT = 512 * 1024 * 1024

_TAG = re.compile(r"<(?:!--.*?-->|!\[CDATA\[(?P<cdata>.*?)\]\]>|\?.*?\?>|!DOCTYPE(?:[^\[>\"']|\"[^\"]*\"|'[^']*'|\[[^\]]*\])*>|/(?P<end>[^\s>]+)\s*>|(?P<start>[^\s>/!?]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>)", re.S)
_ENTITY = re.compile(r"&([^;&]*)(;?)")
_ATTR = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _unescape(raw: str) -> str | None:
    """None if there is an entity that isn't one of XML's own."""
    bad = False

    def sub(m: re.Match) -> str:
        nonlocal bad
        name = m[1]
        try:
            if m[2] and name in _NAMED:
                return _NAMED[name]
            if m[2] and name[:2] in ("#x", "#X"):
                return chr(int(name[2:], 16))
            if m[2] and name[:1] == "#":
                return chr(int(name[1:]))
        except (ValueError, OverflowError):
            pass
        bad = True
        return ""

    out = _ENTITY.sub(sub, raw) if "&" in raw else raw
    return None if bad else out


def _events(xml: str) -> Iterator[tuple[str, str, str]]:
    """(kind, local name or text, attributes); kind: start, end, empty, text."""
    at, open_tags = 0, []
    while at < len(xml):
        lt = xml.find("<", at)
        if lt != at:
            yield "text", xml[at : lt if lt >= 0 else len(xml)], ""
            if lt < 0:
                return
        m = _TAG.match(xml, lt)
        if not m:
            raise ValueError(f"malformed markup at {lt}")
        at = m.end()
        if m["cdata"] is not None:
            yield "cdata", m["cdata"], ""
        elif m["end"]:
            if not open_tags or open_tags.pop() != m["end"]:
                raise ValueError(f"unexpected end tag {m['end']}")
            yield "end", m["end"].rpartition(":")[2], ""
        elif m["start"]:
            if not m["empty"]:
                open_tags.append(m["start"])
            yield "empty" if m["empty"] else "start", m["start"].rpartition(":")[2], m["attrs"]


def _space_count(attrs: str) -> int:
    for name, a, b in _ATTR.findall(attrs):
        if name.rpartition(":")[2] == "c":
            return int(v) if (v := a or b).isdigit() else 1
    return 1


def text_of_xml(xml: str, word: bool) -> str:
    """``word``: only runs count; otherwise all that stands in a paragraph or heading.

    Blank paragraphs collapse; the state is two flags, so that the end of a nested paragraph also
    ends the outer one.
    """
    out: list[str] = []
    in_run = in_block = False
    for kind, what, attrs in _events(xml):
        if kind in ("text", "cdata"):
            if in_run or (in_block and not word):
                text = what if kind == "cdata" else _unescape(what)
                if text:
                    out.append(text)
        elif kind == "empty":
            if in_run or in_block:
                if what == "tab":
                    out.append("\t")
                elif what in ("br", "cr", "line-break"):
                    out.append("\n")
                elif what == "s":
                    out.append(" " * _space_count(attrs))
        elif what in ("t", "delText"):
            in_run = kind == "start"
        elif what in ("p", "h"):
            in_block = kind == "start"
            if kind == "end" and out:
                last = next((x for x in reversed(out) if x), "")
                if last and not last.endswith("\n"):
                    out.append("\n")
    return "".join(out)


def text_of_xml_guess(xml: str) -> str:
    """As text_of_xml; word-processing markup if its prefixed names occur."""
    return text_of_xml(xml, any(x in xml for x in ("w:document", "w:p", "w:t")))


def _decoded(raw: bytes) -> str:
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if raw.startswith(mark):
            return raw.decode(name)
    return raw.decode("utf-8")


def _package(raw: bytes, is_read: Callable[[str], bool]) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except Exception as e:
        raise ExtractError("ZIP_INVALID", "not a readable archive") from e
    if sum(i.file_size for i in z.infolist() if is_read(i.filename)) > UNPACKED_LIMIT:
        raise ExtractError("ZIP_INVALID", "parts unpack to more than the limit")
    return z


_ODF_PARTS = ("content.xml", "styles.xml")
_STORIES = ("header", "footer", "footnotes", "endnotes", "comments")


def is_word_part(name: str) -> bool:
    name = name.replace("\\", "/").lower()
    if not (name.startswith("word/") and name.endswith(".xml")):
        return False
    base = name[len("word/") :]
    return base == "document.xml" or base.startswith(_STORIES)


def word_part_key(name: str) -> tuple[bool, bytes]:
    """The main document first, then by bytes."""
    return (not name.lower().endswith("document.xml"), name.encode())


def _joined(texts: list[str]) -> str:
    out = ""
    for text in texts:
        if text.strip():
            out += ("\n" if out and not out.endswith("\n") else "") + text
    return out


def text_of_word(raw: bytes) -> str:
    z = _package(raw, is_word_part)
    names = sorted((n for n in z.namelist() if is_word_part(n)), key=word_part_key)
    if not names:
        raise ExtractError("DOCX_NO_PART", "no document part in the archive")
    texts = []
    for n in names:
        try:
            part = z.read(n)
        except Exception as e:
            raise ExtractError("DOCX_PART", f"part {n} can't be read") from e
        try:
            texts.append(text_of_xml(_decoded(part), True))
        except ValueError as e:
            raise ExtractError("DOCX_XML", f"part {n}: {e}") from e
    return _joined(texts)


def text_of_odf(raw: bytes) -> str:
    z = _package(raw, _ODF_PARTS.__contains__)
    if "content.xml" not in z.namelist():
        raise ExtractError("ODF_NO_CONTENT", "content.xml is missing")
    texts = []
    for n in _ODF_PARTS:
        if n in z.namelist():
            try:
                texts.append(text_of_xml(_decoded(z.read(n)), False))
            except Exception as e:
                raise ExtractError("ODF_XML", f"{n}: {e}") from e
    out = texts[0]
    if len(texts) == 2 and texts[1].strip():
        out += ("\n" if out and not out.endswith("\n") else "") + texts[1]
    return out


def text_of_flat_odf(raw: bytes) -> str:
    try:
        return text_of_xml(_decoded(raw), False)
    except ValueError as e:
        raise ExtractError("FLAT_XML", str(e)) from e
