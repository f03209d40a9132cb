"""Edge cases of matching, extraction, listing, caching and the whole search."""

import datetime as dt
import os
import zlib

import pytest
from pyspark.sql import functions as F

from inkwell.functions.matching import compile_query, match_count, match_spans, snippets
from inkwell.functions.labels import progress_label, resolve_directory, truncate_path
from inkwell.model import SearchOptions, SortOrder
from inkwell.operators.cache import CACHE_SCHEMA, TextCache, probe, usage
from inkwell.operators.results import match_counts, match_rows, sort_results, summary
from inkwell.plans.search import Search, Session, progress_steps, run_search, validate
from inkwell.sources import markup
from inkwell.sources.extract import extract_bytes
from inkwell.sources.listing import walk
from inkwell.sources.markup import text_of_xml, text_of_xml_guess, word_part_key
from inkwell.sources.pdf import scan_strings
from inkwell.sources.plaintext import extract_plain
from inkwell.plans.catalog import _zipped


def counts(spark, cases):
    out = []
    for text, query, ic in cases:
        p = compile_query(query, ic)
        out.append(spark.range(1).select(match_count(F.lit(text), p)).first()[0])
    return out


def test_matching(spark):
    assert counts(
        spark,
        [("Über allem Ruhe", "Ü", False), ("STRAẞE", "straße", True), ("ooooooo", "ooo", False), ("那🌲那🌲", "🌲", False), ("nut," * 450, "nut", False), ("p q\nr", "q    r", False),
         ("İ", "i", True), ("i", "İ", True), ("ς", "σ", True), ("ſ", "s", True), ("K", "k", True), ("a　\x85b", "a b", False), ("a\x1cb", "a b", False), ("x", "  ", False)],
    ) == [1, 1, 2, 2, 200, 1, 1, 0, 0, 0, 1, 1, 0, 0]
    text = "Ñandú, el ñandú"
    spans = spark.range(1).select(match_spans(F.lit(text), compile_query("ñandú", True))).first()[0]
    assert [text.encode()[s.start : s.end].decode() for s in spans] == ["Ñandú", "ñandú"]


@pytest.mark.parametrize("ctx", [0, 1, 2, 3, 4, 5, 50])
def test_snippets_against_bytes(spark, ctx):
    texts = ["é🦀x  y\n🦀é", "x", "aé\txñ🦀", "🦀🦀x🦀🦀x", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", snippets(F.col("t"), compile_query("x"), ctx).alias("s")).collect()
    for t, got in rows:
        raw, want = (t or "").encode(), []
        at = raw.find(b"x")
        while at >= 0:
            a, z = max(0, at - ctx), min(len(raw), at + 1 + ctx)
            while a > 0 and raw[a] & 0xC0 == 0x80:
                a -= 1
            while z < len(raw) and raw[z] & 0xC0 == 0x80:
                z += 1
            body = " ".join(p for p in __import__("re").split(r"\s+", raw[a:z].decode()))
            want.append(("… " if a else "") + body + (" …" if z < len(raw) else ""))
            at = raw.find(b"x", at + 1)
        assert got == want


def test_xml():
    assert text_of_xml("<d>\n<w:p><w:r><w:t>He</w:t></w:r> <w:r><w:t>l</w:t></w:r><w:t>lo</w:t></w:p>\n<w:p><w:t>x</w:t></w:p></d>", True) == "Hello\nx\n"
    assert text_of_xml('<p>a<s c="3"/>b</p><h>H</h>', False) == "a   b\nH\n"
    assert text_of_xml("<p>a<tab></tab>b<tab/>c</p><p></p><p>d</p>", False) == "ab\tc\nd\n"
    assert text_of_xml("<p>o<p>i</p>lost</p>", False) == "oi\n"
    assert text_of_xml("<p>a &amp; b</p><p>&nope; x</p><p><![CDATA[<c>]]>", False) == "a & b\n<c>"
    assert text_of_xml_guess("<w:p><w:t>x</w:t> y</w:p>") == "x\n"
    assert sorted(["word/header1.xml", "word/document.xml"], key=word_part_key)[0] == "word/document.xml"
    assert extract_bytes("fodt", b"<p>a</q>")[1] == "FLAT_XML"


def test_packages():
    word = lambda s: f"<w:p><w:t>{s}</w:t></w:p>"
    parts = {"word/header1.xml": word("head"), "word/document.xml": word("main"), "word/footnotes.xml": word(" "), "word/styles.xml": word("no")}
    assert extract_bytes("docx", _zipped(parts))[0] == "main\nhead\n"
    assert extract_bytes("docx", _zipped({"a": "b"}))[1] == "DOCX_NO_PART"
    assert extract_bytes("docx", _zipped({"word/document.xml": "<a></b>"}))[1] == "DOCX_XML"
    assert extract_bytes("odt", b"junk")[1] == "ZIP_INVALID"
    assert extract_bytes("odt", _zipped({"styles.xml": ""}))[1] == "ODF_NO_CONTENT"
    assert extract_bytes("ods", _zipped({"content.xml": "<p>c</p>", "styles.xml": "<p>s</p>"}))[0] == "c\ns\n"


def test_pdf():
    assert scan_strings(rb"(a\)b\n) (open (x) y) <486> (\101) (lost") == "a)b\n open (x H 101 "
    assert scan_strings(b"(one) Tj (two) Tj") == "one two "
    assert scan_strings(b"<48656C6C6F20576F726C64>").strip() == "Hello World"
    body = zlib.compress(b"(deep)")
    assert extract_bytes("pdf", b"junk%PDF-1.4 stream\r\n" + body + b"\nendstream")[0] == "deep  "
    raw = zlib.compressobj(wbits=-15)
    assert extract_bytes("pdf", b"%PDF- stream\n" + raw.compress(b"(raw)") + raw.flush() + b"endstream")[0] == "raw  "
    assert [extract_bytes("pdf", x)[1] for x in (b"", b"x", b"%PDF-1.4")] == ["PDF_EMPTY", "PDF_NO_HEADER", "PDF_CORRUPT"]


def test_plain(spark):
    cases = {
        "Sähköposti".encode("latin-1"): ("Sähköposti", None), b"a\0b": (None, "TXT_NUL"), b"": ("", None), "﻿x\r\n".encode(): ("﻿x\r\n", None),
        b"\x01" * 4 + b"a" * 29: (None, "TXT_BINARY"), b"\x01" * 3 + b"a" * 30: (" " * 3 + "a" * 30, None), b"\x01" * 32: (" " * 32, None), b"a" * 4096 + b"\0": ("a" * 4096 + " ", None), "\x85".encode(): (" ", None),
    }
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "c binary").select("c", extract_plain(F.col("c"), F.octet_length("c").cast("long")).alias("x"))
    assert {bytes(r.c): (r.x.text, r.x.error_code) for r in df.collect()} == cases


def tree(tmp_path):
    for name in ("a.txt", "b.TEXT", "_c.txt", ".d.txt", "e.md", "sub/f.txt", "node_modules/g.txt", ".h/i.txt", "build", "build2/j.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("needle here")
    (tmp_path / "k.fodt").write_text("<p>needle</p>")
    (tmp_path / "bad.docx").write_text("needle")
    (tmp_path / "l.pdf").write_bytes(b"%PDF-1 stream\n(needle)\nendstream")
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "sub", tmp_path / "linked")
    return tmp_path


def test_walk(tmp_path):
    root = tree(tmp_path)
    names = lambda **k: sorted(os.path.relpath(r[0], root) for r in walk(SearchOptions(directory=str(root), **k)))
    base = ["_c.txt", "a.txt", "a.txt", "b.TEXT", "bad.docx", "build2/j.txt", "k.fodt", "l.pdf", "sub/f.txt"]
    assert names() == base
    assert names(search_hidden=True) == sorted([*base, ".d.txt", ".h/i.txt"])
    assert "sub/f.txt" not in names(recursive=False)
    assert names(search_docx=False, search_odt=False, search_pdf=False, max_file_size_mb=0) == []
    os.utime(root / "a.txt", (1000, 1000))
    at = dt.datetime.fromtimestamp(1000, dt.timezone.utc)
    assert names(modified_after=at).count("a.txt") == 2
    assert names(modified_after=at + dt.timedelta(seconds=1)).count("a.txt") == 1
    assert list(walk(SearchOptions(directory=str(root)), lambda: True)) == []


def test_search_end_to_end(spark, tmp_path):
    root = tree(tmp_path / "t")
    cache = TextCache(spark, str(tmp_path / "cache"))
    told = []
    opts = SearchOptions(directory=str(root), query="needle")
    first = run_search(spark, opts, cache, progress=lambda *a: told.append(a))
    assert first.stats["total_count"] == 9 and first.stats["cached_count"] == 0 and told == [(0, 9), (9, 9)]
    assert [r.error_code for r in first.errors.collect()] == ["ZIP_INVALID"]
    assert sorted(r.file_type for r in first.results.collect()) == ["FODT", "PDF", "TXT", "TXT", "TXT", "TXT", "TXT", "TXT"]
    again = run_search(spark, SearchOptions(directory=str(root), query="here"), cache)
    assert again.stats["cached_count"] >= 7 and again.results.count() == 6
    n = first.save(str(tmp_path / "out.csv"))
    lines = (tmp_path / "out.csv").read_bytes().split(b"\n")
    assert n == 8 and lines[0] == b"\xef\xbb\xbfquery,file,file_type,match_number,context" and lines[1].startswith(b'"needle","/') and b'",1,"' in lines[1]
    gone = Search(spark, opts)
    gone.cancel()
    assert run_search(spark, opts, search=gone).stats["total_count"] == 0
    late = Search(spark, opts)

    def stop(done, total):
        if done == 0:
            late.cancelled.set()
            raise RuntimeError("interrupted")

    out = run_search(spark, opts, search=late, progress=stop)  # as a job that is interrupted
    assert out.stats["total_count"] == 9 and out.results.count() == 0 == out.errors.count() and out.rows().count() == 0
    session = Session(spark)
    one = session.search(opts)
    with pytest.raises(ValueError):
        session.search(SearchOptions(directory=str(root), query="　"))
    assert one.cancelled.is_set() and not session.is_current(one)
    with pytest.raises(ValueError):
        validate(SearchOptions(directory="/nope", query="x"))


def test_snippets_and_counts_agree(spark):
    p = compile_query("ab", False)
    texts = ["", "ab", "xabyab", "ä ab ö" * 300, None, "ab" * 200 + "tail ab"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in df.select("text", match_count(F.col("text"), p).alias("n"), match_spans(F.col("text"), p).alias("s"), match_spans(F.col("text"), p, None).alias("all"), snippets(F.col("text"), p, 3).alias("c")).collect():
        raw = (r.text or "").encode()
        assert r.n == len(r.s) == len(r.c) == min(200, raw.count(b"ab")) and len(r["all"]) == raw.count(b"ab")
        assert all(raw[x.start : x.end] == b"ab" for x in r["all"]) and [x.start for x in r["all"]] == sorted({x.start for x in r["all"]})
    named = df.withColumnRenamed("k", "path")
    assert summary(match_counts(named, "ab")).first() == summary(match_rows(named, "ab")).first() == (4, 1 + 2 + 200 + 200)


def test_orders(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("/a-b", t, 1), ("/a/b", t, 2), ("/z", None, 2), ("/B", t + dt.timedelta(1), 1)]
    df = spark.createDataFrame([(f, m, [(str(k),) for k in range(n)]) for f, m, n in rows], "file string, modified timestamp, matches array<struct<context:string>>")
    got = lambda o: [r.file for r in sort_results(df, o).collect()]
    assert got(SortOrder.DATE_DESC) == ["/B", "/a/b", "/a-b", "/z"] == got(9)
    assert got(SortOrder.DATE_ASC) == ["/a/b", "/a-b", "/B", "/z"]
    assert got(SortOrder.NAME) == ["/a-b", "/B", "/a/b", "/z"]
    assert got(SortOrder.MATCHES) == ["/a/b", "/z", "/B", "/a-b"]


def test_cache(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("/a", 1, None, "x"), ("/b", 1, t, "y")]
    cached = spark.createDataFrame(rows, CACHE_SCHEMA)
    probes = spark.createDataFrame([("/a", 1, None), ("/b", 2, t), ("/b", 1, t)], "path string, size long, modified timestamp")
    hits, misses = probe(probes, cached)
    assert sorted(r.text for r in hits.collect()) == ["x", "y"] and [r.size for r in misses.collect()] == [2]
    c = TextCache(spark, str(tmp_path))
    c.insert(spark.range(600).selectExpr("'/f' || id AS path", "id AS size", "current_timestamp() AS modified", "'t' AS text"))
    assert 200 <= len(c) <= 500
    big = TextCache(spark, str(tmp_path / "big"))  # 80 texts of 1 MiB: over the bytes, not the entries
    big.insert(spark.range(80).selectExpr("'/g' || id AS path", "id AS size", "CAST(NULL AS timestamp) AS modified", "repeat('x', 1048576) AS text"))
    assert 16 <= len(big) < 32 and big.memory_bytes() <= 32 * 1024 * 1024
    few = rows[:1]
    c.insert(spark.createDataFrame(few, CACHE_SCHEMA))
    kept = len(c)
    again = TextCache(spark, str(tmp_path))
    assert len(again) == kept and [r.text for r in again.table().filter("path = '/a'").collect()] == ["x"]
    c.clear()
    assert len(c) == 0 and c.memory_bytes() == 0 and len(TextCache(spark, str(tmp_path))) == 0
    c.vacuum()
    c.insert(spark.createDataFrame(few, CACHE_SCHEMA))
    assert len(TextCache(spark, str(tmp_path))) == 1
    assert usage(cached).first()["bytes"] == 6


def test_small_helpers(spark):
    assert progress_steps(3) == [0, 1, 2, 3] and progress_steps(250)[:3] == [0, 2, 4] and progress_steps(0) == [0]
    assert resolve_directory(" '/tmp' ") == os.path.realpath("/tmp") and resolve_directory("''") == os.path.realpath(".")
    row = spark.range(1).select(truncate_path(F.lit("abcdef"), 5), truncate_path(F.lit("abc"), 2), progress_label(F.lit(1), F.lit(3))).first()
    assert list(row) == ["...ef", "...", "33% (1/3)"]


def test_streaming_follow(spark, tmp_path):
    from inkwell.streaming.follow import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one needle")
    q = follow(spark, SearchOptions(directory=str(tmp_path / "in"), query="needle")).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "in/b.txt").write_text("needle needle")
        q.processAllAvailable()
        assert sorted(len(r.matches) for r in spark.table("followed").collect()) == [1, 2]
    finally:
        q.stop()


def test_unpacked_limit_counts_what_is_read(monkeypatch):
    monkeypatch.setattr(markup, "UNPACKED_LIMIT", 1000)
    word = lambda n: f"<w:p><w:t>{'x' * n}</w:t></w:p>"
    media = {"word/media/image1.png": "p" * 5000, "Pictures/1.png": "p" * 5000, "word/styles.xml": "s" * 5000}
    assert extract_bytes("docx", _zipped(media | {"word/document.xml": word(3)}))[:2] == ("xxx\n", None)
    assert extract_bytes("odt", _zipped(media | {"content.xml": "<p>c</p>", "styles.xml": "<p>s</p>"}))[:2] == ("c\ns\n", None)
    assert extract_bytes("docx", _zipped({"word/document.xml": word(600), "word/header1.xml": word(600)}))[1] == "ZIP_INVALID"
    assert extract_bytes("odt", _zipped({"content.xml": "<p>c</p>", "styles.xml": f"<p>{'s' * 1000}</p>"}))[1] == "ZIP_INVALID"


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    from inkwell.sources.extract import extract_listed
    from inkwell.sources.listing import list_candidates

    for k in range(600):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    (tmp_path / "p.fodt").write_text("<p>packed</p>")
    (tmp_path / "bad.docx").write_text("junk")
    files = list_candidates(spark, SearchOptions(directory=str(tmp_path))).persist()
    assert files.rdd.getNumPartitions() == 2  # not one for every 64 files
    gone = spark.createDataFrame([(str(tmp_path / x), x[-3:], 1, None) for x in ("a.txt", "b.pdf")], files.schema)
    got = {os.path.basename(r.path): (r.text, r.error_code) for r in extract_listed(files.coalesce(1).unionByName(gone)).collect()}
    want = {f"{k}.txt": (f"text {k}", None) for k in range(600)}
    assert got == want | {"p.fodt": ("packed\n", None), "bad.docx": (None, "ZIP_INVALID"), "a.txt": (None, "IO_READ"), "b.pdf": (None, "IO_READ")}
    files.unpersist()


def test_cache_probe_leaves_the_files_shared_out(spark):
    from inkwell.operators.cache import probe_few

    t = dt.datetime(2024, 1, 1)
    cached = spark.createDataFrame([("/a", 1, None, "x"), ("/b", 1, t, "y"), ("/b", 1, t, "y")], CACHE_SCHEMA)
    files = spark.createDataFrame([("/a", 1, None), ("/b", 2, t), ("/b", 1, t), ("/b", 1, t)] + [(f"/f{k}", k, t) for k in range(90)], "path string, size long, modified timestamp").repartition(16).persist()
    hits, misses = probe_few(files, cached)
    assert sorted(map(str, hits.collect())) == sorted(map(str, probe(files, cached)[0].collect())) and len(hits.collect()) == 3
    assert sorted(map(str, misses.collect())) == sorted(map(str, probe(files, cached)[1].collect())) and len(misses.collect()) == 91
    assert misses.rdd.getNumPartitions() == files.rdd.getNumPartitions() == 16
    files.unpersist()


def test_scanned_strings_end_as_before():
    assert scan_strings(rb"(a\\) <4> (b\qc) <41 zz42") == "a\\ bqc " and scan_strings(b"(a) (lost <4142>") == "a " and scan_strings(b"(x\\") == ""
    assert scan_strings(b"<0041 0b09>(\xe9)") == "A\t é "
