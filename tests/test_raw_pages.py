"""Status gate, size gate and decoding of fetched pages."""

import pytest

from wordloom.operators import views
from wordloom.plans.ingest import ingest_raw_pages
from wordloom.plans.store import VocabularyStore
from wordloom.session import work_folder
from wordloom.sources.raw_pages import JAPANESE, RAW_PAGES, decoded_pages, read_page_files

PAGE = "<html><head>{}<title>T</title></head><body><article><p>{}</p></article></body></html>"


def decoded(spark, *rows, **how):
    data = [(n, f"http://a.example/{n}", *row) for n, row in enumerate(rows)]
    got = decoded_pages(spark.createDataFrame(data, RAW_PAGES), **how).orderBy("page_id").collect()
    return [(r["charset"], r["html"], r["reason"]) for r in got]


def test_charset_comes_from_mark_header_tag_or_default(spark):
    text = "<p>Où déjà — 手紙 🙂</p>"
    tag = '<meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-1"><p>déjà</p>'
    late = "<!--" + " " * 1100 + "--><meta charset=iso-8859-1>é"
    rows = [
        (200, None, text.encode()),
        (200, "text/html", b"\xef\xbb\xbf" + text.encode()),
        (200, "text/html; charset=iso-8859-1", b"\xff\xfe" + text.encode("utf-16-le")),  # the mark wins
        (200, "text/html", b"\xfe\xff" + text.encode("utf-16-be")),
        (200, 'text/html; Charset="UTF-16BE"', text.encode("utf-16-be")),
        (200, "text/html", tag.encode("latin-1")),
        (200, "text/html; charset=utf-8", tag.encode()),  # the header wins over the tag
        (200, None, "<meta charset='UTF-16'>é".encode()),  # readable as ASCII, so it is not
        (200, None, late.encode()),  # declared too late
        (200, "text/html; charset=us-ascii", b"plain"),
        (200, None, b""),
    ]
    got = decoded(spark, *rows)
    assert [g[2] for g in got] == [None] * len(rows)
    assert [g[0] for g in got] == ["utf-8", "utf-8", "utf-16le", "utf-16be", "utf-16be", "iso-8859-1", "utf-8", "utf-8",
                                   "utf-8", "us-ascii", "utf-8"]
    assert [g[1] for g in got] == [text] * 5 + [tag, tag, "<meta charset='UTF-16'>é", late, "plain", ""]


def test_refused_pages_say_why(spark):
    rows = [
        (404, None, b"gone"), (None, None, b"x"), (301, None, None), (200, None, None), (200, None, b"x" * 50),
        (200, "text/html; charset=klingon", b"x"), (200, None, b"\xff\xfa"), (200, None, b"ok \xc3"),
        (200, "a; charset=utf-16le", b"a\0b"), (200, "a; charset=utf-16le", b"\x00\xd8a\x00"),
        (200, "a; charset=utf-16be", b"\xdc\x00\x00a"), (200, "a; charset=utf-16be", b"\x00a" * 20 + b"\xd8\x3d\xde\x00"),
    ]
    got = decoded(spark, *rows, max_bytes=50)
    assert [g[2] for g in got] == ["status", "status", "status", "no body", "too large", "unknown charset",
                                   "undecodable", "undecodable", "undecodable", "undecodable", "undecodable", None]
    assert all((g[1] is None) == (g[2] is not None) for g in got)
    assert got[-1][1] == "a" * 20 + "😀"


def test_long_pages_and_no_pages(spark):
    body = ("手紙を書いた。" * 200_000).encode("utf-16-le")
    got = decoded(spark, (200, "t; charset=utf-16", body))
    assert got == [("utf-16", "手紙を書いた。" * 200_000, None)]
    assert decoded_pages(spark.createDataFrame([], RAW_PAGES)).collect() == []


@pytest.mark.parametrize("name, codec", sorted(JAPANESE.items()))
def test_japanese_charsets_by_codec(spark, name, codec):
    text = "<p>手紙を書いた</p>"
    rows = [(200, f"text/html; charset={name}", text.encode(codec)), (200, f"t; charset={name}", b"a\x8f"),
            (200, None, text.encode()), (404, f"t; charset={name}", text.encode(codec))]
    assert [g[2] for g in decoded(spark, *rows)] == ["unknown charset", "unknown charset", None, "status"]
    got = decoded(spark, *rows, codecs=JAPANESE)
    assert got[0] == (name, text, None) and got[2][1] == text
    assert [g[2] for g in got] == [None, "undecodable", None, "status"]


def test_raw_pages_to_store(spark, tmp_path, rows):
    store = VocabularyStore(spark, work_folder(spark, "store"))
    data = [
        (1, "http://a.example/1", 200, None, PAGE.format('<meta charset="latin1">', "déjà vu").encode("latin-1")),
        (2, "http://a.example/2", 500, None, PAGE.format("", "erreur").encode()),
        (3, "http://a.example/3", 200, "t; charset=zz", PAGE.format("", "rien").encode()),
    ]
    raw = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in data], RAW_PAGES)
    assert ingest_raw_pages(store, raw, 0, drop_ascii=False) == 2
    assert ingest_raw_pages(store, raw, 0, drop_ascii=False) == 2  # committed: not taken again
    assert {r["word"] for r in views.occurrence_counts(store.facts()).collect()} == {"déjà", "vu"}
    assert rows(store.rejected()) == [("http://a.example/2", "status"), ("http://a.example/3", "unknown charset")]
    (tmp_path / "a.html").write_bytes("<p>été</p>".encode())
    (tmp_path / "b.txt").write_bytes(b"no page")
    files = decoded_pages(read_page_files(spark, str(tmp_path))).collect()
    assert [(r["html"], r["reason"]) for r in files] == [("<p>été</p>", None)]
