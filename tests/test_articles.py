from wordloom.operators import articles
from wordloom.sources.readers import accepted_pages, read_text_files, rejected_pages

PAGE = """<!DOCTYPE html><html lang="ja"><head><title>緑色の&amp;想い出
 </title><meta name="author" content="A &lt;B&gt;">{site}</head><body>
<header><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
<article><h1>緑色の想い出</h1><p>{text}</p><p>一通の<ruby>手紙<rt>てがみ</rt></ruby>が<b>届い</b>た。</p>
<p><a href="/x">関連記事はこちら</a> 他</p><!-- <p>hidden</p> --></article>
<p>共通のお知らせ</p><footer><p>&copy; 2024</p></footer></body></html>"""


def pages(spark, *specs):
    return spark.createDataFrame(
        [(i, url, PAGE.format(text=text, site=site)) for i, (url, text, site) in enumerate(specs)],
        "page_id long, url string, html string",
    )


def test_metadata(spark, rows):
    site = '<meta property="og:site_name" content="サイト">'
    df = articles.page_metadata(
        pages(spark, ("https://u@Ex.example:8080/a?b", "x", ""), ("http://h.example", "x", site)))
    assert rows(df, "title", "author", "website", "source_type") == [
        ("緑色の&想い出", "A <B>", "ex.example", "website_article"),
        ("緑色の&想い出", "A <B>", "サイト", "website_article"),
    ]


def test_main_text(spark, rows):
    df = pages(
        spark, *[(f"http://a.example/{i}", f"本文その{i}です。長い記事。", "") for i in range(3)],
        ("http://b.example/", "別の本文。", ""))
    text = dict(rows(articles.main_text(articles.page_blocks(df)), "page_id", "text"))
    # On host a the heading, the letter and the notice repeat; on host b they do not.
    assert text[1] == "本文その1です。長い記事。"
    assert text[3] == "緑色の想い出\n別の本文。\n一通の手紙が届いた。\n共通のお知らせ"


def test_a_page_without_text_keeps_its_row(spark, rows):
    df = spark.createDataFrame(
        [(1, "http://a.example", "<html><body><nav><p>x</p></nav></body></html>"), (2, "u", None)],
        "page_id long, url string, html string")
    assert rows(articles.main_text(articles.page_blocks(df))) == [(1, 0, ""), (2, 0, "")]


def test_size_gate(spark, rows):
    df = spark.createDataFrame(
        [(1, "u", "x" * 9), (2, "u", "x" * 10), (3, "u", "あ" * 4), (4, "u", None)],
        "page_id long, url string, html string")
    assert rows(accepted_pages(df, 10), "page_id") == [(1,), (4,)]
    assert rows(rejected_pages(df, 10), "page_id") == [(2,), (3,)]


def test_text_files(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_text("一。\n二。", "utf8")
    (tmp_path / "b.txt").write_text("三", "utf8")
    assert rows(read_text_files(spark, str(tmp_path)), "text") == [("一。\n二。",), ("三",)]


def body(spark, *specs):
    return spark.createDataFrame(
        [(i, url, f"<html><body>{markup}</body></html>") for i, (url, markup) in enumerate(specs)],
        "page_id long, url string, html string")


def texts_of(rows, df):
    return dict(rows(articles.main_text(articles.page_blocks(df)), "page_id", "text"))


def test_copies_of_an_article_keep_their_text(spark, rows):
    article = "<p>One long story.</p><p>It goes on.</p>"
    others = [(f"http://a.example/{i}", f"<p>Other story {i}.</p><p>Share this</p>") for i in range(20)]
    same = [(f"http://a.example/s?{q}", article + "<p>Share this</p>") for q in ("", "print", "amp", "x")]
    near = [(f"http://a.example/n{i}", article + f"<p>Seen {i}</p><p>Share this</p>") for i in range(4)]
    got = texts_of(rows, body(spark, *others, *same, *near))
    assert got[3] == "Other story 3."
    assert all(got[i].startswith("One long story.\nIt goes on.") for i in range(20, 28))
    alone = texts_of(rows, body(spark, *others, *same))
    assert alone[20] == alone[23] == "One long story.\nIt goes on."  # copies of a page are one page


def test_tags_and_references(spark, rows):
    got = texts_of(rows, body(
        spark, ("http://a.example", "<script\ntype=x>var a=1;</script ><p\nclass=c>one<br/>two<NAV/>x</NAV>"),
        ("http://b.example", "<p>&#12354;&#x3042;&hellip;&amp;lt;&#0;&#xD800;&#39;&#; &nbsp; &#99999999;</p><navy>z</navy>")))
    assert got[0] == "one\ntwo"
    assert got[1] == "ああ…&lt;\ufffd\ufffd'&#; &#99999999;\nz"


def test_meta_in_any_order(spark, rows):
    html = ("<head><TITLE\n>T</TITLE><meta content='A' name=author><meta content=\"S\" property='og:site_name'></head>")
    df = spark.createDataFrame([(1, "http://h", html)], "page_id long, url string, html string")
    assert rows(articles.page_metadata(df), "title", "author", "website") == [("T", "A", "S")]


def test_unclosed_tags_take_linear_time(spark, rows):
    import time

    half = 2 << 20
    bad = ["<nav >" * (half // 6), "<" * half, "<!--" * (half // 4), "<a >x" * (half // 5), "<title>" * (half // 7),
           "<meta name=" * (half // 11), "&#" * (half // 2)]
    began = time.time()
    assert len(texts_of(rows, body(spark, *[("http://a.example", b) for b in bad]))) == len(bad)
    assert articles.page_metadata(body(spark, *[("http://a.example", b) for b in bad])).where("title = 'x'").count() == 0
    assert time.time() - began < 90
