from pyspark.sql import functions as F

from tarnweave.functions import html, urls
from tarnweave.functions.hashing import to_bucket


def test_text_title_links():
    doc = '<html><head><title> A &amp;\n B</title><script>x<a href="/no"></script></head><body><p>Foo <b>BAR</b></p><a class=k href=" /x?y#z ">L</a><a/ href="/self"/><noscript><a href="/hid">h</a></noscript>&lt;T&gt;</body>'
    text, title, links = html.read(doc)
    assert title == "A & B"
    assert text == "\0foo \0bar\0l\0<t>"
    assert links == ["/x?y"]


def test_stray_end_tags_hide_text():
    assert html.read("</head>a<p>b")[0] == ""
    assert html.read("</script>a<script>b</script>c")[0] == "\0b"
    assert html.read("</style>a<style>b</style><style>x</style>c")[0] == "\0b\0x"


def test_tokenizer_corners():
    assert html.read("a < b <!-- <p>x --> c<!doctype html>d")[0] == "\0a < b \0 c\0d"
    assert html.read("<textarea><b>&amp;</textarea>x")[0] == "\0<b>&\0x"
    assert html.read("<xmp>&amp;</xmp>")[0] == "\0&amp;"
    assert html.read("<A HREF=/up>")[2] == ["/up"]
    assert html.read('<a href="/a?b&copy=1&amp;c">')[2] == ["/a?b&copy=1&c"]
    assert html.read("")[0] == "" and html.read("<")[0] == "\0<"
    assert html.read("<a")[2] == [] and html.read("x\r\ny")[0] == "\0x\ny"


def test_href_limits():
    assert html.clean_href(" \n") is None and html.clean_href("#f") == ""
    assert html.clean_href("/" + "a" * 500) is None and html.clean_href("/" + "a" * 499) is not None
    assert html.clean_href("/?" + "q" * 501) is None
    assert html.clean_href("/a%zz") is None and html.clean_href("a:b/c") is not None and html.clean_href("1:b") is None


def test_extract_guards(spark):
    rows = [(1, "<!doctype html><p>a</p>", 0), (2, "plain", 0), (3, "<html>" + "x" * 2_000_001, 0), (4, None, 0), (5, '<p ><a href="/l">t</a>', 40)]
    df = spark.createDataFrame(rows, "id int, html string, depth int")
    got = {r.id: r for r in html.extract(df, ["id"], depth="depth").collect()}
    assert set(got) == {1, 5} and got[5].links == [] and got[1].text == "\0a"


def test_urls(spark):
    cases = [("http://a.b.com/x/y?q=1", "z", "http://a.b.com/x/z"), ("http://a.b.com/x/y?q=1", "/z", "http://a.b.com/z"), ("http://a.b.com/x/y?q=1", "", "http://a.b.com/x/y?q=1"), ("http://a.b.com/x?q=1", "?r=2", "http://a.b.com/x?r=2"), ("https://a.b.com", "z", "https://a.b.com/z"), ("https://a.b.com/x", "//c.d/e", "https://c.d/e"), ("https://a.b.com/x", "ftp://c.d/e", "ftp://c.d/e"), ("http://a.b/x/y", "../z", "http://a.b/x/../z")]
    df = spark.createDataFrame(cases, "b string, l string, e string")
    for r in df.withColumn("g", urls.resolve(F.col("b"), F.col("l"))).collect():
        assert r.g == r.e
    c = F.col("u")
    df = spark.createDataFrame([("http://user@www.site.com:80/p/?a=\tb#f",), ("http://localhost/",), ("mailto:x@y.z",)], "u string")
    r = df.select(urls.host(c).alias("h"), urls.registered_domain(urls.host(c)).alias("d"), urls.relative(c).alias("r"), urls.uri_key(c).alias("k"), urls.crawlable(c).alias("c"), urls.origin(c).alias("o")).collect()
    assert tuple(r[0]) == ("www.site.com:80", "site.com:80", "/p/?a=%09b", "/p/?a=%09b", True, "http://user@www.site.com:80")
    assert r[1].d is None and not r[1].c and not r[2].c
    assert df.limit(1).select(urls.uri_key(F.lit("http://a.b/")).alias("k"), urls.uri_key(F.lit("http://a.b")).alias("l"), urls.request_url(F.lit("http://a.b"), F.lit("/x")).alias("m")).first() == ("", "", "http://a.b/x")


def test_bucket_wraps(spark):
    texts = ["", "a", "é" * 30, "x" * 200]
    got = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(to_bucket(F.col("t"), 17).alias("b")).collect()]
    assert got == [sum(b * 3 ** (k + 1) for k, b in enumerate(t.encode())) % 2**64 % 17 for t in texts]


def test_casing_goes_rune_by_rune(spark):
    from tarnweave.functions import text as tx

    rows = [("ΟΔΟΣ ΣΑΣ İstanbul ÉÀ", "οδοσ σασ istanbul éà"), ("AΣ.", "aσ."), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select(tx.lower_runes(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got) and [tx.lower_text(t) for t, _ in rows if t] == [w for _, w in rows if w]
    assert html.read("<p>ΟΔΟΣ</p>")[0] == "\0οδοσ"


def test_pages_are_read_in_slices():
    """A batch is read in slices of bounded HTML, a long page in one of its own; the rows stay as they are."""
    import pyarrow as pa

    pages = [f'<p>{"x" * 300_000}<a href="/{i}">' for i in range(9)] + ["<p>" + "y" * 1_500_000, None, "<p>", "<p>z<a href='/z'>"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(pages))), "_html": pages, "_links": [i % 2 == 0 for i in range(len(pages))]})
    got = list(html._run(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), True))
    assert [b.num_rows for b in got] == [3, 3, 3, 1, 3, 3]
    want = [(i, *html.read(pages[i] or "", i % 2 == 0)) for i in [*range(len(pages)), 2, 3, 4]]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
