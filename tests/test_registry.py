"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from tarnweave import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in registry.ORACLE_SQL:
        r = con.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    else:
        assert got


def test_upsert_knows_all_orders(spark):
    keys = ["host", "subdomain", "uri_key"]
    kept = [*keys, "fail_count", "ignore", "last_started"]
    known = registry.frontier.deduplicate(registry._frontier(spark, SF), keys, ["seq"])
    got = registry.f_upsert(spark, SF)
    n = known.count()
    assert known.select(kept).exceptAll(got.select(kept)).count() == 0
    new = got.join(known, keys, "left_anti")
    assert n and new.count() == n and new.where("fail_count = 0 and last_started is null").count() == n


def _same_as_sql(spark, name, sf, **tables):
    """The query over a folder of the given tables, and its SQL over the same."""
    import duckdb

    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{sf}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(sf))
    want = c.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]}) t").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_outcomes_of_large_keys(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").limit(200).withColumn("o_orderkey", registry.F.col("o_orderkey") + 2_000_000)
    got = _same_as_sql(spark, "f_outcomes", tmp_path, orders=orders)
    assert any(r[3] == 0 and not r[4] for r in got)


def _cut_pages(spark):
    """Titles and texts that end within an entity."""
    page = "<!doctype html><html><head><title>Of&amp;&{0}</title></head><body><p>of&amp;&{0}</p>x&quot;</body></html>"
    rows = [(i, f"http://a.com/{i}", page.replace("{0}", cut)) for i, cut in enumerate(("amp", "am", "quot", "lt", "a"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_titles_cut_within_an_entity(spark, tmp_path):
    want = _same_as_sql(spark, "p_title", tmp_path, pages=_cut_pages(spark))
    assert (0, "Of&&amp") in want


def test_texts_cut_within_an_entity(spark, tmp_path):
    want = _same_as_sql(spark, "p_visible_text", tmp_path, pages=_cut_pages(spark))
    assert (0, "\0of&&amp\0x\"") in want


def test_entities_of_both_kinds():
    from tarnweave.functions import html

    assert html.unescape("&amp;&amp&#65;&#65&ampx;&lt") == "&&AA&x;<"
    assert html.unescape("&amp;&amp&#65;&#65&ampx;&lt", bare=False) == "&&ampA&#65&ampx;&lt"
    assert html.unescape("a?b&copy=1&amp", True, False) == "a?b&copy=1&"
    assert html.read("<textarea>&amp;&amp</textarea>&lt", bare=False)[0] == "\0&&amp\0&lt"


#: Pages without text, title or signature, none at all, one over the size limit, and entities that the SQL leaves.
ODD = [
    None,
    "",
    "plain text",
    "<svg>a</svg><a href=\"/s\">B</a>",
    "\ufeff<!doctype html><p>b</p>",
    "<!doctype html><html><head><title>T</title></head><body><p></p><br></body></html>",
    "<html><body>no title</body></html>",
    "<html><head><title>a&copy;b&#39;c&lt;&AMP;</title></head><body><p>it&#x27;s&nbsp;&copy;&#39;&lt;b&hellip;&AMP;&amp;quot;</p></body></html>",
    "<html><body><p>" + "the x " * 340_000 + "</p><a href=\"/big\">L</a></body></html>",
]


@pytest.mark.parametrize("name", ["p_visible_text", "p_title", "p_page_query", "p_links", "p_link_count", "u_resolve", "u_internal_external"])
def test_odd_pages(spark, tmp_path, name):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", h) for i, h in enumerate(ODD)], "page_id long, url string, html string")
    assert _same_as_sql(spark, name, tmp_path, pages=pages)


def test_listed_entities():
    from tarnweave.functions import html

    assert html.unescape("&lt;&gt;&lt&#65;&LT;&amp;lt;", only=("&lt;", "&amp;")) == "<&gt;&lt&#65;&LT;&lt;"
    assert html.read("<a href='/a?b&amp;c'>&gt;&lt;", only=("&lt;",)) == ("\0&gt;<", None, ["/a?b&c"])
