import datetime as dt

from pyspark.sql import functions as F

from tarnweave.operators import frontier as fr
from tarnweave.operators import stats
from tarnweave.sources import snapshots
from tarnweave.sources.config import Config
from tarnweave.streaming import frontier_stream, stats_stream

def now():
    return F.lit("2024-01-02 00:00:00").cast("timestamp")


REFS = "host string, subdomain string, uri_key string, url string, internal boolean, source_depth int, source_cycle int, seq long"


def refs(spark, rows):
    return spark.createDataFrame([("h", "s", k, k, i, d, c, n) for n, (k, i, d, c) in enumerate(rows)], REFS)


def state(df):
    return {r.uri_key: (r.depth, r.cycle, r.queue) for r in df.collect()}


def test_site_over_cycles(spark):
    """Depths fall within a cycle and may rise with the next one; queues follow."""
    f = fr.upsert(frontier_stream.empty_frontier(spark), refs(spark, [("/", False, 0, 0)]), now())
    assert state(f) == {"/": (0, 0, "priority")}
    f = fr.upsert(f, refs(spark, [("/a", True, 0, 0), ("/a", True, 5, 0), ("/b", True, 3, 0)]), now())
    assert state(f) == {"/": (0, 0, "priority"), "/a": (1, 0, "priority"), "/b": (4, 0, "queue")}
    f = fr.upsert(f, refs(spark, [("/b", True, 0, 0)]), now())
    assert state(f)["/b"] == (1, 0, "priority")
    f = fr.upsert(f, refs(spark, [("/b", True, 1, 1), ("/b", True, 0, 0)]), now())
    assert state(f)["/b"] == (2, 1, "priority")
    f = fr.upsert(f, refs(spark, [("/b", False, 0, 0)]), now())
    assert state(f)["/b"][0] == 0


def test_refound_items(spark):
    base = [("h", "s", "/x", "/x", 5, 0, False, 0, None, None, None, 1), ("h", "s", "/y", "/y", 5, 0, True, 0, None, None, None, 2), ("h", "s", "/z", "/z", 5, 0, False, 2, dt.datetime(2024, 1, 1, 23, 59), None, "failqueue", 3), ("h", "s", "/w", "/w", 1, 0, False, 2, dt.datetime(2024, 1, 1), None, "failqueue", 4)]
    f = spark.createDataFrame(base, fr.FRONTIER)
    got = state(fr.upsert(f, refs(spark, [(k, True, 9, 1) for k in ("/x", "/y", "/z", "/w")] + [("/w", True, 1, 1)]), now()))
    assert got["/x"] == (10, 1, "low") and got["/y"][2] is None and got["/z"][2] == "failqueue" and got["/w"] == (2, 1, "priority")


def test_retries_look_at_heads_only(spark):
    late, early = dt.datetime(2024, 1, 1, 23, 59, 30), dt.datetime(2024, 1, 1, 1)
    rows = [("h", "s", str(i), "/", 0, 0, False, n, t, None, q, i) for i, (n, t, q) in enumerate([(1, late, "failqueue"), (1, early, "failqueue"), (3, early, "failqueue"), (0, None, "queue"), (0, None, "priority"), (2, None, "failqueue")])]
    f = spark.createDataFrame(rows, fr.FRONTIER)
    assert [r.seq for r in fr.retry_heads(f, now()).collect()] == [2]
    assert [r.seq for r in fr.next_requests(f, now(), 5).orderBy("turn").collect()] == [4, 3, 2]


def test_backoff_constants():
    assert fr.BACKOFF_MINUTES == {1: 1, 2: 8, 3: 68, 4: 571, 5: 4745, 6: 39390}


def test_load_resets(spark):
    hosts = spark.createDataFrame([("h", 3, None, 4)], "host string, fail_streak int, last_fail_streak timestamp, latest_cycle int")
    assert fr.load_resets(hosts, False, True).first().recrawl is False and fr.load_resets(hosts, True, True).first().recrawl is True
    item = spark.createDataFrame([("h", "s", "/", "/", 0, 0, False, 6, None, None, "queue", 1)], fr.FRONTIER)
    assert fr.same_frontier(item, item) and not fr.same_frontier(item, item.withColumn("depth", F.lit(1)))


def test_levels_and_admission(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 1), (9, 8)], "source long, target long")
    assert {r.node: r.depth for r in fr.link_levels(spark.createDataFrame([(1,)], "node long"), edges).collect()} == {1: 0, 2: 1, 3: 1}
    sleeping = spark.createDataFrame([("a", 2), ("b", 1)], "host string, seq long")
    assert [r.host for r in fr.admission(sleeping, 5, 4).collect()] == ["b"]
    chain = spark.range(45).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert fr.link_levels(spark.createDataFrame([(0,)], "node long"), chain).agg(F.max("depth")).first()[0] == 45
    assert fr.link_levels(spark.createDataFrame([(0,)], "node long"), chain, 2).count() == 3


def test_capacity():
    assert stats.fold_capacity(["decrease", "increase", "keep"], 100, 82) == [80, 82, 82]
    assert stats.fold_capacity(["decrease"] * 3, 2, 10, proxied=True) == [1, 1, 1]


def test_average_is_truncated_and_dated_by_the_middle(spark):
    rows = [("g", i, dt.datetime(2024, 1, 1, i), v) for i, v in enumerate([-1, -2, -2, 0])]
    r = stats.average_stats(spark.createDataFrame(rows, "k string, o int, date timestamp, v long"), ["k"], "o", ("v",)).first()
    assert r.v == -1 and r.date.hour == 2


def test_snapshot_round_trip(spark):
    item = "/x?y\t1\t2\tfalse\t0\t2024-01-02-03:04:05.5\t\t0"
    host = {"host": "a.com", "scheme": "http", "fail_streak": 1, "fail_count": 2, "last_fail_streak": None, "latest_cycle": 3, "subdomains": ["http://www.a.com"], "items": [{"queue": "priority", "level": None, "seq": 0, "line": item}, {"queue": "failqueue", "level": 6, "seq": 0, "line": item}, {"queue": None, "level": None, "seq": 0, "line": "bad"}]}
    text = snapshots.format_snapshot(host)
    assert snapshots.parse_snapshot(text) == host
    assert snapshots.parse_snapshot("a\tb\t1\t2\t3\n\n")["fail_streak"] == 0 and snapshots.parse_snapshot("x") is None
    rows = snapshots.snapshot_items(snapshots.read_snapshots(spark.createDataFrame([(text,), ("junk",)], "text string"))).collect()
    assert [(r.queue, r.level, r.url, r.last_download.microsecond, r.subdomain) for r in rows] == [("priority", None, "/x?y", 500000, "http://www.a.com"), ("failqueue", 6, "/x?y", 500000, "http://www.a.com")]
    c = F.col
    line = spark.createDataFrame([(item,)], "line string").transform(snapshots.decode_items).select(snapshots.encode_item(c("url"), c("depth"), c("cycle"), c("ignore"), c("fail_count"), c("last_download"), c("last_started"), c("subdomain_index")).alias("l")).first().l
    assert line == item


def test_config(tmp_path):
    p = tmp_path / "c.json"
    assert Config.load(p) == Config()
    Config(onion=True).save(p)
    assert Config.load(p).onion and "onion: True" in Config.load(p).describe()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, i // 3, i % 60), i * 1000, i, i % 7 == 0, f"h{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "ts timestamp, size long, duration long, timeout boolean, host string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stats_stream.downloads_stream(spark, str(tmp_path / "in"), df.schema)
    stats_stream.run_to_table(stats_stream.stream_minute_stats(stream, late="1 day"), "minutes", str(tmp_path / "ck"), "complete")
    assert sorted(spark.table("minutes").collect()) == sorted(stats.minute_stats(df).collect())


def test_minute_stats_count_hosts_exactly(spark, tmp_path):
    hosts = {0: 3000, 1: 1777, 2: 950}
    rows = [(dt.datetime(2024, 1, 1, 0, m, i % 60), 1, 1, i % 5 == 0, f"h{i}") for m, n in hosts.items() for i in [*range(n), *range(n // 2)]]
    df = spark.createDataFrame([*rows, (dt.datetime(2024, 1, 1, 0, 3), 1, 1, False, None)], "ts timestamp, size long, duration long, timeout boolean, host string")
    assert [r.domains for r in stats.minute_stats(df).orderBy("date").collect()] == [*hosts.values(), 0]
    df.write.parquet(str(tmp_path / "in"))
    stream = stats_stream.downloads_stream(spark, str(tmp_path / "in"), df.schema)
    stats_stream.run_to_table(stats_stream.stream_minute_stats(stream, late="1 day"), "hosts", str(tmp_path / "ck"), "complete")
    assert [r.domains for r in spark.table("hosts").orderBy("date").collect()] == [*hosts.values(), 0]


def test_frontier_stream_equals_batch(spark, tmp_path):
    rows = [("/" + str(i % 9), i % 4 != 0, i % 5, i % 2) for i in range(60)]
    df = refs(spark, rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    frontier_stream.stream_frontier(stream, str(tmp_path / "state"), str(tmp_path / "ck"), now())
    got = frontier_stream.latest_frontier(spark, str(tmp_path / "state"))
    assert fr.same_frontier(got, fr.upsert(frontier_stream.empty_frontier(spark), df, now()))


def test_crawl_round(spark):
    from tarnweave.plans.ast import Query, Text

    page = '<html><head><title>T</title></head><body><p>some cat here </p><a href="/a">x</a><a href="http://o.org/b">y</a><a href="ftp://z.org/">n</a>'
    pages = spark.createDataFrame([("http://www.s.com/i", page, 0, 0, 1)], "url string, html string, depth int, cycle int, seq long")
    results, f = frontier_stream.crawl_round(pages, frontier_stream.empty_frontier(spark), [Query("q", Text("cat"))], now())
    r = results.first()
    assert (r.query_id, r.url, r.host, r.title, r.occurrences) == ("q", "http://www.s.com/i", "s.com", "T", 1)
    assert sorted((x.host, x.subdomain, x.url, x.depth, x.queue) for x in f.collect()) == [("o.org", "o.org", "/b", 0, "priority"), ("s.com", "www.s.com", "/a", 1, "priority")]


def test_snapshots_by_columns_are_those_of_python(spark):
    """Texts and rows as ``format_snapshot`` and ``parse_snapshot`` give them, without Python workers."""
    queues_ = [("introduction", None), ("priority", None), ("queue", None), ("low", None), *(("failqueue", k) for k in range(snapshots.LEVELS)), (None, None), ("other", None), ("failqueue", 9)]
    items = [{"queue": q, "level": level, "seq": s, "line": f"/{q}{level}{s}"} for s in (2, 0, 1, 11, 0) for q, level in queues_[:: 1 + s % 2]]
    base = {"host": "a.com", "scheme": "http", "fail_streak": 1, "fail_count": -2, "last_fail_streak": "2024-01-02-03:04:05", "latest_cycle": 3, "subdomains": ["http://www.a.com", "http://a.com"], "items": items}
    hosts = [base, base | {"host": "b.com", "items": [], "subdomains": [], "last_fail_streak": None}, base | {"host": "c.com", "items": items[::-3]}]
    schema = "host string, scheme string, fail_streak int, fail_count int, last_fail_streak string, latest_cycle int, subdomains array<string>, items array<struct<queue:string,level:int,seq:int,line:string>>"
    df = snapshots.snapshot_texts(spark.createDataFrame(hosts, schema))
    texts = {r.host: r.text for r in df.collect()}
    assert texts == {h["host"]: snapshots.format_snapshot(h) for h in hosts}
    t = texts["a.com"]
    odd = [t, texts["b.com"], t.replace("\n", "\r\n"), t[:-1], t + "\n\nmore\n", t[: len(t) // 2], "a\tb\t1\t2\t3", "a\tb\t1\t2\t3\n", "a\tb\t1\t2\t3\n\n\n/x\n\r\n\r\r\n/y\r\r\n", "a\tb\t1\t2\t\t3\n\n/é\ty", "a\tb\t 1 \t+2\t\t3", "a\tb\tx\t2\t\t3\n/x", "a\tb\t1\t\t3", "a\tb", "", None, "\n\n", "a\tb\t99999999999\t2\t3"]
    read = snapshots.read_snapshots(spark.createDataFrame([(x,) for x in odd], "text string"))
    assert "Python" not in (plan := read._jdf.queryExecution().optimizedPlan().toString()) and "InArrow" not in plan
    want = [r for x in odd[:-1] if x and (r := snapshots.parse_snapshot(x))]
    assert [r.asDict(True) for r in read.collect()] == want and read.dtypes == spark.createDataFrame([], schema).dtypes
