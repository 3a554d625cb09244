import datetime as dt
import json

from pyspark.sql import functions as F

from tarnweave.engine import RESPONSES, Engine
from tarnweave.functions import urls
from tarnweave.operators import frontier as fr
from tarnweave.operators import lifecycle as lc
from tarnweave.operators import queues
from tarnweave.sources import snapshots
from tarnweave.sources.config import Config
from tarnweave.sources.queries import QuerySet
from tarnweave.sources.tables import pages_stream, seeds
from tarnweave.streaming.matching_stream import stream_matches

STORED = json.dumps([{"name": "cat", "root": {"type": "text", "text": "cat"}}])


def clock_from(start):
    """A clock that a test can set; every look takes a second."""
    at = [start]

    def now():
        at[0] += dt.timedelta(seconds=1)
        return F.lit(at[0].strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")

    return at, now


class Site:
    """test.com: every page links to the root, /contact/ and /info/; shallow pages add two below themselves.
    From the third cycle on the root doesn't link to /contact/."""

    def __init__(self, spark, deepest=1):
        self.spark, self.deepest, self.asked, self.cycle = spark, deepest, [], 0

    def page(self, path):
        links = ["/", "/info/"] + (["/contact/"] if path != "/" or self.cycle <= 2 else [])
        if path not in ("/contact/", "/info/") and path.count("page") < self.deepest:
            links += [f"{path}page1/", f"{path}page2/"]
        return "<html><body><p>a cat </p>" + "".join(f'<a href="{x}">x</a>' for x in links)

    def __call__(self, wanted):
        rows = []
        for r in wanted.orderBy("place").collect():
            self.asked.append((self.cycle, r.request_url))
            rows.append((r.host, r.subdomain, r.uri_key, r.place, 200, None, True, 900, "http", r.request_url, self.page(r.request_url.removeprefix("http://www.test.com"))))
        return self.spark.createDataFrame(rows, RESPONSES)


def test_site_through_cycles(spark, tmp_path):
    """The whole site is read once a cycle, depths and queues are those of the reference scenario, and a new engine goes on."""
    (tmp_path / "q.json").write_text(STORED)
    config = Config(turn_requests=30, turn_spread=20)
    start = lambda: Engine(spark, str(tmp_path / "state"), str(tmp_path / "q.json"), config)
    at, now = clock_from(dt.datetime(2024, 1, 2))
    e, site = start(), Site(spark)
    e.add_urls(seeds(spark, ["http://www.test.com/"]), now())
    e.run(site, now)
    state = {r.uri_key: r for r in e.frontier().collect()}
    assert len(site.asked) == len(set(site.asked)) == len(state) == 5
    assert state[""].depth == 0 and state["/info"].depth == 1 and state["/contact"].depth == 1
    assert all(r.depth == k.count("page") for k, r in state.items() if "page" in k)
    assert state[""].queue == "introduction" and all(r.queue is None and r.last_download for k, r in state.items() if k)
    assert spark.read.parquet(str(tmp_path / "state/results")).count() == 5
    assert e.next_recrawl(now()) > 3600
    for cycle, of_site in ((1, 3),):
        at[0] += dt.timedelta(hours=13)
        e, site.cycle = start(), of_site
        e.check_recrawls(now())
        assert e.hosts().first().sleeping
        e.run(site, now)
        asked = [u for c, u in site.asked if c == of_site]
        assert len(asked) == len(set(asked)) == 5
        state = {r.uri_key: r for r in e.frontier().collect()}
        assert {r.cycle for r in state.values()} == {cycle}
        assert state["/contact"].depth == (1 if of_site <= 2 else 2) and state["/info"].depth == 1
    assert e.hosts().first().latest_cycle == 1


def test_engine_limits_and_restart(spark, tmp_path):
    (tmp_path / "q.json").write_text(STORED)
    _, now = clock_from(dt.datetime(2024, 1, 2))
    e = Engine(spark, str(tmp_path / "state"), str(tmp_path / "q.json"), Config(max_domains=2, start_clients=1))
    e.add_urls(seeds(spark, ["http://a.com/", "http://b.com/x/../y", "http://c.com/", "nonsense"]), now())
    assert sorted(r.host for r in e.frontier().collect()) == ["a.com", "b.com"]
    first = e.start_turn(now()).collect()
    assert [(r.host, r.request_url) for r in first] == [("a.com", "http://a.com/")]
    again = Engine(spark, str(tmp_path / "state"), None, e.config)  # as after a crash within the turn
    assert [r.request_url for r in again.next_requests(now()).collect()] == ["http://a.com/"]
    page = '<html><body>a cat <a href="/n">n</a><a href="http://d.com/">d</a>'
    done = spark.createDataFrame([("a.com", "a.com", "", 1, 200, None, True, 90, "https", "https://a.com/", page)], RESPONSES)
    assert [(r.query_id, r.host) for r in e.finish_turn(done, now()).collect()] == [("cat", "a.com")]
    hosts = {r.host: r for r in e.hosts().collect()}
    assert set(hosts) == {"a.com", "b.com"} and hosts["a.com"].scheme == "https" and hosts["a.com"].sleeping and not hosts["a.com"].in_memory
    assert [r.request_url for r in e.start_turn(now()).collect()] == ["http://b.com/y"]
    # a reference to a host on disk waits until it runs
    e.add_urls(seeds(spark, ["http://a.com/later"]), now())
    assert e.pending().count() == 1 and e.frontier().where("url = '/later'").count() == 0
    e.finish_turn(spark.createDataFrame([], RESPONSES), now())
    assert sorted(r.request_url for r in e.start_turn(now()).collect()) == ["https://a.com/later", "https://a.com/n"]
    assert e.pending().count() == 0 and len(e.store.versions()) <= 3
    loads = spark.createDataFrame([(dt.datetime(2024, 1, 2, 0, 0, i), 120 * 1024, 40, i == 5, "a.com") for i in range(6)], "ts timestamp, size long, duration long, timeout boolean, host string")
    for _ in range(2):
        e.save_stats(loads, e.gauges(F.lit("2024-01-02 00:00:30").cast("timestamp")))
    rows = spark.read.parquet(str(tmp_path / "state/stats")).collect()
    assert [(r.requests, r.timeouts, r.workers, r.domains, r.download_speed, r.download_time, r.download_size) for r in rows] == [(5, 1, 1, 2, 10, 40, 120)] * 2 and rows[0].memory_sys >= rows[0].memory_alloc > 0
    e.stop()
    assert e.run(lambda wanted: None, now) == 0


def test_outcomes_of_a_turn(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    when = dt.datetime(2024, 1, 2)
    cases = [
        ("ok", 200, None, "/a", 0), ("late", 404 + 3, None, "/a", 0), ("gone", 404, None, "/a", 0), ("busy", 503, None, "/a", 1), ("last", 503, None, "/a", 6),
        ("cancel", None, "context canceled", "/a", 2), ("moved", 200, None, "http://o.org/z?q", 0), ("flip", None, "http: server gave HTTP response to HTTPS client", "/a", 0), ("loop", None, "stopped after 10 redirects", "/a", 0),
    ]
    items = spark.createDataFrame([("h.com", "h.com", k, k, 0, 0, False, n, None, None, "priority", i) for i, (k, *_, n) in enumerate(cases)], fr.FRONTIER)
    hosts = lc.new_hosts(spark.createDataFrame([], lc.HOSTS), spark.createDataFrame([("h.com", 1)], "host string, seq long"))
    done = spark.createDataFrame([("h.com", "h.com", k, i, s, e, True, 10, "https", u if "//" in u else "https://h.com" + u) for i, (k, s, e, u, _) in enumerate(cases)], lc.OUTCOMES)
    done = lc.judged(done)
    after, h = lc.apply_outcomes(items, hosts, done, now)
    got = {r.uri_key: (r.queue, r.fail_count, r.ignore) for r in after.collect()}
    assert got == {
        "ok": ("introduction", 0, False), "late": ("failqueue", 5, False), "gone": (None, 0, True), "busy": ("failqueue", 2, False), "last": (None, 7, False),
        "cancel": ("failqueue", 2, False), "moved": (None, 0, True), "flip": ("failqueue", 1, False), "loop": (None, 0, True),
    }
    assert [(r.host, r.url, r.internal) for r in lc.moved_references(done).collect()] == [("o.org", "/z?q", False)]
    row = h.first()
    assert (row.scheme, row.fail_count, row.fail_streak, row.last_fail_streak) == ("http", 1, 0, None)
    assert {r.last_started for r in after.collect() if r.uri_key != "ok"} == {when}


def test_fail_streaks(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")

    def after(count, streak, outcomes):
        """Host state after outcomes: e a first-time network failure, E a later one, s a bad status, o a page, r a 429."""
        items = spark.createDataFrame([("h.com", "h.com", str(i), str(i), 1, 0, False, 1 if c == "E" else 0, None, None, "queue", i) for i, c in enumerate(outcomes)], fr.FRONTIER)
        hosts = spark.createDataFrame([("h.com", "http", streak, count, dt.datetime(2024, 1, 1), 0, 0, False, True, True, False, False, 1)], lc.HOSTS)
        rows = [("h.com", "h.com", str(i), i, {"s": 500, "o": 200, "r": 429}.get(c), "EOF" if c in "eE" else None, True, 1, "http", "http://h.com/") for i, c in enumerate(outcomes)]
        r = lc.apply_outcomes(items, hosts, lc.judged(spark.createDataFrame(rows, lc.OUTCOMES)), now)[1].first()
        return r.fail_count, r.fail_streak, r.last_fail_streak

    before, stamp = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    assert after(3, 2, "eEes") == (5, 2, before)
    assert after(3, 2, "eeo") == (0, 0, None)
    assert after(3, 2, "eoe") == (1, 0, None)
    assert after(38, 2, "eee") == (0, 3, stamp)
    assert after(38, 2, "eeeee") == (2, 3, stamp)
    assert after(0, 0, "er") == (0, 1, stamp)
    assert after(5, 1, "or") == (0, 1, stamp)
    # references to a resting host are dropped
    hosts = spark.createDataFrame([("h.com", "http", 2, 0, stamp, 0, 0, False, False, True, False, False, 1)], lc.HOSTS)
    refs = spark.createDataFrame([("h.com", "h.com", "/x", "/x", False, 0, 0, 1)], lc.PENDING)
    empty = [spark.createDataFrame([], s) for s in (fr.FRONTIER, lc.PENDING)]
    assert lc.add_references(empty[0], hosts, empty[1], refs, now)[0].count() == 0
    # more than fifty waiting references wake a host on disk
    disk = hosts.withColumns({"last_fail_streak": F.lit(None).cast("timestamp"), "in_memory": F.lit(False)})
    for n, woken in ((50, False), (51, True)):
        many = spark.range(n).select(F.lit("h.com").alias("host"), F.lit("h.com").alias("subdomain"), F.concat(F.lit("/"), "id").alias("uri_key"), F.concat(F.lit("/"), "id").alias("url"), F.lit(False).alias("internal"), F.lit(0).alias("source_depth"), F.lit(0).alias("source_cycle"), F.col("id").alias("seq"))
        f, h, p = lc.add_references(empty[0], disk, empty[1], many, now)
        assert (f.count(), p.count(), h.first().woken) == (0, n, woken)
        assert lc.wake(f, h, now).first().sleeping == woken


def test_rescan_forces_recrawls(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    items = spark.createDataFrame([("h.com", "h.com", "", "/", 0, 0, False, 0, None, dt.datetime(2024, 1, 2), "introduction", 1)], fr.FRONTIER)
    hosts = spark.createDataFrame([("h.com", "http", 0, 0, None, 4, 0, False, False, False, False, False, 1)], lc.HOSTS)
    assert not lc.wake(items, lc.ask_recrawls(items, hosts, now), now).first().sleeping
    asked = lc.rescan(items, hosts, now)
    assert asked.first().sleeping and asked.first().recrawl_later and not lc.rescan(items, hosts, now, few=0).first().sleeping
    f, h, _ = lc.start_turns(items, asked, spark.createDataFrame([], lc.PENDING), now, 5)
    assert (f.first().queue, f.first().cycle, h.first().latest_cycle, h.first().running) == ("priority", 5, 5, True)


def test_request_urls(spark):
    rows = [("/a/./b/../c", "/a/c"), ("/..", "/"), ("/a/..", "/"), ("/a/.", "/a/"), ("x", "/x"), ("", ""), ("/a?b=/../c", "/a?b=/../c"), ("/../../a/", "/a/")]
    got = spark.createDataFrame(rows, "r string, want string").select(urls.request_url(F.lit("http://h.com"), F.col("r")).alias("u"), "want").collect()
    assert [r.u for r in got] == ["http://h.com" + r.want for r in got]


def test_queries_survive_a_bad_refresh(spark, tmp_path):
    p = tmp_path / "q.json"
    p.write_text(STORED)
    q = QuerySet(spark, str(p))
    p.write_text("[{}]")
    assert q.refresh()[0].name == "cat"


def test_stream_matches(spark, tmp_path):
    (tmp_path / "q.json").write_text(STORED)
    df = spark.createDataFrame([(1, "a cat"), (2, "a dog")], "id int, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pages_stream(spark, str(tmp_path / "in"), "id int, text string")
    stream_matches(stream, QuerySet(spark, str(tmp_path / "q.json")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(r.id, r.query_id, r.snippet) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "cat", "a cat")]


def test_snapshot_folder(spark, tmp_path):
    """An engine's state goes to snapshot files, and another engine begins with them."""
    (tmp_path / ".host_b.com.txt").write_text("x")
    (tmp_path / "host_local.txt").write_text("x")
    items = spark.createDataFrame(
        [("a.com", "www.a.com", "", "/", 0, 3, False, 0, None, dt.datetime(2024, 1, 1), "introduction", 5), ("a.com", "www.a.com", "/x", "/x", 1, 3, False, 0, None, None, "priority", 7), ("a.com", "i.a.com", "/y", "/y", 2, 3, False, 2, dt.datetime(2024, 1, 1, 3), None, "failqueue", 8), ("a.com", "i.a.com", "/z", "/z", 2, 3, True, 0, None, None, None, 2)], fr.FRONTIER
    )
    hosts = spark.createDataFrame([("a.com", "https", 1, 2, dt.datetime(2024, 1, 1), 3, 0, True, False, True, False, False, 1), ("e.com", "http", 0, 0, None, 0, 0, False, False, True, False, False, 0)], lc.HOSTS)
    snapshots.write_snapshots(snapshots.to_snapshots(items, hosts), str(tmp_path))
    text = (tmp_path / "host_a.com.txt").read_text()
    assert text.startswith("a.com\thttps\t1\t2\t2024-01-01-00:00:00\t3\nhttps://i.a.com\nhttps://www.a.com\n\n/\t0\t3\tfalse\t0\t2024-01-01-00:00:00\t\t1\n\n")
    parsed = snapshots.parse_snapshot(text)
    assert [(x["queue"], x["level"]) for x in parsed["items"]] == [("introduction", None), ("priority", None), ("failqueue", 2), (None, None)]
    e = Engine(spark, str(tmp_path / "state"), config=Config(force_recrawl=True))
    e.load_snapshots(str(tmp_path))
    same = ["host", "subdomain", "uri_key", "url", "depth", "cycle", "ignore", "fail_count", "last_started", "last_download", "queue"]
    assert fr.same_frontier(e.frontier().select(same), items.select(same))
    loaded = {r.host: r for r in e.hosts().collect()}
    assert loaded["a.com"].recrawl_later and loaded["a.com"].scheme == "https" and loaded["a.com"].last_fail_streak == dt.datetime(2024, 1, 1) and set(loaded) == {"a.com", "e.com"}


def test_fifo_scenario(spark):
    """Push, pop, remove and clear, step by step."""
    none = spark.createDataFrame([], "queue string, item string, seq long")
    kept = lambda df: spark.createDataFrame(df.collect(), none.schema)
    put = lambda q, item, queue="q": kept(queues.push(q, spark.createDataFrame([(queue, item, 0)], none.schema))[0])

    def ends(q):
        return {r.queue: (r.first, r.last, r.length) for r in queues.ends(q).collect()}

    q = put(none, "1")
    assert ends(q) == {"q": ("1", "1", 1)}
    q = put(put(q, "2"), "3")
    assert ends(q) == {"q": ("1", "3", 3)}
    again, refused = queues.push(q, spark.createDataFrame([("other", "2", 0), ("other", "9", 1)], "queue string, item string, seq long"))
    assert [r.item for r in refused.collect()] == ["2"] and ends(again)["other"] == ("9", "9", 1)
    popped, q = map(kept, queues.pop(q))
    assert [r.item for r in popped.collect()] == ["1"] and ends(q) == {"q": ("2", "3", 2)}
    q = queues.remove(put(q, "4"), spark.createDataFrame([("3",)], "item string"))
    assert ends(q) == {"q": ("2", "4", 2)}
    q = queues.clear(q, "q")
    assert ends(q) == {}
    q = put(put(q, "2"), "3")
    both = queues.merge(put(put(q, "8", "r"), "7", "r"), "q", "r")
    assert ends(both) == {"q": ("2", "7", 4)} and [r.item for r in both.orderBy("seq").collect()] == ["2", "3", "8", "7"]
    popped, q = queues.pop(q, 2)
    assert sorted(r.item for r in popped.collect()) == ["2", "3"] and ends(q) == {}


def test_leveled_scenario(spark):
    """Of each level only the head counts, and the lowest level with a due head goes first."""
    rows = [("f", i, n, level, False) for n, (i, level) in enumerate(zip(range(1, 10), (1, 1, 1, 2, 2, 2, 3, 4, 4), strict=True))]
    q = spark.createDataFrame(rows, "queue string, item int, seq int, level int, due boolean")
    mark = lambda df, *due: df.withColumn("due", F.col("due") | F.col("item").isin(*due))
    take = lambda df: queues.pop_due(df, F.col("due"))
    assert take(q)[0].count() == 0
    q = mark(q, 4, 5, 8)
    for want in (4, 5, 8):
        got, q = take(q)
        assert [r.item for r in got.collect()] == [want]
        q = spark.createDataFrame(q.collect(), q.schema)
    q = mark(queues.remove(q, spark.createDataFrame([(1,)], "item int")), 2)
    got, q = take(q)
    assert [r.item for r in got.collect()] == [2] and take(q)[0].count() == 0
