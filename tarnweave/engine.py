"""The crawl engine over tables: configuration, stored queries, hosts, frontier and pending references, in turns.

A turn starts sleeping hosts, hands out their requests, and takes the responses: it matches the stored
queries, stores results, and moves items, hosts and references on. State is a version of the store per step, so an engine
that is started anew over the same folder goes on where the last complete version left off, and a step
that broke off is done again from the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.html import extract
from .operators import frontier as fr
from .operators import lifecycle as lc
from .operators.matching import result_rows
from .operators.stats import minute_stats, stats_row
from .plans.ast import Query
from .sources.config import Config
from .sources.queries import QuerySet
from .sources.snapshots import host_rows, read_snapshots, snapshot_items
from .sources.state import Store
from .sources.tables import append_results, host_directory, write_temporary
from .streaming.frontier_stream import LINKS_PER_PAGE, links_of

__all__ = ["Engine", "links_of"]
RESPONSES = lc.OUTCOMES + ", html string"


@dataclass
class Engine:
    """``path`` holds the store and the results; ``query_path`` the stored queries' JSON."""

    spark: SparkSession
    path: str
    query_path: str | None = None
    config: Config = field(default_factory=Config)
    stopped: bool = False

    def __post_init__(self) -> None:
        self.store = Store(self.spark, f"{self.path}/state")
        self.version = self.store.latest()
        self.query_set = None if self.config.testing or not self.query_path else QuerySet(self.spark, self.query_path)

    @property
    def queries(self) -> list[Query]:
        return self.query_set.queries if self.query_set else []

    def refresh(self) -> None:
        """Load the stored queries anew; an unreadable set keeps the one before."""
        if self.query_set:
            self.query_set.refresh()

    def frontier(self, buckets: list[int] | None = None) -> DataFrame:
        return self.store.read("frontier", fr.FRONTIER, self.version, buckets)

    def hosts(self) -> DataFrame:
        return self.store.read("hosts", lc.HOSTS, self.version)

    def pending(self) -> DataFrame:
        return self.store.read("pending", lc.PENDING, self.version)

    def _commit(self, touched: list[int] | None, frontier: DataFrame | None, hosts: DataFrame, pending: DataFrame | None = None) -> None:
        every = list(range(self.store.buckets))
        tables = {"hosts": (hosts, every)}
        if frontier is not None:
            tables["frontier"] = (frontier, every if touched is None else touched)
        if pending is not None:
            tables["pending"] = (pending, every)
        self.version = self.store.write(self.version + 1, tables)
        self.store.forget()

    def load_snapshots(self, path: str) -> None:
        """Begin with the hosts, items and queues of a folder of snapshot files; streaks are reset and recrawls asked for as configured."""
        files = read_snapshots(host_directory(self.spark, path, self.config.onion))
        hosts = host_rows(files)
        items = snapshot_items(files).select("host", F.regexp_replace("subdomain", "^[a-z]+://", "").alias("subdomain"), F.regexp_replace("url", r"/\z", "").alias("uri_key"), "url", "depth", "cycle", "ignore", "fail_count", "last_started", "last_download", "queue", F.col("seq").cast("long").alias("seq"))
        hosts = fr.load_resets(hosts, self.config.reset_fail_streak, self.config.force_recrawl)
        hosts = hosts.withColumns({"recrawl_later": F.col("recrawl"), "woken": F.col("recrawl")}).drop("recrawl")
        typed = items.select(*(F.col(f.name).cast(f.dataType) for f in self.frontier().schema))
        self._commit(None, typed, lc.wake(typed, hosts, F.current_timestamp()), self.pending())

    def add_urls(self, links: DataFrame, now: Column) -> DataFrame:
        """External references (seq, url) by registered domain, as far as the number of hosts allows."""
        rows = write_temporary(lc.external_references(links, self.config.onion), "references")
        hosts = self.hosts()
        hosts = write_temporary(hosts.unionByName(lc.new_hosts(hosts, rows, self.config.max_domains)), "hosts")
        touched = self.store.touched(rows)
        frontier, hosts, pending = map(write_temporary, lc.add_references(self.frontier(touched), hosts, self.pending(), rows, now), ("frontier", "hosts", "pending"))
        self._commit(touched, frontier, lc.wake(frontier, hosts, now), pending)
        return self.frontier()

    def start_turn(self, now: Column) -> DataFrame:
        """Start as many hosts as clients are free, and give their requests in order of ``place``."""
        hosts = self.hosts()
        used = hosts.where("running").count()
        go = fr.admission(hosts.where("sleeping"), self.config.start_clients, used)
        touched = self.store.touched(go.unionByName(hosts.where("running")).select("host"))
        frontier, hosts, pending = lc.start_turns(self.frontier(touched), hosts, self.pending(), now, self.config.start_clients, used)
        self._commit(touched, frontier, hosts, pending)
        return self.next_requests(now)

    def next_requests(self, now: Column) -> DataFrame:
        """The requests of the hosts that run."""
        return lc.requests(self.frontier(), self.hosts(), now, self.config.turn_requests, self.config.turn_spread)

    def finish_turn(self, responses: DataFrame, now: Column) -> DataFrame:
        """Take the responses of a turn (``RESPONSES``): store results and state, return the results. Every running host ends its turn."""
        onion = self.config.onion
        done = write_temporary(lc.judged(responses, onion), "responses")
        read = done.where(F.col("outcome").isin("finished", "moved"))
        base = self.frontier(self.store.touched(done))
        seq = F.floor(F.unix_micros(now) * 1000 / LINKS_PER_PAGE) + F.col("place")
        pages = read.join(base.select(*lc.KEYS, "depth", "cycle"), lc.KEYS).select(F.col("final_url").alias("url"), "host", "depth", "cycle", seq.cast("long").alias("seq"), "html")
        parsed = write_temporary(extract(pages, ["url", "host", "depth", "cycle", "seq", "html"], depth="depth"), "parsed")
        found = result_rows(parsed, self.queries, "url", "host", "title", "html", "text", now)
        target = f"{self.path}/results/round={self.version + 1}"
        found.write.mode("overwrite").parquet(target)
        references = links_of(parsed, onion).unionByName(lc.moved_references(done, onion))
        references = write_temporary(references, "references")
        hosts = self.hosts()
        hosts = write_temporary(hosts.unionByName(lc.new_hosts(hosts, references, self.config.max_domains)), "hosts")
        touched = self.store.touched(done.select("host").unionByName(references.select("host")).unionByName(hosts.where("running").select("host")))
        frontier, hosts = lc.apply_outcomes(self.frontier(touched), hosts, done, now)
        frontier, hosts = write_temporary(frontier, "frontier"), write_temporary(hosts, "hosts")
        frontier, hosts, pending = map(write_temporary, lc.add_references(frontier, hosts, self.pending(), references, now), ("frontier", "hosts", "pending"))
        frontier, hosts, pending = lc.end_turns(frontier, hosts, pending, now)
        self._commit(touched, frontier, hosts, pending)
        return self.spark.read.schema(found.schema).parquet(target)

    def rescan(self, now: Column, few: int = 100) -> None:
        """What is due every few minutes: fresh queries, idle hosts that want to get up, recrawls by force if few sleep."""
        self.refresh()
        self._commit([], None, lc.rescan(self.frontier(), self.hosts(), now, few))

    def check_recrawls(self, now: Column) -> None:
        """Note down the recrawls that are due."""
        frontier = self.frontier()
        self._commit([], None, lc.wake(frontier, lc.ask_recrawls(frontier, self.hosts(), now), now))

    def next_recrawl(self, now: Column) -> float | None:
        """Seconds until the recrawl timer should look again; None without introduction points."""
        due = fr.recrawl_due_seconds(self.frontier().where("queue = 'introduction'"), now).agg(F.min("due_in").alias("due_in"))
        return due.select(fr.recrawl_timer(F.col("due_in"))).where("due_in is not null").collect()[0][0] if due.first()["due_in"] is not None else None

    def save_stats(self, downloads: DataFrame, gauges: DataFrame) -> None:
        """Append the statistics rows of finished downloads, with the gauges of their minutes, to the engine's statistics."""
        append_results(stats_row(minute_stats(downloads), gauges), f"{self.path}/stats")

    def gauges(self, now: Column) -> DataFrame:
        """One row of gauges: hosts that run, hosts in all, and this process's heap in KB."""
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()
        used, total = (runtime.totalMemory() - runtime.freeMemory()) // 1024, runtime.totalMemory() // 1024
        return self.hosts().agg(now.alias("date"), F.count_if("running").alias("workers"), F.count("*").alias("domains")).select("*", F.lit(used).cast("long").alias("memory_alloc"), F.lit(total).cast("long").alias("memory_sys"))

    def stop(self) -> None:
        """Let ``run`` end after the turn it is in; its state is stored."""
        self.stopped = True

    def run(self, fetch: Callable[[DataFrame], DataFrame], clock: Callable[[], Column], turns: int | None = None) -> int:
        """Turn after turn until no host is in line, ``turns`` are done or ``stop`` is called. ``fetch`` makes the requests
        (a table with ``request_url``) and gives ``RESPONSES``. Returns the number of turns.
        """
        n = 0
        while not self.stopped and (turns is None or n < turns):
            wanted = write_temporary(self.start_turn(clock()), "requests")
            if not wanted.take(1):
                self.finish_turn(self.spark.createDataFrame([], RESPONSES), clock())
                break
            self.finish_turn(fetch(wanted), clock())
            n += 1
        return n
