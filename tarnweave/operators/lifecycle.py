"""What happens to hosts and items over a turn: start, outcomes of requests, references, end, recrawl.

A host row is ``HOSTS``. Hosts that run or have never run are in memory; the others are on disk, and
references to them wait in a table of pending references until they run again. Every step takes tables and
gives tables; ``now`` is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.tables import write_temporary
from . import frontier as fr

HOSTS = "host string, scheme string, fail_streak int, fail_count int, last_fail_streak timestamp, latest_cycle int, seq long, sleeping boolean, running boolean, in_memory boolean, woken boolean, recrawl_later boolean, turn int"
PENDING = "host string, subdomain string, uri_key string, url string, internal boolean, source_depth int, source_cycle int, seq long"
#: A request's outcome: the item's key, its turn's place, status, error, is_html, size, scheme and final_url.
OUTCOMES = "host string, subdomain string, uri_key string, place int, status int, error string, is_html boolean, size long, scheme string, final_url string"
KEYS = ["host", "subdomain", "uri_key"]
LATE_LEVEL = fr.MAX_FAILS - 2
ROOTS = ("/", "")


def external_references(links: DataFrame, onion: bool = False, url: str = "url") -> DataFrame:
    """Absolute URLs (seq, url) as references from outside; what isn't absolute or crawlable is dropped."""
    name = urls.repair_onion_host(urls.host(F.col(url))) if onion else urls.host(F.col(url))
    rows = links.where(urls.crawlable(F.col(url), onion)).select("seq", F.col(url).alias("_u"), name.alias("subdomain"))
    return rows.select(urls.registered_domain(F.col("subdomain"), onion).alias("host"), "subdomain", urls.uri_key(F.col("_u")).alias("uri_key"), urls.relative(F.col("_u")).alias("url"), F.lit(False).alias("internal"), F.lit(0).alias("source_depth"), F.lit(0).alias("source_cycle"), "seq")


def new_hosts(hosts: DataFrame, references: DataFrame, most: int = 0) -> DataFrame:
    """Rows for hosts that are seen for the first time, first come first served up to ``most`` hosts (0: no limit)."""
    seen = fr.new_links(references.groupBy("host").agg(F.min("seq").alias("seq")), hosts, ["host"])
    if most:
        seen = fr.admit_hosts(references, hosts, most)
    no, null = F.lit(False), F.lit(None)
    return seen.select("host", F.lit("http").alias("scheme"), F.lit(0).alias("fail_streak"), F.lit(0).alias("fail_count"), null.cast("timestamp").alias("last_fail_streak"), F.lit(0).alias("latest_cycle"), "seq", no.alias("sleeping"), no.alias("running"), F.lit(True).alias("in_memory"), no.alias("woken"), no.alias("recrawl_later"), F.lit(0).alias("turn"))


def add_references(frontier: DataFrame, hosts: DataFrame, pending: DataFrame, references: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frontier, hosts, pending) after references to known hosts; those to others are dropped.

    References to resting hosts are dropped, those to hosts on disk wait, and enough of them wake the host.
    External references carry the host's cycle.
    """
    rests = fr.in_fail_timeout(F.col("fail_streak"), F.col("last_fail_streak"), now)
    open_ = hosts.where(~rests).select("host", "in_memory", F.col("latest_cycle").alias("_cycle"))
    known = references.join(open_, "host").withColumn("source_cycle", F.when(F.col("internal"), F.col("source_cycle")).otherwise(F.col("_cycle"))).drop("_cycle")
    waiting = pending.unionByName(known.where(~F.col("in_memory")).select(*pending.columns))
    woken = fr.pending_wakes(waiting).select("host", F.lit(True).alias("_many"))
    hosts = hosts.join(woken, "host", "left").withColumn("woken", F.col("woken") | F.coalesce("_many", F.lit(False))).drop("_many")
    return fr.upsert(frontier, known.where("in_memory").drop("in_memory"), now), hosts, waiting


def wake(frontier: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """Hosts with idle ones that want to get up put to sleep, that is, in line for a turn."""
    up = fr.wants_up(frontier, hosts, now)
    rests = fr.in_fail_timeout(F.col("fail_streak"), F.col("last_fail_streak"), now)
    wants = F.coalesce(F.col("wants_up"), F.lit(False)) | (F.col("woken") & ~rests)
    return hosts.join(up, "host", "left").withColumn("sleeping", ~F.col("running") & (F.col("sleeping") | wants)).drop("wants_up")


def start_turns(frontier: DataFrame, hosts: DataFrame, pending: DataFrame, now: Column, capacity: int, used: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Start sleeping hosts, first come first served, as far as clients are free: (frontier, hosts, pending).

    Their pending references are applied, and a recrawl that was put off is made up for.
    """
    go = fr.admission(hosts.where("sleeping"), capacity, used).select("host", F.lit(True).alias("_go"))
    on = F.coalesce(F.col("_go"), F.lit(False))
    hosts = hosts.join(go, "host", "left")
    hosts = hosts.withColumns({"sleeping": F.col("sleeping") & ~on, "running": F.col("running") | on, "in_memory": F.col("in_memory") | on, "woken": F.col("woken") & ~on, "turn": F.col("turn") + on.cast("int")}).drop("_go")
    hosts = write_temporary(hosts, "hosts")  # read several times below
    up = hosts.where("running").select("host")
    frontier, hosts = make_up_recrawls(frontier, hosts, up)
    return fr.upsert(frontier, pending.join(up, "host", "left_semi"), now), hosts, pending.join(up, "host", "left_anti")


def requests(frontier: DataFrame, hosts: DataFrame, now: Column, least: int, spread: int) -> DataFrame:
    """The requests of running hosts, as many as each turn's budget allows, with their absolute URL."""
    up = hosts.where("running").select("host", "scheme", fr.turn_budget(F.col("host"), F.col("turn"), least, spread).alias("budget"))
    rows = fr.next_requests(frontier.join(up.select("host"), "host", "left_semi"), now, least + spread)
    rows = rows.withColumnRenamed("turn", "place").join(up, "host").where(F.col("place") <= F.col("budget"))
    link = urls.request_url(F.concat(F.col("scheme"), F.lit("://"), F.col("subdomain")), F.col("url"))
    return rows.select(*KEYS, "place", "depth", "cycle", link.alias("request_url"))


def judged(outcomes: DataFrame, onion: bool = False) -> DataFrame:
    """Outcomes with ``outcome``; pages that ended on another registered domain are ``moved``."""
    base = fr.classify(F.col("status"), F.col("error"), F.col("is_html"), F.col("size"))
    gone = fr.moved_to(F.col("host"), F.col("final_url"), onion).isNotNull()
    return outcomes.withColumn("outcome", F.when((base == "finished") & gone, "moved").otherwise(base))


def moved_references(outcomes: DataFrame, onion: bool = False) -> DataFrame:
    """Where moved pages went, as references from outside; in onion mode those that left it are dropped."""
    gone = fr.moved_pages(outcomes.where("outcome = 'moved'"), onion=onion)
    return external_references(gone.select(F.col("place").cast("long").alias("seq"), F.col("final_url").alias("url")), onion)


def apply_outcomes(frontier: DataFrame, hosts: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(frontier, hosts) after the judged outcomes of one turn, at most one per item."""
    items = frontier.join(outcomes.select(*KEYS, "place", "outcome"), KEYS, "left")
    o = F.coalesce(F.col("outcome"), F.lit("none"))
    asked, failed = o != "none", o.startswith("failed")
    fails = F.when(o == "finished", 0).when(failed, F.greatest("fail_count", F.when(o == "failed_late_level", LATE_LEVEL).otherwise(0)) + 1).otherwise(F.col("fail_count"))
    ignore = F.col("ignore") | o.isin("ignored", "moved")
    retry = (failed | (o == "requeued")) & ~fr.unavailable(fails, ignore)
    items = items.withColumns({"_o": o, "_f": fails.cast("int"), "_i": ignore, "_r": retry})
    # depth-0 pages that are done are introduction points: the first ten of a host, beyond that roots only
    done0 = (F.col("_o") == "finished") & (F.col("depth") == 0)
    had = frontier.where("queue = 'introduction'").groupBy("host").agg(F.count("*").alias("_had"))
    nth = items.where(done0).select(*KEYS, F.row_number().over(Window.partitionBy("host").orderBy("place")).alias("_nth"))
    items = items.join(had, "host", "left").join(nth, KEYS, "left")
    point = done0 & ((F.coalesce("_had", F.lit(0)) + F.col("_nth") <= fr.INTRODUCTIONS) | F.col("url").isin(*ROOTS))
    queue = F.when(~asked, F.col("queue")).when(point, "introduction").when(F.col("_r"), "failqueue")
    seq = F.when(asked, F.unix_micros(now) * 1000 + F.col("place")).otherwise(F.col("seq"))
    new = {"fail_count": F.col("_f"), "ignore": F.col("_i"), "queue": queue, "seq": seq, "last_started": F.when(F.col("_o") == "finished", F.lit(None).cast("timestamp")).when(asked, now).otherwise(F.col("last_started")), "last_download": F.when(F.col("_o") == "finished", now).otherwise(F.col("last_download"))}
    return items.select(*(new[c].alias(c) if c in new else F.col(c) for c in frontier.columns)), host_streaks(hosts, outcomes, frontier, now)


def host_streaks(hosts: DataFrame, outcomes: DataFrame, frontier: DataFrame, now: Column) -> DataFrame:
    """Hosts after a turn's outcomes, in the order of ``place``: a finished page ends the streak and its count; more
    than ``STREAK_FAILS`` first-time network failures, or a 429, begin a new one, after which the count starts anew.
    The scheme is that of the last page that was read, or http where a server asked for it.
    """
    first_time = F.col("outcome").startswith("failed") & F.col("error").isNotNull() & (F.col("error") != "") & (F.col("_had") == 0)
    rows = outcomes.join(frontier.select(*KEYS, F.col("fail_count").alias("_had")), KEYS).join(hosts.select("host", F.col("fail_count").alias("_count")), "host")
    turn = Window.partitionBy("host").orderBy("place")
    rows = rows.withColumns({"_fail": F.coalesce(first_time, F.lit(False)), "_era": F.sum((F.col("outcome") == "finished").cast("int")).over(turn)})
    n = F.sum(F.col("_fail").cast("int")).over(Window.partitionBy("host", "_era").orderBy("place")) + F.when(F.col("_era") == 0, F.col("_count")).otherwise(0)
    streak = (F.col("outcome") == "failed_new_streak") | (F.col("_fail") & (F.pmod(F.col("_n"), F.lit(fr.STREAK_FAILS + 1)) == 0))
    rows = rows.withColumn("_n", n).withColumn("_streak", streak)
    last = rows.withColumn("_top", F.max("_era").over(Window.partitionBy("host")))
    here = F.col("_era") == F.col("_top")
    scheme = F.max_by(F.when(F.col("outcome") == "failed_use_http", "http").otherwise(F.col("scheme")), F.when(F.col("outcome").isin("finished", "moved", "failed_use_http"), F.col("place")))
    after = F.max(F.when(here & F.col("_streak"), F.col("place")))
    found = last.groupBy("host").agg(F.max("_top").alias("_top"), F.count_if(here & F.col("_streak")).alias("_new"), F.max(F.when(here, F.col("_n"))).alias("_n"), after.alias("_at"), scheme.alias("_scheme"), F.sort_array(F.collect_list(F.when(here & F.col("_fail"), F.col("place")))).alias("_places"))
    out = hosts.join(found, "host", "left")
    turned, reset = F.col("_top").isNotNull(), F.coalesce(F.col("_top") > 0, F.lit(False))
    new = F.coalesce(F.col("_new") > 0, F.lit(False))
    since = F.size(F.filter("_places", lambda p: p > F.col("_at")))
    return out.select(
        *(
            {
                "scheme": F.coalesce("_scheme", "scheme"),
                "fail_streak": (F.when(reset, 0).otherwise(F.col("fail_streak")) + F.coalesce(F.col("_new"), F.lit(0))).cast("int"),
                "fail_count": F.when(new, since).when(turned, F.col("_n")).otherwise(F.col("fail_count")).cast("int"),
                "last_fail_streak": F.when(new, now).when(~reset, F.col("last_fail_streak")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in hosts.columns
        )
    )


def make_up_recrawls(frontier: DataFrame, hosts: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start the recrawls of some hosts that were put off."""
    due = hosts.where("recrawl_later").join(of.select("host"), "host", "left_semi").select("host", F.lit(True).alias("_due"))
    marked = hosts.join(due, "host", "left")
    on = F.coalesce(F.col("_due"), F.lit(False))
    marked = write_temporary(marked.withColumns({"latest_cycle": F.col("latest_cycle") + on.cast("int"), "recrawl_later": F.col("recrawl_later") & ~on, "_due": on}), "hosts")
    hosts = marked.drop("_due")
    cycle = marked.where("_due").select("host", F.col("latest_cycle").alias("_cycle"))
    out = frontier.join(cycle, "host", "left")
    hit = F.col("_cycle").isNotNull() & (F.col("queue") == "introduction")
    return out.withColumns({"queue": F.when(hit, "priority").otherwise(F.col("queue")), "cycle": F.when(hit, F.col("_cycle")).otherwise(F.col("cycle"))}).select(*frontier.columns), hosts


def ask_recrawls(frontier: DataFrame, hosts: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """Hosts with the recrawls that are due (or forced) noted down; they start with the host's next turn, and wake it."""
    points = frontier.where("queue = 'introduction'")
    due = fr.recrawl_now(fr.recrawl_due_seconds(points, now), force).select("host", F.lit(True).alias("_due"))
    out = hosts.join(due, "host", "left")
    on = F.coalesce(F.col("_due"), F.lit(False))
    return out.withColumns({"recrawl_later": F.col("recrawl_later") | on, "woken": F.col("woken") | on}).drop("_due")


def end_turns(frontier: DataFrame, hosts: DataFrame, pending: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All running hosts end their turn: what came in meanwhile is applied, they go to disk, and those with work get in line again."""
    ran = hosts.where("running").select("host")
    frontier = fr.upsert(frontier, pending.join(ran, "host", "left_semi"), now)
    pending = pending.join(ran, "host", "left_anti")
    was = F.col("running")
    hosts = hosts.withColumns({"seq": F.when(was, F.unix_micros(now) * 1000).otherwise(F.col("seq")), "in_memory": F.col("in_memory") & ~was, "running": F.lit(False)})
    return frontier, wake(frontier, hosts, now), pending


def rescan(frontier: DataFrame, hosts: DataFrame, now: Column, few: int = 100) -> DataFrame:
    """Put idle hosts in line that want to get up; if few sleep, recrawls are forced first."""
    if hosts.where("sleeping").limit(few).count() < few:
        hosts = ask_recrawls(frontier, hosts, now, force=True)
    return wake(frontier, hosts, now)
