"""The crawl frontier as batch operators over tables.

A frontier row: host (registered domain), subdomain, uri_key, url (relative), depth, cycle, ignore,
fail_count, last_started, last_download, queue (priority, queue, low, failqueue or null) and seq, the
place in its queue. Operators never read the clock: ``now`` is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FAILS = 6
RECRAWL_DEPTH = 3
#: Minutes to wait by number of failures, int(8.3^(n-1)) from the second on.
BACKOFF_MINUTES = {1: 1} | {n: int(8.3 ** (n - 1)) for n in range(2, MAX_FAILS + 1)}
STREAK_FAILS = 40
RECRAWL_HOURS = 12
FORCED_RECRAWLS = 6000
INTRODUCTIONS = 10
PENDING_WAKES = 50
FRONTIER = "host string, subdomain string, uri_key string, url string, depth int, cycle int, ignore boolean, fail_count int, last_started timestamp, last_download timestamp, queue string, seq long"


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def deduplicate(links: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``; the aggregate combines before it shuffles."""
    rest = [c for c in links.columns if c not in keys]
    lead = [*order, *(c for c in rest if c not in order)]
    best = links.groupBy(*keys).agg(F.min(F.struct(*lead)).alias("_row"))
    return best.select(*keys, *(F.col("_row").getField(c).alias(c) for c in rest))


def new_links(links: DataFrame, frontier: DataFrame, keys: list[str]) -> DataFrame:
    """Links whose key the frontier doesn't have."""
    return links.join(frontier.select(*keys), keys, "left_anti")


def min_depth(references: DataFrame, keys: list[str]) -> DataFrame:
    """Depth of every target: 0 if anything external refers to it, else one more than its nearest source."""
    depth = F.when(F.col("internal"), F.col("source_depth") + 1).otherwise(0)
    return references.groupBy(*keys).agg(F.min(depth).alias("depth"))


def link_levels(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Breadth-first depth of every node reached from ``seeds`` (node) over ``edges`` (source, target).

    Each round joins only the last level and writes it, so lineage stays short; it ends when a level is
    empty, or where the caller wants no more than ``most`` levels.
    """
    from ..sources.tables import write_temporary

    seen = write_temporary(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "levels")
    level = seen
    depth = 0
    while most is None or depth < most:
        depth += 1
        found = level.join(edges, level["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        level = write_temporary(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "levels")
        if not level.take(1):
            break
        seen = seen.unionByName(level)
    return seen


def cycle_depth(references: DataFrame, keys: list[str]) -> DataFrame:
    """Depth and cycle of every target: the newest cycle decides, within it the nearest source."""
    best = references.groupBy(*keys).agg(F.max(F.struct(F.col("source_cycle").alias("cycle"), (-(F.col("source_depth") + 1)).alias("near"))).alias("_b"))
    return best.select(*keys, (-F.col("_b.near")).alias("depth"), F.col("_b.cycle").alias("cycle"))


def backoff_minutes(fails: Column) -> Column:
    out = F.lit(0)
    for n, minutes in BACKOFF_MINUTES.items():
        out = F.when(fails == n, F.lit(minutes)).otherwise(out)
    return F.when(fails > MAX_FAILS, F.pow(F.lit(8.3), fails - 1).cast("long")).otherwise(out)


def retry_due(last_started: Column, fails: Column, now: Column) -> Column:
    """Whether a failed request may be tried again; a request that never started may not."""
    return F.coalesce(_seconds(now, last_started) > 60 * backoff_minutes(fails), F.lit(False))


def unavailable(fails: Column, ignore: Column) -> Column:
    return (fails > MAX_FAILS) | ignore


def route(depth: Column, queue: Column, is_new: Column, internal: Column, older_cycle: Column, due: Column) -> Column:
    """The queue of an item after a reference to it."""
    near = depth < RECRAWL_DEPTH
    waits = queue.isin("queue", "low")
    fresh = queue.isNull() & (is_new | (internal & older_cycle))
    failed = (queue == "failqueue") & due
    return (
        F.when(near & waits, "priority")
        .when(fresh & near, "priority")
        .when(fresh & is_new, "queue")
        .when(fresh, "low")
        .when(failed & near, "priority")
        .when(failed, "low")
        .otherwise(queue)
    )


def upsert(frontier: DataFrame, references: DataFrame, now: Column) -> DataFrame:
    """Apply references (host, subdomain, uri_key, url, internal, source_depth, source_cycle, seq) to a frontier.

    One full outer join on the item key after the references are reduced to one row per item.
    External references set the depth to 0; internal ones of a newer cycle reset depth and cycle,
    others only lower the depth. Unavailable items and failed ones that aren't due stay as they are.
    Items have relative URLs: references with a scheme are refused.
    """
    keys = ["host", "subdomain", "uri_key"]
    references = references.where(F.coalesce(~F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(True)))
    newest = F.struct(F.when(F.col("internal"), F.col("source_cycle")).otherwise(F.lit(-1)).alias("cycle"), F.when(F.col("internal"), -(F.col("source_depth") + 1)).alias("near"))
    refs = references.groupBy(*keys).agg(F.min(F.struct("seq", "url")).alias("first"), F.max(newest).alias("newest"), F.min(F.when(F.col("internal"), F.col("source_depth") + 1)).alias("near"), F.bool_or(~F.col("internal")).alias("outside"), F.bool_or("internal").alias("inside"))
    both = frontier.alias("f").join(refs.alias("r"), keys, "full_outer")
    known, cited = F.col("f.depth").isNotNull(), F.col("r.first").isNotNull()
    cycle0, depth0 = F.coalesce(F.col("f.cycle"), F.lit(0)), F.col("f.depth")
    newer = F.coalesce(F.col("r.inside") & (F.col("r.newest.cycle") > cycle0), F.lit(False))
    inside_depth = F.when(newer, -F.col("r.newest.near")).otherwise(F.least(depth0, F.col("r.near")))
    depth = F.when(~cited, depth0).when(F.col("r.outside"), F.lit(0)).otherwise(F.coalesce(inside_depth, depth0))
    cycle = F.when(newer, F.col("r.newest.cycle")).otherwise(cycle0)
    fails, ignore = F.coalesce(F.col("f.fail_count"), F.lit(0)), F.coalesce(F.col("f.ignore"), F.lit(False))
    due = retry_due(F.col("f.last_started"), fails, now)
    closed = unavailable(fails, ignore) | ((fails > 0) & ~due)
    queue = F.when(cited & ~closed, route(depth, F.col("f.queue"), ~known, F.coalesce(F.col("r.inside"), F.lit(False)), newer, due)).otherwise(F.col("f.queue"))
    moved = cited & ~queue.eqNullSafe(F.col("f.queue"))
    return both.select(*keys, F.coalesce("f.url", "r.first.url").alias("url"), depth.cast("int").alias("depth"), cycle.cast("int").alias("cycle"), ignore.alias("ignore"), fails.alias("fail_count"), "f.last_started", "f.last_download", queue.alias("queue"), F.when(moved, F.col("r.first.seq")).otherwise(F.col("f.seq")).alias("seq"))


def retry_heads(frontier: DataFrame, now: Column) -> DataFrame:
    """Due heads of the retry levels: only the head of each level counts, even if later items are due."""
    w = Window.partitionBy("host", "fail_count").orderBy("seq")
    heads = frontier.where(F.col("queue") == "failqueue").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return heads.where(retry_due(F.col("last_started"), F.col("fail_count"), now))


def next_requests(frontier: DataFrame, now: Column, budget: int = 1) -> DataFrame:
    """The next ``budget`` requests of every host: due retries of one failure, then the priority, the
    ordinary and the low queue, then other due retries."""
    retries = retry_heads(frontier, now).withColumn("_class", F.when(F.col("fail_count") < 2, 0).otherwise(4))
    waiting = frontier.where(F.col("queue").isin("priority", "queue", "low")).withColumn("_class", F.when(F.col("queue") == "priority", 1).when(F.col("queue") == "queue", 2).otherwise(3))
    w = Window.partitionBy("host").orderBy("_class", "fail_count", "seq")
    return retries.unionByName(waiting).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= budget).drop("_class")


def classify(status: Column, error: Column, is_html: Column, size: Column, most: int = 2_000_000) -> Column:
    """What a response means for its item: finished, ignored, failed, or one of the special failures."""
    of_error = (
        F.when(error.contains("SOCKS5"), "failed_stop_host")
        .when(error.contains("Client.Timeout") | error.contains("timeout awaiting response headers"), "failed_timeout")
        .when(error.contains("redirects"), "ignored")
        .when(error.contains("server gave HTTP response to HTTPS client"), "failed_use_http")
        .when(error.contains("context canceled"), "requeued")
        .otherwise("failed")
    )
    of_status = (
        F.when(status == 429, "failed_new_streak")
        .when(status.between(400, 406), "ignored")
        .when(status.between(400, 499), "failed_late_level")
        .when(~status.between(200, 299), "failed")
        .when((size > most) | ~is_html, "ignored")
        .otherwise("finished")
    )
    return F.when(error.isNotNull() & (error != ""), of_error).otherwise(of_status)


def in_fail_timeout(streak: Column, since: Column, now: Column) -> Column:
    """Whether a host rests: half the square of its streak, in whole hours, after the last one."""
    return F.coalesce(_seconds(now, since) < 3600 * F.floor(streak * streak / 2), F.lit(False))


def wants_up(frontier: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """Per host whether it has work: outside its timeout, with a waiting item or a due head of few failures."""
    waiting = frontier.groupBy("host").agg(F.bool_or(F.coalesce(F.col("queue").isin("priority", "queue", "low"), F.lit(False))).alias("waiting"))
    heads = retry_heads(frontier, now).where("fail_count < 4").select("host").distinct().withColumn("due", F.lit(True))
    joined = hosts.join(waiting, "host", "left").join(heads, "host", "left")
    rests = in_fail_timeout(F.col("fail_streak"), F.col("last_fail_streak"), now)
    return joined.select("host", (~rests & (F.coalesce("waiting", F.lit(False)) | F.coalesce("due", F.lit(False)))).alias("wants_up"))


def introduction_points(items: DataFrame, most: int = INTRODUCTIONS) -> DataFrame:
    """Depth-0 items in order of download: the first ``most`` per host, beyond that roots only.

    The rank limit is pushed below the shuffle, so a task gets at most ``most`` rows of a host from each other
    task; roots need no rank and no shuffle.
    """
    w = Window.partitionBy("host").orderBy("seq")
    start = items.where("depth = 0")
    root = F.coalesce(F.col("url").isin("/", ""), F.lit(False))
    head = start.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where(~root).drop("_n")
    return head.unionByName(start.where(root))


def recrawl_due_seconds(points: DataFrame, now: Column) -> DataFrame:
    """Seconds until each host's recrawl: 12 hours from the download of its first introduction point."""
    first = points.groupBy("host").agg(F.min(F.struct("seq", "last_download")).alias("p"))
    since = F.col("p.last_download")
    return first.select("host", F.coalesce(F.lit(RECRAWL_HOURS * 3600.0) - _seconds(now, since), F.lit(300.0)).alias("due_in"))


def recrawl_order(due: DataFrame) -> DataFrame:
    """Hosts with ``place``, their rank by (due_in, host).

    Ranks are places within ranges of the order plus the sizes of the ranges before, of which there are as many
    as partitions; no task sees all hosts.
    """
    from ..sources.tables import write_temporary

    ranged = write_temporary(due.repartitionByRange("due_in", "host").withColumn("_part", F.spark_partition_id()), "recrawl_order")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("due_in", "host"))
    return ranged.withColumn("_at", within).join(F.broadcast(before), "_part").select(*due.columns, (F.col("_at") + F.col("_before")).cast("int").alias("place"))


def recrawl_now(due: DataFrame, force: bool = False, most: int = FORCED_RECRAWLS) -> DataFrame:
    """Hosts to recrawl: those that are due, or by force the first ``most``."""
    return due.orderBy("due_in", "host").limit(most) if force else due.where("due_in <= 0")


def recrawl_timer(due_in: Column) -> Column:
    """Seconds until the timer should look again."""
    return F.greatest(due_in, F.lit(0.0)) + 5


def admit_hosts(links: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Hosts seen for the first time, as far as the number of hosts allows, in order of ``seq``."""
    room = max(0, most - known.count())
    return links.groupBy("host").agg(F.min("seq").alias("seq")).join(known.select("host"), "host", "left_anti").orderBy("seq", "host").limit(room)


def admission(sleeping: DataFrame, capacity: int, used: int) -> DataFrame:
    """Sleeping hosts to start, first come first served."""
    return sleeping.orderBy("seq", "host").limit(max(0, capacity - used))


def turn_budget(host: Column, turn: Column, least: int = 10, spread: int = 50) -> Column:
    """Requests of a host's turn: ``least`` and a spread that depends on host and turn alone."""
    return (F.lit(least) + F.pmod(F.xxhash64(host, turn), F.lit(spread))).cast("int")


def pending_wakes(pending: DataFrame, most: int = PENDING_WAKES) -> DataFrame:
    """Hosts on disk whose buffered references are many enough to load them."""
    return pending.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > most)


def load_resets(hosts: DataFrame, reset_streak: bool, force_recrawl: bool) -> DataFrame:
    """What happens to hosts on load: streaks may be reset, and recrawls forced unless a streak is on."""
    out = hosts.withColumns({"fail_streak": F.lit(0), "last_fail_streak": F.lit(None).cast("timestamp")}) if reset_streak else hosts
    return out.withColumn("recrawl", F.lit(force_recrawl) & (F.col("fail_streak") < 2))


def same_frontier(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frontiers hold the same rows, nulls and repeats included."""
    return not a.exceptAll(b.select(*a.columns)).take(1) and not b.select(*a.columns).exceptAll(a).take(1)


def split_links(links: DataFrame, url: str = "url", domain: str = "host", onion: bool = False) -> tuple[DataFrame, DataFrame]:
    """(internal, external) links of pages."""
    from ..functions.urls import is_internal

    inside = is_internal(F.col(url), F.col(domain), onion)
    return links.where(inside), links.where(~inside)


def moved_to(host: Column, final_url: Column, onion: bool = False) -> Column:
    """The registered domain of a final URL where it is another than the host, else null."""
    from ..functions import urls

    target = urls.registered_domain(urls.host(final_url), onion)
    return F.when(~target.eqNullSafe(host), F.coalesce(target, F.lit("")))


def moved_pages(pages: DataFrame, requested: str = "host", final_url: str = "final_url", onion: bool = False) -> DataFrame:
    """Pages that redirected to another registered domain, with it as ``target_host``; in onion mode those that left it are dropped."""
    from ..functions.urls import host

    out = pages.withColumn("target_host", moved_to(F.col(requested), F.col(final_url), onion)).where("target_host is not null")
    return out.where(host(F.col(final_url)).endswith(".onion")) if onion else out
