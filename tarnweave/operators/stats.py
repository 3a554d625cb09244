"""Operational statistics: minute windows, averages, and the capacity controller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("requests", "timeouts", "workers", "domains", "download_speed", "download_time", "download_size", "memory_alloc", "memory_sys")
GAUGES = ("workers", "domains", "memory_alloc", "memory_sys")
WINDOW = "60 seconds"
CELLS = 4096
ALLOC_MOST, ALLOC_GROW = 7_000_000, 6_200_000


def minute_stats(downloads: DataFrame, ts: str = "ts", size: str = "size", duration: str = "duration", timeout: str = "timeout", host: str = "host") -> DataFrame:
    """Counts, throughput (KB/s) and per-page averages (KB, ms) of 60 second windows.

    ``duration`` is in milliseconds. Works on batch and streaming tables alike. Hosts are counted
    exactly; streams, which take no distinct aggregates, gather the hosts of a window.
    """
    done = ~F.col(timeout)
    n = F.count_if(done)
    total, spent = F.coalesce(F.sum(F.when(done, F.col(size))), F.lit(0)), F.coalesce(F.sum(F.when(done, F.col(duration))), F.lit(0))
    domains = F.size(F.collect_set(host)).cast("long") if downloads.isStreaming else F.count_distinct(host)
    out = downloads.groupBy(F.window(F.col(ts).cast("timestamp"), WINDOW).alias("w")).agg(n.alias("requests"), F.count_if(F.col(timeout)).alias("timeouts"), domains.alias("domains"), total.alias("_size"), spent.alias("_time"))
    per = lambda x: F.when(F.col("requests") > 0, x).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("w.start").alias("date"), "requests", "timeouts", "domains", (F.col("_size") / 60 / 1024).cast("long").alias("download_speed"), per(F.col("_time") / F.col("requests")).alias("download_time"), per(F.col("_size") / F.col("requests") / 1024).alias("download_size"))


def average_stats(stats: DataFrame, group: list[str], order: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Truncating integer means of the measures, dated by the middle row of each group in ``order`` (a number, no two equal).

    The middle row comes from two aggregates, not from a sorted group: rows are counted in ``CELLS`` cells
    of the group's range of ``order``, and only the cell that the middle falls into is ranked.
    """
    means = [F.expr(f"sum(`{m}`) div count(*)").alias(m) for m in measures]
    totals = stats.groupBy(*group).agg(*means, F.count("*").alias("_rows"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    edge = totals.select(*group, "_rows", "_low", ((F.col("_high") - F.col("_low")) / CELLS + 1).alias("_step"))
    celled = stats.select(*group, order, "date").join(edge, group).withColumn("_cell", F.floor((F.col(order) - F.col("_low")) / F.col("_step")))
    sizes = celled.groupBy(*group, "_cell").agg(F.count("*").alias("_n"), F.first("_rows").alias("_rows"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_cell"))
    middle = F.floor(F.col("_rows") / 2)
    cell = sizes.withColumn("_upto", upto).where((F.col("_upto") > middle) & (F.col("_upto") - F.col("_n") <= middle))
    inside = celled.drop("_rows").join(cell.select(*group, "_cell", (middle - F.col("_upto") + F.col("_n") + 1).alias("_place")), [*group, "_cell"])
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("_r") == F.col("_place"))
    return totals.join(ranked.select(*group, "date"), group).select(*group, "date", *measures)


def stats_row(windows: DataFrame, gauges: DataFrame) -> DataFrame:
    """Statistics rows with all nine measures: minute windows with the gauges (date, workers, domains, memory_alloc,
    memory_sys) of their end; a window without gauges has zeros there.
    """
    gauge = gauges.groupBy(F.window(F.col("date").cast("timestamp"), WINDOW).alias("w")).agg(*(F.max_by(g, "date").alias(g) for g in GAUGES))
    rows = windows.drop("domains").join(gauge.select(F.col("w.start").alias("date"), *GAUGES), "date", "left")
    return rows.select("date", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES))


def capacity_action(alloc_kb: Column, timeouts: Column, available: Column, least: int, most: int) -> Column:
    """decrease, increase or keep."""
    return F.when(alloc_kb > ALLOC_MOST, "decrease").when((timeouts > most) & (available >= 0), "decrease").when((timeouts < least) & (available == 0) & (alloc_kb < ALLOC_GROW), "increase").otherwise("keep")


def capacity_step(capacity: Column, action: Column, most: int, proxied: bool = False) -> Column:
    """The capacity after an action; direct clients never shrink below 10, proxied ones never below 1."""
    down = F.greatest(F.lit(1), F.floor(capacity * F.lit(4) / 5)) if proxied else F.when(capacity < 10, capacity).otherwise(F.floor(capacity * F.lit(4) / 5))
    grown = capacity + F.ceil(capacity / 20) if proxied else F.floor(capacity * F.lit(21) / 20)
    up = F.least(grown, F.lit(most))
    return F.when(action == "decrease", down).when(action == "increase", up).otherwise(capacity).cast("long")


def fold_capacity(actions: list[str], capacity: int, most: int, proxied: bool = False) -> list[int]:
    """Capacities after each action of a sequence, on the driver: each step needs the one before."""
    out = []
    for action in actions:
        if action == "decrease":
            capacity = max(1, capacity * 4 // 5) if proxied else capacity if capacity < 10 else capacity * 4 // 5
        elif action == "increase":
            capacity = min(most, capacity - (-capacity // 20) if proxied else capacity * 21 // 20)
        out.append(capacity)
    return out


def assign_clients(requests: DataFrame, order: str, clients: int, used: int = 0) -> DataFrame:
    """Clients for the requests that fit the free capacity, in turn; at most ``clients`` rows reach the rank."""
    free = requests.orderBy(order).limit(max(0, clients - used))
    return free.withColumn("client", F.pmod(F.row_number().over(Window.orderBy(order)) - 1 + used, F.lit(max(1, clients))).cast("int"))
