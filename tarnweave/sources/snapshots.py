"""The text form of host snapshots: tab-separated items in sections that end with a blank line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of the sections after the subdomains; the retry queue has one section per level.
LEVELS = 7
SECTIONS = ["introduction", "priority", "queue", "low", *["failqueue"] * LEVELS, None]
_STAMP = r"^\d{4}-\d{2}-\d{2}-\d{2}:\d{2}:\d{2}(\.\d{1,9})?$"


def parse_time(text: Column) -> Column:
    """``2006-01-02-15:04:05.999999`` without zone; empty is null."""
    plain = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})-", "$1 ")
    return F.when(text.rlike(_STAMP), F.try_to_timestamp(plain).cast("timestamp_ntz"))


def format_time(ts: Column) -> Column:
    """The reverse; trailing zeros of the fraction go, null is empty."""
    full = F.date_format(ts, "yyyy-MM-dd-HH:mm:ss.SSSSSS")
    return F.coalesce(F.regexp_replace(full, r"\.?0+$|(\.\d*?[1-9])0+$", "$1"), F.lit(""))


def decode_items(lines: DataFrame, line: str = "line") -> DataFrame:
    """Item lines as columns; ``valid`` is false where a line breaks the format."""
    part = F.split(line, "\t")
    get = lambda i: F.get(part, i)
    number = lambda i: F.when(get(i).rlike(r"^[+-]?\d+$"), get(i).try_cast("int"))
    stamp_ok = lambda i: (get(i) == "") | parse_time(get(i)).isNotNull()
    valid = (F.size(part) == 8) & ~get(0).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & get(3).isin("true", "false") & stamp_ok(5) & stamp_ok(6)
    for i in (1, 2, 4, 7):
        valid = valid & number(i).isNotNull()
    cols = {"url": get(0), "depth": number(1), "cycle": number(2), "ignore": get(3) == "true", "fail_count": number(4), "last_download": parse_time(get(5)), "last_started": parse_time(get(6)), "subdomain_index": number(7)}
    return lines.withColumns(cols | {"valid": F.coalesce(valid, F.lit(False))})


def encode_item(url: Column, depth: Column, cycle: Column, ignore: Column, fails: Column, download: Column, started: Column, index: Column) -> Column:
    """An item's line."""
    return F.concat_ws("\t", url, depth.cast("string"), cycle.cast("string"), ignore.cast("string"), fails.cast("string"), format_time(download), format_time(started), index.cast("string"))


def parse_snapshot(text: str) -> dict | None:
    """A snapshot's header, subdomains and item lines with their queues; None if the header is malformed."""
    lines = text.split("\n")
    head = lines[0].split("\t")
    try:
        if len(head) == 6:
            out = {"host": head[0], "scheme": head[1], "fail_streak": int(head[2]), "fail_count": int(head[3]), "last_fail_streak": head[4] or None, "latest_cycle": int(head[5])}
        elif len(head) == 5:  # the older form, without a streak to keep
            int(head[2]), int(head[3])
            out = {"host": head[0], "scheme": head[1], "fail_streak": 0, "fail_count": 0, "last_fail_streak": None, "latest_cycle": int(head[4])}
        else:
            return None
    except ValueError:
        return None
    sections: list[list[str]] = [[]]
    for line in lines[1:]:
        line = line.removesuffix("\r")
        if line:
            sections[-1].append(line)
        else:
            sections.append([])
    sections += [[] for _ in range(len(SECTIONS) + 1 - len(sections))]
    out["subdomains"] = sections[0]
    out["items"] = []
    for k, (queue, section) in enumerate(zip(SECTIONS, sections[1:], strict=False)):
        level = k - 4 if queue == "failqueue" else None
        out["items"] += [{"queue": queue, "level": level, "seq": i, "line": line} for i, line in enumerate(section)]
    return out


def format_snapshot(host: dict) -> str:
    """The reverse of ``parse_snapshot``."""
    stamp = host["last_fail_streak"] or ""
    lines = ["\t".join(map(str, (host["host"], host["scheme"], host["fail_streak"], host["fail_count"], stamp, host["latest_cycle"])))]
    lines += [*host["subdomains"], ""]
    for k, queue in enumerate(SECTIONS):
        level = k - 4 if queue == "failqueue" else None
        own = sorted((x for x in host["items"] if x["queue"] == queue and x["level"] == level), key=lambda x: x["seq"])
        lines += [x["line"] for x in own]
        if queue is not None:
            lines.append("")
    return "\n".join(lines) + "\n"


def _lines(section: Column) -> Column:
    """The lines of a section that has a line feed before each."""
    return F.when(section == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(section, 2, 2**31 - 1), "\n"))


def read_snapshots(files: DataFrame, text: str = "text") -> DataFrame:
    """Snapshots (one row each) as host rows with their item lines; malformed ones are dropped. The rows are ``parse_snapshot``'s."""
    c = F.col
    head = F.substring_index(text, "\n", 1)
    rows = files.where(c(text) != "").select(F.split(head, "\t").alias("_head"), F.substring(c(text), F.length(head) + 1, F.length(text)).alias("_body"))
    # the older form of five parts has no streak to keep
    old, part = F.size("_head") == 5, lambda i: F.get("_head", F.lit(i))
    number = lambda i: F.when(F.btrim(part(i), F.lit(" \r")).rlike(r"^[+-]?\d+$"), F.btrim(part(i), F.lit(" \r")).try_cast("int"))
    numbers = {"fail_streak": number(2), "fail_count": number(3), "latest_cycle": F.when(old, number(4)).otherwise(number(5))}
    rows = rows.where(F.size("_head").isin(5, 6)).select("_head", "_body", *(n.alias(name) for name, n in numbers.items()))
    rows = rows.where(" and ".join(f"{name} is not null" for name in numbers))
    # a blank line, whose own line feed is that before it, ends a section
    body = F.when(F.contains("_body", F.lit("\r")), F.regexp_replace("_body", r"\r(?=\n|\z)", "")).otherwise(c("_body"))
    rows = rows.withColumn("_sections", F.split(body, r"\n(?=\n|\z)"))
    queue = F.array(*(F.lit(q).cast("string") for q in SECTIONS))
    level = F.array(*(F.lit(k - 4 if q == "failqueue" else None).cast("int") for k, q in enumerate(SECTIONS)))

    def items(section: Column, k: Column) -> Column:
        return F.transform(_lines(section), lambda line, i: F.struct(F.get(queue, k).alias("queue"), F.get(level, k).alias("level"), i.alias("seq"), line.alias("line")))

    return rows.select(
        part(0).alias("host"),
        part(1).alias("scheme"),
        F.when(old, 0).otherwise(c("fail_streak")).alias("fail_streak"),
        F.when(old, 0).otherwise(c("fail_count")).alias("fail_count"),
        F.when(~old & (part(4) != ""), part(4)).alias("last_fail_streak"),
        "latest_cycle",
        _lines(F.get("_sections", F.lit(0))).alias("subdomains"),
        F.flatten(F.transform(F.slice("_sections", 2, len(SECTIONS)), items)).alias("items"),
    )


def snapshot_items(hosts: DataFrame) -> DataFrame:
    """Valid items of snapshot rows; the subdomain index must name one of the host's subdomains."""
    rows = hosts.select("host", "subdomains", F.explode("items").alias("i")).select("host", "subdomains", "i.queue", "i.level", "i.seq", F.col("i.line").alias("line"))
    items = decode_items(rows).where("valid").where((F.col("subdomain_index") >= 0) & (F.col("subdomain_index") < F.size("subdomains")))
    return items.withColumn("subdomain", F.get("subdomains", F.col("subdomain_index"))).drop("subdomains", "line", "valid")


def snapshot_texts(hosts: DataFrame) -> DataFrame:
    """Host rows (as ``read_snapshots`` gives them) as snapshot texts, those of ``format_snapshot``: (host, text).

    All lines of a host are sorted once, by section and place; a blank line, which comes last, ends a section.
    """
    c = F.col
    first = SECTIONS.index("failqueue")

    def line(x: Column, i: Column) -> Column:
        k = F.when(x["queue"].isNull() & x["level"].isNull(), SECTIONS.index(None))
        k = k.when((x["queue"] == "failqueue") & x["level"].between(0, LEVELS - 1), x["level"] + first)
        for queue in SECTIONS[:first]:
            k = k.when((x["queue"] == queue) & x["level"].isNull(), SECTIONS.index(queue))
        return F.struct(k.cast("int").alias("k"), F.lit(False).alias("end"), x["seq"].cast("long").alias("seq"), i.alias("i"), x["line"].alias("line"))

    ends = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(True).alias("end"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("i"), F.lit("").alias("line")) for k, queue in enumerate(SECTIONS) if queue is not None))
    known = F.filter(F.transform("items", line), lambda x: x["k"].isNotNull())
    lines = F.transform(F.sort_array(F.concat(known, ends)), lambda x: x["line"])
    head = F.concat_ws("\t", *(F.coalesce(c(x).cast("string"), F.lit("")) for x in ("host", "scheme", "fail_streak", "fail_count", "last_fail_streak", "latest_cycle")))
    return hosts.select("host", F.concat(F.array_join(F.concat(F.array(head), "subdomains", F.array(F.lit("")), lines), "\n"), F.lit("\n")).alias("text"))


def host_rows(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows as rows of the hosts table: on disk, idle, in the order of their names."""
    no = F.lit(False)
    return snapshots.select("host", "scheme", "fail_streak", "fail_count", parse_time(F.col("last_fail_streak")).cast("timestamp").alias("last_fail_streak"), "latest_cycle", F.lit(0).cast("long").alias("seq"), no.alias("sleeping"), no.alias("running"), no.alias("in_memory"), no.alias("woken"), no.alias("recrawl_later"), F.lit(0).alias("turn"))


def to_snapshots(frontier: DataFrame, hosts: DataFrame) -> DataFrame:
    """Hosts and their items as snapshot rows, as ``snapshot_texts`` and ``read_snapshots`` have them.

    Subdomains are numbered by name; a host's items go to one row, as they go to one file.
    """
    c = F.col
    subs = frontier.groupBy("host").agg(F.sort_array(F.collect_set("subdomain")).alias("_subs"))
    level = F.when(c("queue") == "failqueue", c("fail_count"))
    line = encode_item(c("url"), c("depth"), c("cycle"), c("ignore"), c("fail_count"), c("last_download"), c("last_started"), F.array_position("_subs", c("subdomain")) - 1)
    item = F.struct(c("queue").alias("queue"), level.cast("int").alias("level"), c("seq"), line.alias("line"))
    items = frontier.join(subs, "host").groupBy("host").agg(F.first("_subs").alias("_subs"), F.sort_array(F.collect_list(item)).alias("_items"))
    rows = hosts.join(items, "host", "left")
    own = F.transform(F.coalesce("_items", F.array().cast("array<struct<queue:string,level:int,seq:bigint,line:string>>")), lambda x, i: F.struct(x["queue"].alias("queue"), x["level"].alias("level"), i.alias("seq"), x["line"].alias("line")))
    names = F.transform(F.coalesce("_subs", F.array().cast("array<string>")), lambda x: F.concat(c("scheme"), F.lit("://"), x))
    stamp = F.when(c("last_fail_streak").isNotNull(), format_time(c("last_fail_streak")))
    return rows.select("host", "scheme", "fail_streak", "fail_count", stamp.alias("last_fail_streak"), "latest_cycle", names.alias("subdomains"), own.alias("items"))


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """One file ``host_<host>.txt`` per host, written by the tasks through the file system of ``path``."""
    texts = snapshot_texts(snapshots)
    spark = snapshots.sparkSession
    # the text writer names files itself: one folder per host, then each file gets its name
    texts.select("text", "host").repartition("host").write.mode("overwrite").partitionBy("host").option("lineSep", "\n\n").text(f"{path}/_parts")
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/_parts")
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in fs.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith("host="):
            for file in fs.listStatus(folder.getPath()):
                if file.getPath().getName().startswith("part-"):
                    target = jvm.org.apache.hadoop.fs.Path(f"{path}/host_{name[5:]}.txt")
                    fs.delete(target, False)
                    fs.rename(file.getPath(), target)
    fs.delete(root, True)
