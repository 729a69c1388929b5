"""URL filters over time: dated list entries as validity intervals, and an as-of join of captures to them.

A list's history is rows ``(kind, key, day, action)``: from ``day`` on the key is listed (``add``) or is not
(``remove``).  Kinds are ``host`` (that host alone), ``domain`` (it and all hosts below it) and ``prefix`` (a host and
the first parts of the path, as many as the entry has: ``host/a`` or ``host/a/b``).  Each run of days between two entries of a key becomes an interval, and a capture is
blocked by the intervals of its own keys that hold the day of its fetch.  Only Column expressions are used.

On one day the removal of a key wins over its addition.  Rows with a null kind, key, day or action are left out of a
list.  A capture whose URL is null or has no host, or whose day is null, is never blocked.  Repeated captures are
reported once each; repeated list entries count once.  Of several intervals that hold, the result names the most
specific: the longest prefix, then host, then the longest domain.

A top-level domain, or a host with a third of all captures, is never gathered in one task: keys are counted by day before
they meet the list, and what the list says goes back to the keys and to the captures by ``spread_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_join, sum_and_most, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"
WHOLE_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host, or '' where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def part_of(url: Column) -> Column:
    """The first part of the path, or ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def path_of(url: Column) -> Column:
    """The path without its first slash, or ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), WHOLE_PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """``kind, key, valid_from, valid_to`` (to is null while the entry stands).  Entries are first brought to one for each
    key and day, so that the ordered step sees no more rows of a key than there are days."""
    daily = entries.where("kind is not null and key is not null and day is not null and action in ('add', 'remove')")
    daily = daily.groupBy("kind", "key", "day").agg(F.max("action").alias("action"))  # 'remove' is the larger
    order = Window.partitionBy("kind", "key").orderBy("day")
    return daily.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'").select("kind", "key", F.col("day").alias("valid_from"), "valid_to")


def _keys(host: Column, path: Column) -> Column:
    """All keys that could list a capture: ``(rank, kind, key)``, where a lower rank is more specific."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    key = lambda rank, kind, key: F.struct(rank.cast("int").alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: key(k + 1, "domain", F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: key(-k, "prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))))
    return F.concat(prefixes, F.array(key(F.lit(1), "host", host)), domains)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, host, day, blocked, kind, key, valid_from`` for each row of ``captures(page_id, url, day)``.

    Only distinct (host, path, day) triples are taken apart, the path cut to as many parts as the list's prefixes have,
    and only distinct (kind, key, day) triples meet the list.
    """
    valid = written(intervals(entries), "intervals")
    deepest = valid.where("kind = 'prefix'").agg(F.max(F.size(F.split("key", "/")))).first()[0] or 2
    path = F.array_join(F.slice(F.split(path_of(F.col("url")), "/"), 1, deepest - 1), "/")
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), path.alias("path"), "day")
    has = (F.col("host") != "") & F.col("day").isNotNull()
    own = rows.where(has).groupBy(F.struct("host", "path", "day").alias("visit")).agg(F.count("*").alias("n"))
    own = written(own, "visits")
    asked = own.select("visit", F.explode(_keys(F.col("visit.host"), F.col("visit.path"))).alias("k"))
    asked = asked.select("visit", F.struct("k.kind", "k.key", "visit.day").alias("ask"), "k.rank")
    wanted = asked.groupBy("ask").agg(F.count("*").alias("n"))
    since = (F.col("ask.day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ask.day") < F.col("valid_to")))
    met = wanted.join(valid, (F.col("ask.kind") == F.col("kind")) & (F.col("ask.key") == F.col("key")) & since)
    met = written(met.select("ask", "n", "valid_from"), "met")
    # the intervals of a key hold no day twice
    hits = spread_join(asked, met, "ask", *sum_and_most(met, "n"))
    best = hits.groupBy("visit").agg(F.min(F.struct("rank", "ask.kind", "ask.key", "valid_from")).alias("k"))
    visits = written(own.join(best.hint("merge"), "visit", "left").select("visit", "n", "k"), "judged")
    judged = spread_join(rows.where(has).select("page_id", F.struct("host", "path", "day").alias("visit")), visits, "visit", *sum_and_most(visits, "n"))
    judged = judged.select("page_id", "visit.host", "visit.day", "k")
    rest = rows.where(~has).select("page_id", "host", "day", F.lit(None).cast(judged.schema["k"].dataType).alias("k"))
    return judged.unionAll(rest).select("page_id", "host", "day", F.col("k").isNotNull().alias("blocked"), "k.kind", "k.key", "k.valid_from")


def fetch_day(page_id: Column) -> Column:
    """The tables have no fetch time: a page counts as fetched so many days into 2024 as its id has left over 360."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id, F.lit(360)).cast("int"))


def _draw(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("long")


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts that ``pages(url)`` name, as the tables have none: about a fifth of the keys of each
    kind, listed on a day that the key's MD5 draws, every second one for 60 days only and every fourth one again
    120 days after the first."""
    seen = pages.select(host_of(F.col("url")).alias("host"), part_of(F.col("url")).alias("part")).where("host <> ''").distinct()
    keys = seen.select(F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")),
        F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), "part").alias("key")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_replace("host", r"^[^.]*\.", "").alias("key")),
    )).alias("k")).select("k.*").distinct()
    drawn = keys.withColumn("n", _draw(F.concat("kind", F.lit(":"), "key"))).where("n % 5 = 0")
    day = lambda more: F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.col("n") / 5) % 200 + more).cast("int"))
    step = F.floor(F.col("n") / 1000) % 4
    events = F.array(
        F.struct(day(0).alias("day"), F.lit("add").alias("action")),
        F.when(step >= 2, F.struct(day(60).alias("day"), F.lit("remove").alias("action"))),
        F.when(step == 3, F.struct(day(120).alias("day"), F.lit("add").alias("action"))),
    )
    return drawn.select("kind", "key", F.explode(F.array_compact(events)).alias("e")).select("kind", "key", "e.*")


ORACLE = rf"""
    WITH pg AS (SELECT page_id, rtrim(lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)), '.') AS host,
                       regexp_extract(coalesce(url, ''), '{PATH}', 1) AS part,
                       cast(DATE '2024-01-01' + cast(((page_id % 360) + 360) % 360 AS INTEGER) AS DATE) AS day FROM pages),
    keys AS (SELECT 'host' AS kind, host AS key FROM pg WHERE host <> '' UNION SELECT 'prefix', host || '/' || part FROM pg WHERE host <> ''
             UNION SELECT 'domain', regexp_replace(host, '^[^.]*\.', '') FROM pg WHERE host <> ''),
    drawn AS (SELECT *, cast('0x' || substr(md5(kind || ':' || key), 1, 6) AS BIGINT) AS n FROM keys),
    listed AS (SELECT kind, key, cast((n // 5) % 200 AS INTEGER) AS d, (n // 1000) % 4 AS step FROM drawn WHERE n % 5 = 0),
    events AS (SELECT kind, key, cast(DATE '2024-01-01' + d AS DATE) AS day, 'add' AS action FROM listed
               UNION ALL SELECT kind, key, cast(DATE '2024-01-01' + (d + 60) AS DATE), 'remove' FROM listed WHERE step >= 2
               UNION ALL SELECT kind, key, cast(DATE '2024-01-01' + (d + 120) AS DATE), 'add' FROM listed WHERE step = 3),
    spans AS (SELECT kind, key, action, day AS valid_from, lead(day) OVER (PARTITION BY kind, key ORDER BY day) AS valid_to FROM events),
    met AS (SELECT p.page_id, s.kind, s.key, s.valid_from,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY CASE s.kind WHEN 'prefix' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, length(s.key) DESC) AS place
            FROM pg p JOIN spans s ON s.action = 'add' AND p.day >= s.valid_from AND (s.valid_to IS NULL OR p.day < s.valid_to)
             AND ((s.kind = 'prefix' AND s.key = p.host || '/' || p.part) OR (s.kind = 'host' AND s.key = p.host)
                  OR (s.kind = 'domain' AND (s.key = p.host OR ends_with(p.host, '.' || s.key)))))
    SELECT p.page_id, p.host, cast(p.day AS VARCHAR) AS day, m.page_id IS NOT NULL AS blocked, m.kind, m.key, cast(m.valid_from AS VARCHAR) AS valid_from
    FROM pg p LEFT JOIN met m ON p.page_id = m.page_id AND m.place = 1"""
