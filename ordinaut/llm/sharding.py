"""Sharding by extendible hashing.

A document belongs to the prefix of its key's hash bits.  The directory starts with one shard of no bits; only a shard
that is over its byte limit splits on one bit more, until each fits or holds a single key.  Sizes of all prefixes come
from one aggregation by the longest prefix in use, so documents are read for their key and length alone and the
directory is a table, not a driver's structure.  A prefix that is still too large at that depth is counted again with
more bits, and so on to the last bit.

Rows of one key have equal hashes: where they are over the limit together they go on ``page`` after ``page``, each
within the limit unless one row alone is over it.  A null text has no bytes; rows with a null key share the key ''.
Repeated rows are such equal keys.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .packing import ranked

BITS = 60
#: Bytes of text in a shard of the registered query: a part file that a loader fetches in one request.
LIMIT = 256 << 10
LEVELS = 4


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _nodes(leaves: DataFrame, first: int, bits: int) -> DataFrame:
    """``depth, prefix, bytes, low, high`` of each prefix of ``first`` to ``bits`` bits, from written leaves of ``bits`` bits:
    the depths of ``LEVELS`` at a time come from those of the deepest before, so that a leaf is counted about ``LEVELS`` times
    and not once for each depth."""
    out = leaves.select(F.lit(bits).alias("depth"), "prefix", "bytes", "low", "high")
    base = bits
    while base > first:
        top = max(first, base - LEVELS)
        rows = leaves.select(F.explode(F.sequence(F.lit(top), F.lit(base - 1))).alias("depth"), "prefix", "bytes", "low", "high")
        rows = rows.withColumn("prefix", F.expr(f"shiftright(prefix, {base} - depth)"))
        level = written(rows.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")), "levels")
        out = out.unionAll(level)
        leaves, base = level.where(F.col("depth") == top).drop("depth"), top
    return out


def assign(docs: DataFrame, limit: int = LIMIT, step: int = 4) -> DataFrame:
    """``doc_id, bytes, depth, prefix, page`` for each row of ``docs(doc_id, text)``.  The shard is (depth, prefix, page):
    the first ``depth`` bits of the key's hash are ``prefix``."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    rows = rows.withColumn("hash", key_hash(F.col("doc_id")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    first, todo, directory = 0, rows, None
    while True:
        leaves = todo.groupBy(F.shiftright("hash", BITS - bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        nodes = written(_nodes(written(leaves, "leaves"), first, bits).withColumn("done", (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))), "nodes")
        done = nodes.where("done")
        above = done.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        shards = done.withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left_anti").select("depth", "prefix", "bytes")
        directory = shards if directory is None else directory.unionAll(shards)
        large = nodes.where(f"depth = {bits} and not done").select(F.col("prefix").alias("_prefix"))
        if bits == BITS or large.isEmpty():
            break
        todo = todo.join(large, F.shiftright("hash", BITS - bits) == F.col("_prefix"), "left_semi")
        first, bits = bits + 1, min(BITS, bits + step)
    directory = written(directory, "directory")
    # a row meets its shard by the depths that occur, 61 at most
    used = sorted(r.depth for r in directory.select("depth").distinct().collect()) or [0]
    parts = rows.select("doc_id", "bytes", "hash", F.explode(F.array(*(F.lit(d) for d in used))).alias("depth"))
    parts = parts.withColumn("prefix", F.expr(f"shiftright(hash, {BITS} - depth)"))
    placed = parts.join(directory.withColumnRenamed("bytes", "_size"), ["depth", "prefix"])
    over = placed.where(F.col("_size") > limit)
    fits = placed.where(F.col("_size") <= limit).select("doc_id", "bytes", "depth", "prefix", F.lit(0).cast("long").alias("page"))
    if directory.where(F.col("bytes") > limit).isEmpty():
        return fits
    # rows of one key, dealt by numbers of their own
    numbered = written(over.withColumn("_row", F.monotonically_increasing_id()), "overflow")
    widest = numbered.groupBy("hash").agg(F.max("bytes").alias("_most"))
    blocks = max(8, numbered.count() // 20_000)
    paged = ranked(numbered, "hash", ["_row"], blocks).join(widest, "hash")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("_most", F.lit(1))))
    return fits.unionAll(paged.select("doc_id", "bytes", "depth", "prefix", F.floor(F.col("rank") / each).cast("long").alias("page")))


def oracle(limit: int = LIMIT) -> str:
    """For keys of which none is over the limit."""
    return f"""
    WITH rows AS (SELECT doc_id, cast(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
                         cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS hash FROM documents),
    levels AS (SELECT unnest(range(0, {BITS + 1})) AS depth),
    parts AS (SELECT r.*, l.depth, r.hash >> ({BITS} - l.depth) AS prefix FROM rows r CROSS JOIN levels l),
    nodes AS (SELECT depth, prefix, sum(bytes) AS size, min(hash) = max(hash) AS one FROM parts GROUP BY depth, prefix),
    done AS (SELECT p.doc_id, p.bytes, min(p.depth) AS depth FROM parts p JOIN nodes n ON p.depth = n.depth AND p.prefix = n.prefix
             WHERE n.size <= {limit} OR n.one GROUP BY p.doc_id, p.bytes)
    SELECT d.doc_id, d.bytes, cast(d.depth AS INTEGER) AS depth, r.hash >> ({BITS} - d.depth) AS prefix, cast(0 AS BIGINT) AS page
    FROM done d JOIN rows r ON d.doc_id = r.doc_id"""
