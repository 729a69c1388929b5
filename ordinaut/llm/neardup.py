"""Near-duplicate classes: BagMinHash signatures, bands, exact multiset verification, connected components.

Texts are multisets of five-word shingles; two are near duplicates when their weighted Jaccard similarity is 0.8 or
more.  Texts of equal words are one node from the start.  Nodes that share a band key are candidates: in buckets of up to
``SMALL`` all pairs of fitting sizes are verified; in larger ones every member is verified against two centres, and then
each member outside the bucket's main component against the members of other components.  Before that, texts go whose
shingles are in too few others for any link, and pairs that share too few of them or whose shingle profiles are too far
apart: these bounds are exact.  So no bucket emits all its pairs, and no pair of different components goes untested that
could be a link.  Verified pairs are links; a class is a connected component of links.

Buckets, centres, components and classes of any size are spread: what has a key with very many rows in it is never in one
task (``spread_join``), a centre's text goes out once for ``GROUP`` members, and large buckets meet themselves in blocks.

A node is known by a number of its own, and a row by its id and the digest of its text, so that rows may repeat ids: two
texts under one id are two nodes.  A null text counts as empty; texts without a word are one class.  Rows with a null id
are compared like any other; a class of such rows only has a null id.  Texts of fewer than five words are one shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import band_keys, signatures
from .common import slices, spread_join, sum_and_most, texts_of, written
from .components import components
from .tokens import bag, mix, shingles, similarity, tokens

BANDS, PER_BAND = 25, 5
REGISTERS = 128
SIMILAR = 0.8
WIDTH = 5
SMALL = 24
GROUP = 256  # members that meet one copy of a centre's text
SIDE = 1024  # members of a large bucket in a block
PROFILE = 128  # the upper 7 bits of a hash
BLOCK, BLOCK_SHINGLES = 512, 1 << 21  # of one class, held against another block at a time
COLUMNS = 2048


def text_mark(text: Column) -> Column:
    """Digest of the text itself, which with the id tells rows apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, words, size, bands``: digests of the text and of its words in order, its number of shingles, and its
    band keys (null without a word)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=2 << 20):
                hashes, at, _ = tokens(texts_of(part))
                own = [hashes[at[i] : at[i + 1]] for i in range(part.num_rows)]
                digests = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in own]
                counted = [bag(h, WIDTH) for h in own]
                rows = signatures([k for k, _ in counted], [n for _, n in counted], REGISTERS)
                keys = band_keys(rows, BANDS, PER_BAND).view(np.int64)
                bands = [k if len(h) else None for k, h in zip(keys, own, strict=True)]
                sizes = pa.array([int(n.sum()) for _, n in counted], pa.int64())
                columns = [part.column(0), part.column(2), pa.array(digests, pa.binary()), sizes, pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "words", "size", "bands"])

    return docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark")).mapInArrow(run, "doc_id long, mark binary, words binary, size long, bands array<long>")


def unshared(texts: DataFrame) -> DataFrame:
    """``node, alone``: how many of a text's shingles no other of ``texts(node, text)`` has.  A shingle that many have is
    counted before the shuffle; none is listed with its texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                hashes, at, _ = tokens(texts_of(part))
                for i, node in enumerate(part.column(0).to_pylist()):
                    keys, n = bag(hashes[at[i] : at[i + 1]], WIDTH)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), node)), pa.array(n)], ["shingle", "node", "n"])

    rows = texts.select("node", "text").mapInArrow(run, "shingle long, node long, n long")
    once = rows.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("node").alias("node"), F.min("n").alias("n")).where("texts = 1")
    return once.groupBy("node").agg(F.sum("n").alias("alone"))


def profiles(texts: DataFrame) -> DataFrame:
    """``node, profile``: how many of a text's shingles fall into each of ``PROFILE`` classes of hashes.  The profiles of two
    texts differ by no more than the texts do, so their distance bounds the similarity from above."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                hashes, at, _ = tokens(texts_of(part))
                counts = [np.bincount((shingles(hashes[at[i] : at[i + 1]], WIDTH) >> np.uint64(57)).astype(np.int64), minlength=PROFILE) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int64()))], ["node", "profile"])

    return texts.select("node", "text").mapInArrow(run, "node long, profile array<long>")


def _apart(a, b):
    """A number of shingles by which two texts differ at least."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` of those ``pairs(hub, member)``, already written, whose ``texts(node, text)`` are similar enough.  A hub's text
    goes out once for each ``GROUP`` of its members and theirs once for each pair, so a hub may have any number of members."""
    hubs = written(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hubs")
    salts = F.expr(f"n div {GROUP} + 1")
    # neither side has a bound, so neither is sent to every executor, however small it looks
    own = texts.select(F.col("node").alias("hub"), "text").hint("merge").join(hubs.hint("merge"), "hub")
    own = own.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "text")
    dealt = spread_join(pairs.select("hub", "member"), hubs, "hub", *sum_and_most(hubs, "n")).select("hub", F.pmod(F.xxhash64("member"), salts).alias("salt"), "member")
    met = dealt.hint("merge").join(texts.select(F.col("node").alias("member"), "text").hint("merge"), "member").select("hub", "salt", "member", "text")

    def run(batches):
        now, held = None, None
        for batch in batches:
            for part in slices(batch, max_bytes=1 << 20):
                hubs, _, members, texts = (c.to_pylist() for c in part.columns)
                hashes, at, _ = tokens([t or "" for t in texts])
                low, high = [], []
                for i, (hub, member) in enumerate(zip(hubs, members, strict=True)):
                    counted = bag(hashes[at[i] : at[i + 1]], WIDTH)
                    if member is None:
                        now, held = hub, counted
                    elif hub == now and similarity(held, counted) >= SIMILAR:
                        low.append(min(hub, member))
                        high.append(max(hub, member))
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    rows = own.unionAll(met).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def _fits(a, b):
    """Whether two sizes allow a link."""
    return F.least(a, b) >= SIMILAR * F.greatest(a, b) - 1e-9


def _within(members: DataFrame) -> DataFrame:
    """Pairs of buckets of bounded size."""
    listed = members.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "size"))).alias("m"))
    first = listed.select("m", F.posexplode("m").alias("i", "x"))
    both = first.select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    return both.where((F.col("x.node") != F.col("y.node")) & _fits(F.col("x.size"), F.col("y.size"))).select(F.col("x.node").alias("hub"), F.col("y.node").alias("member"))


def _reach(common, size, other):
    """The similarity that a text of ``size`` shingles can have, at most, to one of ``other`` or more when no more than
    ``common`` of its shingles are in both."""
    return common / (size + F.greatest(other, common) - common)


def _once(pairs: DataFrame) -> DataFrame:
    """Each unordered pair of ``pairs(hub, member)`` once; either end may remain its hub."""
    return pairs.groupBy(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).agg(F.max("hub").alias("hub")).select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))


def roots(reps: DataFrame, texts_among) -> DataFrame:
    """``node, root`` of those of ``reps(node, size, bands)`` that have links; ``texts_among(nodes)`` gives ``node, text`` of some."""
    rows = reps.where("bands is not null").select("node", "size", F.explode("bands").alias("key"))
    shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    total, most, n_large = (int(x or 0) for x in shared.agg(F.sum("n"), F.max("n"), F.sum(F.when(F.col("n") > SMALL, F.col("n")))).first())
    members = written(spread_join(rows, shared, "key", total, most).select("node", "size", "key", "n"), "buckets")
    pairs = _within(members.where(F.col("n") <= SMALL))
    large = members.where(F.col("n") > SMALL)
    if n_large:
        pairs = pairs.unionAll(_stars(large, n_large, most))
    pairs = written(_once(pairs), "pairs")
    texts = written(texts_among(members.select("node").distinct()), "texts")
    found = written(verified(pairs, texts), "links")
    root = components(found)
    more = _between(large, pairs, root, texts) if n_large else None
    if more is None or more.isEmpty():
        return root
    return components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))


def _stars(large: DataFrame, n_large: int, most: int) -> DataFrame:
    """Every member of a large bucket with two centres."""
    # the centres: the member that meets most others over all large buckets, which is near the middle, and the smallest number
    met = large.groupBy("node").agg(F.sum("n").alias("met"))
    own = large.join(met.hint("merge"), "node").groupBy("key")
    own = own.agg(F.count("*").alias("n"), F.max(F.struct("met", "node", "size")).alias("c"), F.min(F.struct("node", "size")).alias("low"))
    centres = written(own.select("key", "n", F.array(F.struct("c.node", "c.size"), "low").alias("centres")), "centres")
    star = spread_join(large.drop("n"), centres, "key", n_large, most).select("node", "size", F.explode("centres").alias("c"))
    return star.where((F.col("node") != F.col("c.node")) & _fits(F.col("size"), F.col("c.size"))).select(F.col("c.node").alias("hub"), F.col("node").alias("member"))


def _between(large: DataFrame, pairs: DataFrame, root: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between members of large buckets that are in different components so far, ``root(node, root)``."""
    placed = written(large.select("key", "node", "size").join(root.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    counts = placed.groupBy("key", "root").agg(F.count("*").alias("k"), F.min("size").alias("least"))
    main = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("k").alias("n"), F.max_by("root", F.struct("k", "root")).alias("main"), F.min("least").alias("least"))
    main = written(main.where("parts > 1"), "main")
    n_split, most = sum_and_most(main, "n")
    if not n_split:
        return None
    split = written(spread_join(placed, main, "key", n_split, most).select("key", "node", "size", "root", "main", "least"), "split")
    # a text whose shingles are in too few others has no link; what remains is held against all of the other components
    among = lambda rows: texts.join(rows.select("node").distinct().hint("merge"), "node", "left_semi")
    split = split.join(unshared(among(split)).hint("merge"), "node", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0)))
    split = written(split.where(_reach(F.col("common"), F.col("size"), F.col("least")) >= SIMILAR), "split")
    close = _residue(split.join(profiles(among(split)).hint("merge"), "node"))
    tried = pairs.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"))
    left = close.join(tried.hint("merge"), ["a", "b"], "left_anti")
    left = written(left.select(F.col("a").alias("hub"), F.col("b").alias("member")), "rest")
    return written(verified(left, texts), "links")


def _residue(split: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``split(key, node, root, main, size, common, profile)`` in one bucket, one of them outside its main
    component, of different components, that no bound rules out.  A bucket's odd members and all of its members are dealt to
    blocks of about ``SIDE``, and each block of the ones meets each block of the others under a key of its own."""
    split = written(split.select("key", "node", "root", "main", "size", "common", "profile"), "profiled")
    sides = split.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("main")).alias("odd")).where("odd > 0")
    sides = written(sides.select("key", "n", F.expr(f"odd div {SIDE} + 1").alias("rows"), F.expr(f"n div {SIDE} + 1").alias("columns")), "sides")
    dealt = spread_join(split, sides, "key", *sum_and_most(sides, "n"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ("node", "root", "size", "common", "profile")
    odd = dealt.where("root <> main").withColumn("i", F.pmod(F.xxhash64("node"), "rows")).withColumn("j", each("columns"))
    odd = odd.select("key", "i", "j", *(F.col(c).alias(f"x_{c}") for c in kept))
    rest = dealt.withColumn("j", F.pmod(F.xxhash64("node"), "columns")).withColumn("i", each("rows")).select("key", "i", "j", *kept)
    both, total = F.least("common", "x_common"), F.col("size") + F.col("x_size")
    # a similarity of s needs a difference of at most (1 - s) / (1 + s) of both sizes
    close = (F.col("x_root") != F.col("root")) & (both >= SIMILAR * (total - both)) & (_apart(F.col("profile"), F.col("x_profile")) <= total * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6)
    met = odd.hint("merge").join(rest.hint("merge"), ["key", "i", "j"]).where(close)
    return met.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def _elements(hashes: np.ndarray) -> np.ndarray:
    """The shingles of a text, the repeats of one told apart: sets whose intersection is that of the multisets."""
    own = np.sort(shingles(hashes, WIDTH))
    again = np.arange(len(own)) - np.searchsorted(own, own)
    return np.where(again > 0, mix(own ^ mix(again.astype(np.uint64))), own)


def similar_pairs(texts: list[str]) -> np.ndarray:
    """Which of ``texts``, none without a word, are similar enough to which, themselves left out."""
    hashes, at, _ = tokens(texts)
    own = [_elements(hashes[at[i] : at[i + 1]]) for i in range(len(texts))]
    size = np.array([len(x) for x in own], np.int64)
    _, column, held = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(own)), size), held > 1
    use = shared[column]
    row, column = row[use], (np.cumsum(shared) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(own), len(own)))
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        x = np.zeros((len(own), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        common += x @ x.T
    similar = common / (size[:, None] + size - common) >= SIMILAR
    np.fill_diagonal(similar, False)
    return similar


def linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, n_links`` of ``members(node, size, root, n)`` with their ``texts(node, text)``, where ``n`` rows have the words of
    ``node``: the rows of other members of its class that are similar enough.  All pairs of a class are worked out, in blocks of about ``BLOCK``
    texts or ``BLOCK_SHINGLES``; no pair is a row."""
    # a block that is too large costs memory only, and what is one text can't be cut
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.least(F.count("*"), F.ceil(F.sum("size") / BLOCK_SHINGLES)))
    classes = members.groupBy("root").agg(F.count("*").alias("k"), parts.alias("parts")).where("k > 1").drop("k")
    own = members.join(classes.hint("merge"), "root").withColumn("block", F.expr("pmod(xxhash64(node), parts)"))
    rows = own.hint("merge").join(texts.hint("merge"), "node").select("node", "root", "n", "block", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = rows.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "text")

    def counted(group):
        node, block, n = (np.array([r[k] for r in group], np.int64) for k in (0, 1, 2))
        i, j = int(block.min()), int(block.max())
        similar = similar_pairs([r[3] or "" for r in group])
        if i != j:  # pairs of one block are counted where it meets itself
            similar &= block[:, None] != block
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array((similar * n).sum(1))], ["node", "n_links"])

    def run(batches):
        key, group = None, []
        for batch in batches:
            for *now, block, node, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if _holds_pairs(key, group):
                        yield counted(group)
                    key, group = now, []
                group.append((node, block, n, text))
        if _holds_pairs(key, group):
            yield counted(group)

    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return rows.mapInArrow(run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _holds_pairs(key: list | None, group: list) -> bool:
    """Whether a group of ``linked`` has pairs that are its own: of one block, or of two that both have members."""
    return len(group) > 1 and (key[1] == key[2] or len({block for _, block, *_ in group}) > 1)


class Classes:
    """The classes of ``docs(doc_id, text)``: ``sketches`` (``doc_id, mark, words, ...``, a row for each of theirs) and
    ``nodes`` (``words, node, size, n, root, low``: a row for each different text, which ``n`` rows have, with the node that
    its class is known by and the class's smallest id), both written."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        self.sketches = written(sketch(docs), "sketches")
        own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")  # a null id comes last
        reps = self.sketches.groupBy("words").agg(F.min(own).alias("first"), F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
        self.reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
        self.copies = sum_and_most(self.reps, "n")
        root = roots(self.reps.select("node", "size", "bands"), self.texts)
        found = self.reps.select("words", "node", "first", "size", "n").join(root.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = written(found.withColumn("id", F.col("first.doc_id")).drop("first"), "nodes")
        lows = written(found.groupBy("root").agg(F.count("*").alias("k"), F.min("id").alias("low")), "lows")
        lows = lows.withColumnRenamed("k", "n")
        self.nodes = written(spread_join(found.withColumnRenamed("n", "_n"), lows, "root", *sum_and_most(lows, "n")).drop("n", "id").withColumnRenamed("_n", "n"), "nodes")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """``node, text`` of some nodes, the text being that of the row that comes first."""
        wanted = self.reps.select("node", F.col("first.doc_id").alias("id"), F.col("first.mark").alias("own")).join(nodes.hint("merge"), "node", "left_semi")
        rows = self.docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
        met = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own")))
        return met.select("node", "text").dropDuplicates(["node"])

    def rows(self) -> DataFrame:
        """``doc_id, mark, node, root, class_id`` for each row."""
        nodes = self.nodes.select("words", "n", "node", "root", F.col("low").alias("class_id"))
        return spread_join(self.sketches.select("doc_id", "mark", "words"), nodes, "words", *self.copies).select("doc_id", "mark", "node", "root", "class_id")

    def counted(self) -> DataFrame:
        """``node, n_links``: rows of other words in the class that are similar enough, over all pairs of the class."""
        many = self.nodes.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
        nodes = self.nodes.join(many.hint("merge"), "root", "left_semi")
        return linked(nodes.select("node", "size", "root", "n"), self.texts(nodes.select("node")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` for each row of ``docs(doc_id, text)``: the smallest id of its class.  Where an id has several
    texts, different classes may have the same smallest one."""
    return Classes(docs).rows().select("doc_id", "class_id")


def link_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` for each row of ``docs(doc_id, text)``: the class, and how many rows of other words in it
    are similar enough.  The time follows the square of a class's different texts, which finding classes does not need."""
    classes = Classes(docs)
    rows = classes.rows().join(classes.counted().hint("merge"), "node", "left")
    return rows.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their class: those with the smallest id (a null
    one last), then the smallest digest of the text.  Rows that repeat an id and a text are one, whichever comes first."""
    rows = written(Classes(docs.select("doc_id", "text")).rows(), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    best = rows.groupBy("root").agg(first.alias("f")).select(F.col("f.doc_id").alias("id"), F.col("f.mark").alias("own"))
    same = lambda df: docs["doc_id"].eqNullSafe(df["id"]) & (text_mark(docs["text"]) == df["own"])
    again = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("mark").alias("own"))
    again = written(again, "again")
    # the list of what stays grows with the input, so it is not sent to every executor
    kept = docs.join(best.hint("merge"), same(best), "left_semi")
    if again.isEmpty():
        return kept
    once = kept.join(again.hint("merge"), same(again), "left_anti")
    more = kept.join(again.hint("merge"), same(again), "left_semi").withColumn("_ordinaut_mark", text_mark(docs["text"]))
    return once.unionAll(more.dropDuplicates(["doc_id", "_ordinaut_mark"]).drop("_ordinaut_mark"))
