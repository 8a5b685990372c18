"""Prefix trie of conversations, summed by leaf peeling (operator 11).

Turns are numbered over range partitions, not one window a conversation, and a
prefix is named by 128 bits that add up turn by turn (the exclusive or of a hash
of each turn with its depth), so a conversation of very many turns is split over
tasks: a partition's numbers and names are shifted by those of the conversation's
earlier partitions, of which at most one conversation a partition has any.

Every node belongs to its smallest member. Nodes of one owner and one number of
members lie below each other without a fork or an end between them: such a chain
is one segment. Segments hold a counter of children that aren't done. In each
round segments without any are done and send the sums of their subtrees to their
parents, whose counters fall by the messages that came, until the root is done.
A chain's nodes have sums that follow from their bytes down the chain, so rounds
are as many as forks lie above each other, not turns. Each round is a written
table that only holds segments left.

The ids that end at a node are hashed in order by one reader of blocks of at most
``BLOCK`` ids, which holds one block of a node at a time: SHA-256 has no other way.

Cases: a null conversation id belongs to no conversation; null roles and texts are
empty; turns that tie are ordered by a hash of role and text; repeated rows are
turns of their own; ids below zero are dealt as truncating division says; an empty
table has no root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_min, materialise, table

FAMILY, HEAD = 5, 9
BLOCK = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _continued(parts: DataFrame, *sums) -> DataFrame:
    """For partitions that go on with a conversation, what its earlier ones came to: at most one row a partition, as only its first conversation can."""
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv", "pid", *[f(c).over(before).alias(f"before_{c}") for f, c in sums]).where(f"before_{sums[0][1]} is not null")


def numbered(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pid, pos, a, b, bytes) of each turn: its place from 1, two hashes of role and text, bytes of text, and a number that grows along a conversation."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    t = df.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(F.lit(1), *said).alias("a"), F.xxhash64(F.lit(2), *said).alias("b"), F.octet_length(said[1]).alias("bytes")).where("conv is not null")
    order = ["turn", "a", "b", "row"]
    t = t.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv", *order).withColumn("pid", F.spark_partition_id())
    t = materialise(t.withColumn("at", F.row_number().over(Window.partitionBy("pid", "conv").orderBy(*order))).select("conv", "pid", "at", "a", "b", "bytes"))
    before = _continued(t.groupBy("conv", "pid").agg(F.count("*").alias("n")), (F.sum, "n"))
    return t.join(F.broadcast(before), ["conv", "pid"], "left").select("conv", "pid", (F.col("at") + F.coalesce("before_n", F.lit(0))).alias("pos"), "a", "b", "bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the first h turns of each conversation c were replaced by those of c - c % family; h = crc32(c) % head."""
    h = (F.crc32(F.col("conv").cast("string")) % head).cast("int")
    heads = turns.where((F.col("conv") % family == 0) & (F.col("pos") < head)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.max("pos").alias("len"), F.min("pid").alias("pid")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % family)
    convs = convs.join(heads, "base", "left").withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    convs = materialise(convs.select("conv", "pid", "h", "k", (F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"), F.when(F.col("k") > 0, F.slice("head", 1, F.col("k"))).alias("head")))
    first = convs.select("conv", "pid", "len", F.explode("head").alias("t")).select("conv", "pid", "len", F.col("t.pos").alias("depth"), "t.a", "t.b", "t.bytes")
    own = join_min(turns.withColumn("h", h).where("pos > h"), "conv", convs.select("conv", "k", "len"))
    return convs, first.unionByName(own.select("conv", "pid", "len", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "a", "b", "bytes"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, x, y, px, py, bytes, cum, last) of each turn: names of the prefix and of the one before it, bytes of its text and up to it."""
    along = Window.partitionBy("conv", "pid").orderBy("depth")
    t = turns.select("conv", "pid", F.col("depth").cast("int").alias("depth"), "bytes", (F.col("depth") == F.col("len")).alias("last"), F.xxhash64(F.lit(3), "depth", "a", "b").alias("g"), F.xxhash64(F.lit(4), "depth", "a", "b").alias("f"))
    t = materialise(t.select("*", F.bit_xor("g").over(along).alias("x"), F.bit_xor("f").over(along).alias("y"), F.sum("bytes").over(along).alias("cum")))
    before = _continued(t.groupBy("conv", "pid").agg(F.sum("bytes").alias("cum"), F.bit_xor("g").alias("x"), F.bit_xor("f").alias("y")), (F.sum, "cum"), (F.bit_xor, "x"), (F.bit_xor, "y"))
    t = t.join(F.broadcast(before), ["conv", "pid"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    t = t.withColumn("x", F.col("x").bitwiseXOR(zero("before_x"))).withColumn("y", F.col("y").bitwiseXOR(zero("before_y")))
    return t.select("conv", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("g")).alias("px"), F.col("y").bitwiseXOR(F.col("f")).alias("py"), "bytes", (F.col("cum") + zero("before_cum")).alias("cum"), "last")


def digests(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): the ids that end at a node, in order and joined by commas, hashed block by block."""
    node = ["depth", "x", "y"]
    block = pa.schema([("depth", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("low", pa.int64()), ("ids", pa.string())])
    final = pa.schema([("depth", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, key, ids = [], None, []
            for *k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != key or len(ids) == BLOCK:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = k, []
                ids.append(c)
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
            yield table(block, *(map(list, zip(*out, strict=True)) if out else [[]] * 5))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for *k, _, ids in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield table(final, *map(list, zip(*out, strict=True)))
        if key:
            yield table(final, *[[v] for v in (*key, sha.hexdigest())])

    of = ends.select(*node, "conv").repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").mapInArrow(blocks, "depth int, x long, y long, low long, ids string")
    return of.repartition(*node).sortWithinPartitions(*node, "low").mapInArrow(hashed, "depth int, x long, y long, ends_sha256 string")


def peeled(segments: DataFrame) -> DataFrame:
    """(owner, n, kids, leaves, total) of segments (owner, n, po, pn, saved), ``po`` and ``pn`` naming the parent: sums over subtrees, sent up from the leaves."""
    kids = segments.where("po is not null").groupBy(F.col("po").alias("owner"), F.col("pn").alias("n")).agg(F.count("*").alias("kids"))
    left = segments.join(kids, ["owner", "n"], "left").select("owner", "n", "po", "pn", F.coalesce("kids", F.lit(0)).alias("kids"))
    left = left.join(segments.select("owner", "n", F.col("saved").alias("total")), ["owner", "n"])
    left = materialise(left.select("*", F.col("kids").alias("waits"), F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves")))
    rounds = []
    while True:
        rounds.append(left)
        done = left.where("waits = 0 and po is not null")
        came = done.groupBy(F.col("po").alias("owner"), F.col("pn").alias("n")).agg(F.count("*").alias("m"), F.sum("leaves").alias("m_leaves"), F.sum("total").alias("m_total"))
        plus = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
        left = left.where("waits > 0").join(came, ["owner", "n"], "left").select("owner", "n", "po", "pn", "kids", plus("total", "m_total").alias("total"), (F.col("waits") - F.coalesce("m", F.lit(0))).alias("waits"), plus("leaves", "m_leaves").alias("leaves"))
        left = materialise(left)
        if left.isEmpty():
            discard(left)
            return reduce(DataFrame.unionAll, [r.where("waits = 0").select("owner", "n", "kids", "leaves", "total") for r in rounds])


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    convs, turns = rebuilt(numbered(df, id_col, turn_col, role_col, text_col), family, head)
    every = prefixes(turns)
    none = F.lit(None).cast("long")
    nodes = materialise(every.groupBy("depth", "x", "y").agg(F.min("px").alias("px"), F.min("py").alias("py"), F.count("*").alias("n"), F.min("conv").alias("owner"), F.min("bytes").cast("long").alias("bytes"), F.min("cum").alias("cum")))
    top = convs.agg(F.count("*").alias("n"), F.min("conv").alias("owner")).where("n > 0")
    own = [F.col(f"c.{c}") for c in ("depth", "x", "y", "n", "owner", "bytes", "cum")]
    root = top.select(F.lit(0).alias("depth"), none.alias("x"), none.alias("y"), "n", "owner", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("cum"), none.alias("po"), none.alias("pn"))
    of = top.first() or (None, None)
    below = nodes.alias("c").where("depth = 1").select(*own, F.lit(of[1]).cast("long").alias("po"), F.lit(of[0]).cast("long").alias("pn"))
    up = nodes.select((F.col("depth") + 1).alias("d"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("owner").alias("po"), F.col("n").alias("pn"))
    deep = nodes.alias("c").where("depth > 1").join(up, (F.col("c.depth") == F.col("d")) & (F.col("c.px") == F.col("u")) & (F.col("c.py") == F.col("v"))).select(*own, "po", "pn")
    full = materialise(root.unionAll(below).unionAll(deep))
    segments = full.groupBy("owner", "n").agg(F.min(F.struct("depth", "po", "pn")).alias("top"), F.max("depth").alias("bottom"), F.min(F.col("cum") - F.col("bytes")).alias("start"), F.max("cum").alias("end"))
    segments = materialise(segments.select("owner", "n", "top.po", "top.pn", "bottom", "start", ((F.col("n") - 1) * (F.col("end") - F.col("start"))).alias("saved")))
    sums = segments.select("owner", "n", "bottom", "start").join(peeled(segments.select("owner", "n", "po", "pn", "saved")), ["owner", "n"])
    sums = materialise(sums)
    # of a chain of very many nodes either side is dealt anew, so AQE may split it
    got = full.join(sums, ["owner", "n"])
    ends = digests(every.where("last").select("depth", "x", "y", "conv").unionAll(convs.where("len = 0").select(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), "conv")))
    zero = F.lit(0).cast("long")
    got = got.withColumn("x", F.coalesce("x", zero)).withColumn("y", F.coalesce("y", zero)).join(ends, ["depth", "x", "y"], "left")
    return got.select(
        F.col("owner").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("po").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - (F.col("n") - 1) * (F.col("cum") - F.col("bytes") - F.col("start"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
