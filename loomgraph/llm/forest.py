"""Embedding near-dedup with a forest of random-projection trees (operator 5).

Equal vectors form a class, of which one goes on. Each tree splits space by
random hyperplanes, one for each level, at or near the median of a bounded sample
of the vectors that reached the node; vectors near the split, measured by the
node's own spread, go to both sides, so that a vector has about 1.13 copies a
level and tree whatever its dimension. The number of levels grows with the number
of vectors, so leaves of spread-out data don't. A node most of whose sampled
pairs are links isn't split: it is a leaf, however large.

Vectors of one leaf are compared by cosine in double precision, block by block.
A pair counts in the first leaf that brings it together: every row of a leaf
carries the leaves its vector reached before, as numbers, so pairs need not be
written down to be told apart, and a leaf gives each vector its number of new
links, and edges that span the links.

The number of trees is what spread-out data need (``enough``), or more where
near pairs of a sample meet less often, as those of a large group of loose copies
do; there is no bound on it. Where the trees' leaves would hold as many pairs as
there are, all vectors are one leaf, and the result is exact.

A leaf with more than ``BLOCK`` rows (near copies of one vector) is cut into
blocks, and each pair of blocks is a task of its own: links of a group of m loose
copies are m * m / 2 pairs, each of which has to be looked at to be counted.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of unlike length never link; a null id links with
nothing and is kept; repeated rows of one id and vector are one vector; other columns are not
looked at. Recall is measured against brute force in the tests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, table

LEAST = 0.9
LEAF = 256
#: Of a node's spread on either side of its split.
SPILL = 0.16
RECALL = 0.999
SAMPLE = 8192
#: Sampled vectors that a node needs for a split of its own, and those whose pairs tell whether it is dense.
FEW, PAIRED, DENSE = 24, 512, 0.3
#: Quantiles where a node may be split, about which width (of its spread) is looked at, and how much emptier than the median they have to be.
PLACES, NEAR, EMPTIER = np.linspace(0.35, 0.65, 7), 0.25, 0.6
TRIED = 2048
#: Near pairs that a tree brings together less often than this take too many trees.
FAINT = 0.02
BLOCK = 1024
SEED = 17


class Forest:
    """``trees`` trees of ``levels`` levels over unit vectors of length ``dim``; split points from ``sample``.

    A node is split at the median of its sampled vectors, or, where they crowd there (a group of loose copies lies across it),
    at the emptiest of the places near it. Vectors within ``spill`` times the node's own spread of the split go to both sides,
    so that copies don't grow with the dimension. A node of which ``DENSE`` of the sampled pairs are at ``least`` is a leaf: splits would
    only part links, and blocks compare it whole."""

    def __init__(self, sample: np.ndarray, dim: int, levels: int, trees: int = 6, spill: float = SPILL, seed: int = SEED, least: float = LEAST):
        rng = np.random.default_rng(seed)
        self.levels = levels
        self.planes = rng.normal(size=(trees, max(levels, 1), dim))
        self.planes /= np.linalg.norm(self.planes, axis=2, keepdims=True)
        #: (known nodes, their cuts, their spills, whether they are leaves) of each level of each tree, and what other nodes use
        self.cuts: list[list[tuple[np.ndarray, ...]]] = []
        self.plain: list[list[tuple[float, float]]] = []
        for t in range(trees):
            left, node, cuts, plain = sample, np.zeros(len(sample), np.int64), [], []
            for level in range(levels):
                x = left @ self.planes[t, level] if len(left) else np.zeros(0)
                order = np.argsort(node, kind="stable")
                bounds = np.flatnonzero(np.diff(node[order], prepend=-1)) if len(order) else np.zeros(0, np.int64)
                known = []
                for i, j in zip(bounds, [*bounds[1:], len(order)], strict=True):
                    if j - i >= FEW:
                        rows = order[i:j]
                        known.append((int(node[rows[0]]), *self.split(x[rows]), self.dense(left[rows[:PAIRED]], least)))
                # nodes with too few sampled vectors use what is usual on the level
                usual = float(np.median([k[2] for k in known])) if known else 1 / math.sqrt(max(dim, 1))
                plain.append((float(np.median(x)) if len(x) else 0.0, spill * usual))
                cuts.append((np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known]), spill * np.array([k[2] for k in known]), np.array([k[3] for k in known], bool)))
                cut, _, leaf = self.at(cuts[-1], plain[-1], node)
                # sampled vectors of a leaf are looked at no more
                left, node = left[~leaf], (2 * node + (x > cut))[~leaf]
            self.cuts.append(cuts)
            self.plain.append(plain)

    @staticmethod
    def split(x: np.ndarray) -> tuple[float, float]:
        """(cut, spread) of the projections of a node's sampled vectors."""
        places = np.quantile(x, PLACES)
        spread = float(x.std())
        crowd = (np.abs(x[:, None] - places) <= NEAR * spread).sum(0)
        middle = len(PLACES) // 2
        best = int(crowd.argmin())
        return float(places[best if crowd[best] < EMPTIER * crowd[middle] else middle]), spread

    @staticmethod
    def dense(v: np.ndarray, least: float) -> bool:
        near = (v @ v.T >= least).sum() - len(v)
        return near >= DENSE * len(v) * (len(v) - 1)

    @staticmethod
    def at(cuts: tuple[np.ndarray, ...], plain: tuple[float, float], node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cut, spill, leaf) of each of ``node``."""
        known, value, spill, leaf = cuts
        if not len(known):
            return np.full(len(node), plain[0]), np.full(len(node), plain[1]), np.zeros(len(node), bool)
        i = np.minimum(np.searchsorted(known, node), len(known) - 1)
        found = known[i] == node
        return np.where(found, value[i], plain[0]), np.where(found, spill[i], plain[1]), found & leaf[i]

    def leaves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, leaves): those each vector falls into, as tree * 2**levels + leaf of the tree, in order.
        A node that is a leaf has the number of its leftmost place on the last level."""
        rows, leaves = [], []
        for t, planes in enumerate(self.planes):
            row, node = np.arange(len(v)), np.zeros(len(v), np.int64)
            for level in range(self.levels):
                x = (v @ planes[level])[row]
                cut, spill, leaf = self.at(self.cuts[t][level], self.plain[t][level], node)
                if leaf.any():
                    rows.append(row[leaf])
                    leaves.append((t << self.levels) + (node[leaf] << (self.levels - level)))
                left, right = ~leaf & (x <= cut + spill), ~leaf & (x > cut - spill)
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            leaves.append((t << self.levels) + node)
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(v)))]), leaf[np.lexsort((leaf, row))]


def enough(levels: int, kept: float = 0.95, recall: float = RECALL) -> int:
    """Trees that bring a pair together with probability ``recall``. ``kept``: the least
    chance that a level keeps a pair at cosine 0.9 together (64 components, SPILL, a split at the median)."""
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(kept**levels, 0.9))))


def _unit(vectors) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square is too large or small
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def meeting(forest: Forest, v: np.ndarray, least: float, pairs: int = 4000) -> float | None:
    """The share of pairs of ``v`` at cosine ``least`` that a tree brings together; None if there are fewer than 50."""
    i, j = np.nonzero(np.triu(v @ v.T >= least, 1))
    if len(i) < 50:
        return None
    at = np.linspace(0, len(i) - 1, min(pairs, len(i))).astype(int)
    ends, leaves = forest.leaves(v)
    of = [set(x.tolist()) for x in np.split(leaves, ends[1:-1])]
    met = [len({x >> forest.levels for x in of[a] & of[b]}) for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True)]
    return float(np.mean(met)) / len(forest.planes)


def grown(sample: np.ndarray, dim: int, levels: int, least: float = LEAST, trees: int | None = None, spill: float = SPILL) -> Forest:
    """A forest of as many trees as spread-out data need, or more where near pairs of the sample meet less often; a single leaf,
    which blocks compare exactly, where its trees would compare as many pairs as there are, or bring too few near pairs together to tell."""
    whole = Forest(sample, dim, 0, 1, spill, least=least)
    if not levels:
        return whole
    forest = Forest(sample, dim, levels, trees or enough(levels), spill, least=least)
    if not trees:
        met = meeting(forest, sample[:TRIED], least)
        if met is not None:
            if met < FAINT:
                return whole
            needed = math.ceil(math.log(1 - RECALL) / math.log(1 - min(met, 0.99)))
            if needed > len(forest.planes):
                forest = Forest(sample, dim, levels, needed, spill, least=least)
        if len(sample) and work(forest, sample) >= 1:
            return whole
    return forest


def work(forest: Forest, v: np.ndarray) -> float:
    """Pairs that the leaves compare, as a share of all pairs; ``v`` tells how full they are."""
    _, leaves = forest.leaves(v)
    share = np.unique(leaves, return_counts=True)[1] / len(v)
    return float((share * share).sum())


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, trees: int | None = None, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    spark = df.sparkSession
    v = F.col(vector_col)
    kind = {"array<float>": "float"}.get(dict(df.dtypes)[vector_col], "double")
    v = v.cast(f"array<{kind}>")  # floats travel as floats and are compared as doubles
    good = v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good & F.col(id_col).isNotNull(), v).alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(kind)).otherwise(x)))  # -0.0 is 0.0
    one = rows.where("v is not null").select("vec_id", "v").distinct()
    keyed = materialise(one.select("vec_id", F.sha2(F.to_json("v"), 256).alias("digest"), "v"))
    classes = materialise(keyed.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    parts = []
    # vectors of each length are a forest of their own
    for r in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        parts.append(_links(classes.where(F.size("v") == r.d), r.d, r["count"], least, trees, leaf, spill))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionAll(p)
        found = materialise(found)
    else:
        found = spark.createDataFrame([], "rep long, links long, other long")
    comp = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    facts = classes.select("digest", "rep", "copies").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    facts = facts.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "digest").join(facts, "digest").select("vec_id", "n_links", "component_id")
    out = out.unionAll(rows.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))


def _links(classes: DataFrame, dim: int, count: int, least: float, trees: int | None, leaf: int, spill: float) -> DataFrame:
    """(rep, links, other): new links of a class in a leaf, or an edge to another class."""
    kind = dict(classes.dtypes)["v"][6:-1]
    levels = max(0, math.ceil(math.log2(max(1, count / leaf))))
    sampled = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect() if levels else []
    forest = grown(_unit([r.v for r in sampled]) if sampled else np.zeros((0, dim)), dim, levels, least, trees, spill)
    levels = forest.levels
    # trees x levels planes, and cuts of at most the sample's size, go with the function: workers need no copy of this package to read them
    small = len(forest.planes) << levels < 1 << 31  # numbers of leaves
    number, number_type = ("int", pa.int32()) if small else ("long", pa.int64())
    placed = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float32() if kind == "float" else pa.float64())), ("leaves", pa.list_(number_type))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                if b.num_rows:
                    v = _unit(b.column(2).flatten().to_numpy().reshape(b.num_rows, dim))
                    ends, leaves = forest.leaves(v)
                    yield table(placed, b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaves, number_type)))

    rows = materialise(classes.select("rep", "copies", "v").mapInArrow(place, f"rep long, copies long, v array<{kind}>, leaves array<{number}>"))
    flat = rows.select("rep", "copies", "v", "leaves", F.posexplode("leaves").alias("at", "leaf"))
    flat = flat.select("rep", "copies", "v", F.expr("slice(leaves, 1, at)").alias("before"), "leaf")
    sizes = rows.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > BLOCK))
    # rows of a large leaf go to each pair of blocks that holds their own; the rest have one task a leaf
    flat = flat.join(F.broadcast(large) if large.count() <= 10_000 else large, "leaf", "left")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    flat = flat.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    flat = flat.select("rep", "copies", "v", "before", "leaf", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def compare(g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        one = lambda c: int(g.column(c)[0].as_py())
        low, high = one("low"), one("high")
        rep, copies, own = (g.column(c).to_numpy() for c in ("rep", "copies", "own"))
        v = _unit(g.column("v").combine_chunks().flatten().to_numpy().reshape(len(rep), dim))
        cos = np.triu(v @ v.T, 1)
        if low != high:
            cos[own[:, None] == own[None, :]] = 0
        i, j = np.nonzero(cos >= least - 1e-9)
        near = np.abs(cos[i, j] - least) < 1e-9
        cos = None
        sure = ~near
        sure[near] = [float(np.dot(v[a], v[b])) >= least for a, b in zip(i[near], j[near], strict=True)]
        i, j = i[sure], j[sure]
        if len(i):  # a pair counts in its first common leaf
            rows = np.unique(np.concatenate([i, j]))
            before = g.column("before").combine_chunks().take(pa.array(rows))
            columns, of = np.unique(before.flatten().to_numpy(), return_inverse=True)
            seen = np.zeros((len(rows), len(columns) + 1), np.float32)
            seen[np.repeat(np.arange(len(rows)), before.value_lengths().to_numpy()), of] = 1
            met = (seen @ seen.T)[np.searchsorted(rows, i), np.searchsorted(rows, j)] > 0
            i, j = i[~met], j[~met]
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        first = np.arange(len(rep))
        while len(i):
            was = first.copy()
            np.minimum.at(first, j, first[i])
            np.minimum.at(first, i, first[j])
            first = first[first]
            if (was == first).all():
                break
        hit, moved = np.nonzero(links)[0], np.nonzero(first != np.arange(len(rep)))[0]
        none = lambda n: pa.nulls(n, pa.int64())
        out = [pa.concat_arrays([pa.array(rep[hit]), pa.array(rep[moved])]), pa.concat_arrays([pa.array(links[hit]), none(len(moved))]), pa.concat_arrays([none(len(hit)), pa.array(rep[first[moved]])])]
        return pa.Table.from_arrays(out, schema=schema)

    return flat.groupBy("leaf", "low", "high").applyInArrow(compare, "rep long, links long, other long")
