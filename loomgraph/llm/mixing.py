"""Mixing sources to target weights (operator 4).

Documents may belong to several sources. They are aggregated by membership
pattern; a min-cost flow routes each pattern's words to its sources' quotas,
where a pattern's first, second, third pass over its documents cost 0, 1, 2
(convex), so repetition is used only where a quota needs it. A pattern's flow is
then spread over its documents: full passes for all, and the remainder to
documents in an order drawn by a seeded hash, the last one in part.

The order is never sorted as a whole: documents fall into 4,096 hash buckets of
their pattern, bucket sums are accumulated, and only a bucket's rows are ordered
together, so a pattern with a third of all rows is spread over all tasks. The
hash is of id and text, so rows without ids are spread as well; equal rows share
a bucket.

Cases: a null text has size 0; a null source is a source of its own, last in
order; ties in the order go by id and size; repeated rows count each by itself
(interchangeable where equal); an empty table gives an empty result; only the
three named columns are looked at.

To the driver go one row for each membership pattern, never rows of documents.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20_240_601
EPOCHS = 3
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def cycled_weights(sources, cycle=(1, 2, 3)) -> dict:
    return {s: float(cycle[i % len(cycle)]) for i, s in enumerate(in_order(sources))}


def targets(sizes: dict, weights: dict, total: float, most: float = EPOCHS) -> dict:
    """Shares of ``total`` by weight; a share above ``most`` times its source's size stops there and the rest is shared again."""
    out: dict = {}
    left, open_ = float(total), in_order(sizes)
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


class Flow:
    """Min-cost flow by successive shortest paths over integer capacities and costs."""

    def __init__(self):
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            dist, by = [math.inf] * len(self.out), [-1] * len(self.out)
            dist[source], queue, queued = 0, deque([source]), {source}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.cap[e] and dist[x] + self.cost[e] < dist[y]:
                        dist[y], by[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            if by[sink] < 0:
                return
            path, x = [], sink
            while x != source:
                path.append(by[x])
                x = self.to[by[x] ^ 1]
            pushed = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= pushed
                self.cap[e ^ 1] += pushed


def route(patterns: dict[tuple, int], quotas: dict, epochs: int = EPOCHS) -> dict[tuple, dict]:
    """Words each pattern gives to each of its sources. Patterns that share no source, directly or through others, are solved apart."""
    group: dict = {}

    def root(s):
        while group.setdefault(s, s) != s:
            s = group[s]
        return s

    for p in patterns:
        for s in p[1:]:
            group[root(s)] = root(p[0])
    parts: dict = {}
    for p in patterns:
        if p:
            parts.setdefault(root(p[0]), []).append(p)
    got: dict[tuple, dict] = {p: {} for p in patterns}
    for members in parts.values():
        flow = Flow()
        start, end = flow.node(), flow.node()
        sink = {}
        for s in in_order({s for p in members for s in p}):
            sink[s] = flow.node()
            flow.arc(sink[s], end, round(quotas.get(s, 0)), 0)
        arcs = []
        for p in members:
            x = flow.node()
            for k in range(epochs):
                flow.arc(start, x, patterns[p], k)
            arcs += [(p, s, flow.arc(x, sink[s], epochs * patterns[p], 0)) for s in in_order(p)]
        flow.run(start, end)
        for p, s, e in arcs:
            got[p][s] = flow.cap[e ^ 1]
    return got


def mix(df: DataFrame, memberships: Column, weights=cycled_weights, id_col: str = "doc_id", text_col: str = "text", share: float = 1.0, seed: int = SEED, epochs: int = EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sources, size, source_size, target, taken[, kept]) of each row.

    ``memberships``: an array of the row's sources. source_size and target are
    those of the first source in it. ``weights``: from the sources to their
    weights. ``keep``: names of columns of ``df`` to carry along, in a struct.
    """
    spark = df.sparkSession
    facts_of = (F.col(id_col).cast("long").alias("_id"), memberships.alias("_sources"), word_count(F.col(text_col)).alias("_size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("_u"))
    narrow = materialise(df.select(*facts_of))  # texts are counted once
    rows = df.select(*facts_of, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept")) if keep else narrow
    totals = {tuple(r["_sources"]): int(r["s"]) for r in narrow.groupBy("_sources").agg(F.sum("_size").alias("s")).collect()}
    sizes: dict = {}
    for p, n in totals.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    aims = targets(sizes, weights(sizes), share * sum(totals.values()), epochs)
    given = {p: sum(x.values()) for p, x in route(totals, aims, epochs).items()}
    facts = [(list(p), sizes[p[0]] if p else 0, aims[p[0]] if p else 0.0, given[p] // n if n else 0, given[p] % n if n else 0) for p, n in totals.items()]
    kind = "_sources array<string>, _source_size long, _target double, _passes long, _rest long"
    facts = spark.createDataFrame(facts, kind)  # one row a pattern
    key = lambda: F.concat_ws("\x01", F.transform("_sources", lambda s: F.coalesce(F.concat(F.lit("+"), s), F.lit("-")))).alias("_p")  # noqa: E731  nulls compare equal here
    bucket = F.shiftrightunsigned("_u", 52).cast("int").alias("_b")
    sums = narrow.select(key(), bucket, "_size").groupBy("_p", "_b").agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_p", "_b", F.coalesce(before, F.lit(0)).alias("_before")).join(facts.select(key(), "_source_size", "_target", "_passes", "_rest"), "_p")
    got = rows.select(key(), bucket, "*").join(sums, ["_p", "_b"])
    w = Window.partitionBy("_p", "_b").orderBy("_u", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = got.withColumn("_end", F.col("_before") + F.sum("_size").over(w))
    rest = F.greatest(F.lit(0), F.least("_size", F.col("_rest") - (F.col("_end") - F.col("_size"))))
    out = [F.col("_id").alias("doc_id"), F.col("_sources").alias("sources"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_passes") * F.col("_size") + rest).cast("long").alias("taken")]
    return got.select(*out, *[F.col("_kept").alias("kept")] * bool(keep))
