"""MinHash near-dedup with bottom-k sketches of one hash function (operator 8).

A text's set holds its distinct shingles, as 64-bit hashes. Its sketch is the
``K`` smallest of them. Two texts are linked if the Jaccard similarity of their
whole sets is at least ``NUM``/100.

1. Rows with equal sets form a class; only one row of a class goes on.
2. Inverted lists of retained values propose pairs. Values that no other class
   retains are counted off, and of the rest a class lists only the rarest: as
   many as leave too few values for a similar pair to share (prefix filter; see
   ``prefix``), so that passages which many texts share make no long lists.
3. In a first round every class of a list is compared with the list's pivot
   only, which is linear in the lists. In a second round the classes of lists
   that are not yet in one component propose pairs again, by rare shingles of
   their whole sets and under exact bounds on what they can share, seen from
   the list's pivot (``open_lists``, ``hopeful``). Links inside a component are never looked for again, so
   groups of thousands of copies cost no pairs.
4. A proposed pair is dropped if its union sketch estimates too little overlap,
   else verified on the whole sets.

The prefix and the estimate rest on a pair of similarity 0.8 or more sharing at
least ``SHARED`` of the values of its union sketch, which fails for a pair at
exactly 0.8 with a chance below 1e-5, and for sets of at most K shingles never.

Cases: null and empty texts have empty sets and are linked with nothing; a null
id is linked with nothing and kept; rows that share an id are one document;
equal sets are equal whatever the order of words; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_broadcast, connected_components, id_and_text, join_min, materialise, release, shingles, table, texts

K = 64
SHARED = 34
NUM = 80
SHINGLE = 5
FEW = 8
BROADCAST_ROWS = 200_000


def sets(df: DataFrame, id_col: str, text_col: str, words: int, whole: bool) -> DataFrame:
    """(doc_id, n, digest, sketch) of each row, or with ``whole`` (doc_id, members)."""
    fields = [("members", pa.list_(pa.int64()))] if whole else [("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))]
    schema = pa.schema([("doc_id", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        try:
            for ids, values in texts(batches):
                found = [np.unique(shingles(hashes.of((t or "").encode("utf-8", "surrogatepass").lower().split()), words)) for t in values]
                if whole:
                    yield table(schema, ids, found)
                else:
                    yield table(schema, ids, [len(s) for s in found], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], [s[:K] for s in found])
        finally:
            hashes.clear()
            release()

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, " + ("members array<long>" if whole else "n long, digest binary, sketch array<long>"))


def prefix(n: Column, num: int = NUM) -> Column:
    """How many of its rarest retained values a set of ``n`` must list to meet every similar set in some list."""
    least = F.when(n <= K, F.least(F.ceil(n * num / 100.0), F.lit(int(K - K * (100 - num) / num)))).otherwise(SHARED)
    return (F.least(n, F.lit(K)) - least + 1).cast("int")


def listed(reps: DataFrame) -> DataFrame:
    """(value, rep, n): the inverted lists, without lists of one."""
    flat = reps.select("rep", "n", F.explode("sketch").alias("value"))
    often = flat.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    flat = join_min(flat, "value", often)
    r = flat.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    # values no one else retains are the rarest, so they use up the prefix first
    rare = F.least(F.col("n"), F.lit(K)) - F.size("common")
    room = F.greatest(F.lit(0), prefix(F.col("n")) - rare).cast("int")
    hub = F.aggregate("common", F.lit(0).cast("long"), lambda acc, x: acc + x["df"]).alias("hub")
    return r.select("rep", "n", hub, F.explode(F.slice("common", F.lit(1), room)).alias("c")).select(F.col("c.value").alias("value"), "rep", "n", "hub")


def star(lists: DataFrame) -> DataFrame:
    """(a, b): each class of a list with the list's pivot, the class whose retained
    values are the most common in all. In a group of copies that is the text they
    were made from, or one close to it."""
    pivot = lists.groupBy("value").agg(F.max(F.struct("hub", (-F.col("rep")).alias("rep"))).alias("p")).select("value", (-F.col("p.rep")).alias("pivot"))
    got = join_min(lists, "value", pivot).where("rep <> pivot")
    return got.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` of classes of more than one component, with their components c."""
    comp = connected_components(links)
    got = lists.select("value", "rep", "n", "hub").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("value", "rep", "n", "hub", F.coalesce("component", "rep").alias("c"))
    mixed = got.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("value")
    return materialise(join_min(got, "value", mixed))


def open_lists(df: DataFrame, left: DataFrame, id_col: str, text_col: str, words: int, num: int) -> DataFrame:
    """(value, df, rep, n, inside, outside): the shingles by which the classes in ``left`` may find others, from their whole sets.

    Shingles are ranked by how many of the classes have them, rarest first; those
    that no other has can't be shared. A class lists only its first, as in
    ``prefix``. If a pair's first common shingle is ``value``, it shares none
    before it, so at most the lesser ``inside`` and the lesser ``outside``: a
    class's shingles from ``value`` on that the list's pivot has, and has not."""
    ids = left.select(F.col("rep").alias("_id"))
    some = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(bounded_broadcast(ids, BROADCAST_ROWS), "_id", "left_semi")
    flat = sets(some, "_id", "_text", words, whole=True).select(F.col("doc_id").alias("rep"), F.size("members").cast("long").alias("n"), F.explode("members").alias("value"))
    flat = materialise(flat)
    often = flat.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = F.array_sort(F.collect_list(F.struct("df", "value")))
    r = join_min(flat, "value", often).groupBy("rep", "n").agg(ranked.alias("common"), F.sum("df").alias("hub"))
    r = materialise(r)
    room = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * num / 100.0) + 1 - (F.col("n") - F.size("common"))).cast("int")
    rows = r.select("rep", "n", "hub", F.size("common").cast("long").alias("m"), F.posexplode(F.slice("common", F.lit(1), room)).alias("pos", "x"))
    rows = materialise(rows.select("x.value", "x.df", "rep", "n", "hub", "pos", (F.col("m") - F.col("pos")).alias("rest")))
    pivot = rows.where(F.col("df") > FEW).groupBy("value").agg(F.max(F.struct("hub", (-F.col("rep")).alias("rep"))).alias("p")).select("value", (-F.col("p.rep")).alias("pivot"))
    long = join_min(rows.where(F.col("df") > FEW), "value", pivot)
    asked = long.groupBy("rep", "pivot").agg(F.collect_list("pos").alias("at"))
    sets_ = r.select("rep", F.col("common.value").alias("ranked"))
    asked = asked.join(sets_, "rep").select("rep", "pivot", "at", "ranked")
    asked = join_min(asked, "pivot", sets_.select(F.col("rep").alias("pivot"), F.col("ranked").alias("of_pivot"))).select("rep", "pivot", "at", "ranked", "of_pivot")
    inside = asked.mapInArrow(_inside, "rep long, pivot long, pos int, inside long")
    long = long.join(inside, ["rep", "pivot", "pos"]).select("value", "df", "rep", "n", "inside", (F.col("rest") - F.col("inside")).alias("outside"))
    return materialise(rows.where(F.col("df") <= FEW).select("value", "df", "rep", "n", F.col("rest").alias("inside"), F.lit(0).cast("long").alias("outside")).unionAll(long))


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, pivot, pos, inside): how many of a class's ranked shingles from ``pos`` on its pivot has."""
    schema = pa.schema([("rep", pa.int64()), ("pivot", pa.int64()), ("pos", pa.int32()), ("inside", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rep, pivot, places, counts = [], [], [], []
            for x, p, pos, ranked, of_pivot in zip(*(c.to_pylist() if k < 2 else [v.values.to_numpy() for v in c] for k, c in enumerate(part.columns)), strict=True):
                from_here = np.append(np.cumsum(np.isin(ranked, of_pivot)[::-1])[::-1], 0)
                rep += [x] * len(pos)
                pivot += [p] * len(pos)
                places += pos.tolist()
                counts += from_here[pos].tolist()
            yield table(schema, rep, pivot, places, counts)


def hopeful(rows: DataFrame, num: int) -> DataFrame:
    """``rows`` of lists without those that no row of another component of the list can be similar to, by the best any of them has."""
    best = rows.groupBy("value", "c").agg(F.max("inside").alias("i"), F.max("outside").alias("o"), F.min("n").alias("s"))
    # the component that holds a best value, and the best of all the others
    top = best.groupBy("value").agg(*[F.max_by("c", F.struct(F.col(k) * sign, "c")).alias(f"{k}c") for k, sign in (("i", 1), ("o", 1), ("s", -1))], F.max("i").alias("i1"), F.max("o").alias("o1"), F.min("s").alias("s1"))
    two = join_min(best, "value", top)
    other = lambda k: F.when(F.col("c") != F.col(f"{k}c"), F.col(k))
    two = two.groupBy("value", "ic", "oc", "sc", "i1", "o1", "s1").agg(F.max(other("i")).alias("i2"), F.max(other("o")).alias("o2"), F.min(other("s")).alias("s2"), F.count("*").alias("k")).where("k > 1").drop("k")
    r = join_min(rows, "value", two)
    seen = lambda k: F.when(F.col("c") == F.col(f"{k}c"), F.col(f"{k}2")).otherwise(F.col(f"{k}1"))
    most = F.least(F.col("inside"), seen("i")) + F.least(F.col("outside"), seen("o"))
    return r.where((100 + num) * most >= num * (F.col("n") + seen("s"))).select(*rows.columns)


def open_pairs(lists: DataFrame, links: DataFrame, num: int) -> DataFrame:
    """(a, b) of open_lists that may be similar and lie in unlike components of ``links``."""
    comp = connected_components(links).withColumnRenamed("id", "rep")
    r = lists.join(comp, "rep", "left").select("value", "rep", "n", "inside", "outside", F.coalesce("component", "rep").alias("c"))
    r = materialise(hopeful(materialise(r), num))
    x, y = (r.select("value", *[F.col(k).alias(k + side) for k in ("rep", "n", "inside", "outside", "c")]) for side in "xy")
    most = F.least("insidex", "insidey") + F.least("outsidex", "outsidey")
    close = (F.least("nx", "ny") * 100 >= num * F.greatest("nx", "ny")) & ((100 + num) * most >= num * (F.col("nx") + F.col("ny")))
    return x.join(y, "value").where(close & (F.col("repx") < F.col("repy")) & (F.col("cx") != F.col("cy"))).select(F.col("repx").alias("a"), F.col("repy").alias("b")).distinct()


def estimated(a: Column, b: Column, both: Column, num: int = NUM) -> Column:
    """Whether the sketch of the union leaves a pair possible. With ``both`` the sketches are the whole sets, and the answer is exact."""
    whole, common = F.array_union(a, b), F.array_intersect(a, b)
    union = F.slice(F.array_sort(whole), 1, K)
    shared = F.size(F.array_intersect(union, common))
    return F.when(both, F.size(common) * 100 >= num * F.size(whole)).otherwise(shared * K >= SHARED * F.size(union))


def verified(df: DataFrame, pairs: DataFrame, reps: DataFrame, id_col: str, text_col: str, words: int, num: int) -> DataFrame:
    """(a, b): of the proposed pairs, those that are similar."""
    s = reps.select("rep", "n", "sketch")
    p = pairs.join(s.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    p = materialise(p.where(estimated(F.col("sa"), F.col("sb"), (F.col("na") <= K) & (F.col("nb") <= K), num)).select("a", "b"))
    ids = bounded_broadcast(p.select(F.col("a").alias("_id")).unionAll(p.select(F.col("b").alias("_id"))).distinct(), BROADCAST_ROWS)
    some = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left_semi")
    m = materialise(sets(some, "_id", "_text", words, whole=True).distinct())
    p = p.join(m.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a").join(m.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")
    shared = F.size(F.array_intersect("ma", "mb"))
    return materialise(p.where((shared > 0) & (100 * shared >= num * (F.size("ma") + F.size("mb") - shared))).select("a", "b").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, num: int = NUM) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; ``num`` is 80 or more."""
    rows = materialise(sets(df, id_col, text_col, words, whole=False))
    full = rows.where("n > 0 and doc_id is not null")
    classes = materialise(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    same = full.select("doc_id", "digest").join(classes.select("digest", F.col("n").alias("_n"), "rep"), "digest").where("doc_id <> rep")
    lists = materialise(listed(classes))
    tried = materialise(star(lists))
    links = verified(df, tried, classes, id_col, text_col, words, num)
    left = labelled(lists, links)
    open_ = open_lists(df, left.select("rep").distinct(), id_col, text_col, words, num)
    # first by shingles that few have, which joins most of what belongs together; then by all
    for lists in (open_.where(F.col("df") <= FEW), open_):
        more = materialise(open_pairs(lists, links, num).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionAll(more)
        links = materialise(links.unionAll(verified(df, more, classes, id_col, text_col, words, num)))
    # rows that share an id but not a text are one document
    twice = same.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = links.unionAll(twice.select("low", "high")).unionAll(same.select("doc_id", "rep").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "rep"))
    comp = materialise(connected_components(links))
    of_class = classes.select("digest", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("c"))
    out = rows.join(of_class, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
