"""Runs of repeated words by power-of-two names (operator 13).

Level 0 names words; level k + 1 names 2**(k + 1) words by the pair of names of
its halves, so two stretches of one document are equal if and only if their names
are. A stretch found once gets a name of its own and takes no part in later levels,
and naming stops where no stretch is found twice.

A run of period q and at least four times its length holds a multiple of 3q that
has q words of the run after it, so the grid of these multiples, for each q, has a
place in every run. Of the 3q equal pairs that a run has at least, half lie before
the place or after it, so a name of a level that covers half of them must agree there;
places where none does are left. The others are extended both ways by descending
levels, each used once at most. Of equal stretches the smallest period stays.

Documents of an Arrow batch are named together, up to ``WORDS`` words, their words
kept apart by document. A document is one row and its levels lie in one worker: a
text of n words takes 4 * n * log2(longest repeated stretch) bytes there.

Cases: null and empty texts have no words and no runs; null ids stay; repeated rows
are rows of their own; other columns are not looked at; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release, table, texts, words_of

TIMES, LEAST = 4, 6
WORDS = 1 << 17
PLACES = 1 << 20


def naming(base: np.ndarray) -> list[np.ndarray]:
    """Levels of names of ``base``: level k at i names the 2**k items from i. Names from len(base) on are found once."""
    n = len(base)
    kind = np.int32 if 2 * n < 1 << 31 else np.int64
    own = np.arange(n, 2 * n, dtype=kind)
    levels, at, keys = [], np.arange(n), base
    while True:
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        if not twice.any():
            return levels
        name = own.copy()
        name[at[twice]] = inverse[twice]
        levels.append(name)
        width = 1 << (len(levels) - 1)
        at = np.nonzero(name[: max(n - width, 0)] < n)[0]
        at = at[name[at + width] < n]
        keys = name[at].astype(np.int64) * n + name[at + width]


def ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items from ``i`` and ``j`` on are equal."""
    n, at = len(levels[0]), i.copy()
    for k in range(len(levels) - 1, -1, -1):
        other = at + (j - i)
        ok = other + (1 << k) <= n
        ok[ok] = levels[k][at[ok]] == levels[k][other[ok]]
        at[ok] += 1 << k
    return at - i


def behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items before ``i`` and ``j`` are equal, ``i`` being less."""
    at = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        first = at - (1 << k)
        ok = first >= 0
        ok[ok] = levels[k][first[ok]] == levels[k][(first + (j - i))[ok]]
        at[ok] -= 1 << k
    return i - at


def grid(n: int, low: int, high: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every multiple of step * q under n - q, q from ``low`` to ``high``, in bounded pieces."""
    q = np.arange(low, high + 1)
    many = np.maximum((n - q + step * q - 1) // (step * q), 0)
    ends = np.cumsum(many)
    for start in range(0, int(ends[-1]) if len(ends) else 0, PLACES):
        at = np.arange(start, min(start + PLACES, int(ends[-1])))
        of = np.searchsorted(ends, at, side="right")
        yield (at - (ends[of] - many[of])) * step * q[of], q[of]


def smallest(found: np.ndarray) -> np.ndarray:
    """Of (start, end, period) rows, the least period of each stretch, by start."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[fresh]


def runs_of(base: np.ndarray, longest: int | None = None, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of every maximal run of ``base``, at least ``times`` (3 or more) periods and ``least`` items long, by start.

    ``longest``: no run is longer than this.
    """
    n, step = len(base), times - 1
    levels = naming(base)
    found = np.empty((0, 3), np.int64)
    for k, name in enumerate(levels):
        # periods whose runs have 2**k to 2**(k + 1) - 1 equal pairs on one side of a place
        low, high = -(-(2 << k) // step), -(-(4 << k) // step) - 1
        for i, q in grid(n, max(low, 1), min(high, (longest or n) // times), step):
            ok = i + q + (1 << k) <= n
            ok[ok] = name[i[ok]] == name[(i + q)[ok]]
            back = ~ok & (i >= 1 << k)
            back[back] = name[i[back] - (1 << k)] == name[(i + q)[back] - (1 << k)]
            i, q = i[ok | back], q[ok | back]
            if len(i):
                start, end = i - behind(levels, i, i + q), i + q + ahead(levels, i, i + q)
                long = end - start >= np.maximum(least, times * q)
                found = smallest(np.concatenate([found, np.stack([start, end, q], 1)[long]]))
    return found


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: its runs as (start, length, period) by start, and its words joined by spaces without those that repeat a run's first period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])

    def batch(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        found = np.empty((0, 3), np.int64)
        n = int(ends[-1])
        if n:
            codes = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
            base = np.repeat(np.arange(len(words)), sizes) * len(codes.dictionary) + codes.indices.to_numpy()
            found = runs_of(base, int(sizes.max()), times, least)
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 1], -1)
        kept = np.cumsum(gone)[:-1] == 0
        of = np.searchsorted(ends, found[:, 0], side="right")
        starts = ends - sizes
        columns = [pa.array(c) for c in (found[:, 0] - starts[of], found[:, 1] - found[:, 0], found[:, 2])]
        bounds = np.searchsorted(of, np.arange(len(words) + 1))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run)))
        out = []
        for k, w in enumerate(words):
            if bounds[k] < bounds[k + 1]:
                w = [w[i] for i in np.nonzero(kept[starts[k] : ends[k]])[0].tolist()]
            out.append(b" ".join(w).decode("utf-8", "surrogatepass"))
        return table(schema, ids, sizes, lists, out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0
        for some, strings in texts(batches):
            for i, text in zip(some.to_pylist(), strings, strict=True):
                w = words_of(text)
                if words and held + len(w) > WORDS:
                    yield batch(ids, words)
                    ids, words, held = [], [], 0
                ids.append(i)
                words.append(w)
                held += len(w)
        if words:
            yield batch(ids, words)
        release()

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a stretch repeated in one document of ten, by id: words from a on follow those p before them. Other texts, and those of null ids, stay."""
    d = id_and_text(docs, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    # the number of words is taken apart, so that the words are split once
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.expr("transform(sequence(0L, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))])")
    return d.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(moved, " ")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of ``collapse`` rows."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    d = docs.withColumn("best", best).withColumn("start", -F.col("best.start")).withColumn("length", F.col("best.length")).withColumn("period", -F.col("best.period"))
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
