"""Substring dedup by collinear chaining (operator 1).

Seeds are runs of ``SEED_WORDS`` lower-cased words, thinned to the window minima
of their hashes: two texts that share ``WINDOW + SEED_WORDS - 1`` words in a row
share a seed. Every occurrence of a seed is matched with the seed's first
document only (the smallest id), so a passage in very many documents costs one
match for each occurrence. Where the seed has several documents, each run of
words about it (``RUNS``) is matched with the run's first document as well, so
that pieces of a passage in earlier documents don't hide a document that has it
whole: words that two documents share, 57 or more in a row, hold a run of 50
with them, and so are matched over 50 words or more at a time. Shorter or
altered passages rely on the run of 28 and on single seeds, and may still be
missed if earlier documents have all their pieces of that length. A document's matches with another document are
chained in order of both positions by dynamic programming over a Fenwick tree
of prefix maxima, with a cost that grows with the gap. Chains are aligned on the
words themselves (between matches, however far apart, and outwards from the ends
by up to ``MARGIN`` words) and reported as fuzzy passages if they are long and
alike enough.

The first document of a passage keeps it: it appears as ``ref_id`` only.

Cases: null and empty texts have no seeds; a null id is not compared; rows that
share an id are one document (passages within one document are not reported; the
least of its texts is aligned); texts of any length are chained whole;
ties between chains go by position; an empty table gives no passages; other
columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bounded_broadcast, id_and_text, join_min, materialise, mixed, shingles, table, texts

SEED_WORDS = 5
WINDOW = 16
#: (words before a seed, words in all) of the runs
RUNS = ((0, 28), (0, 50), (8, 50))
GAP_COST = 0.05
MIN_WORDS = 50
MIN_LIKE = 0.8
MARGIN = 64
BROADCAST_ROWS = 200_000


def lowered_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def minima(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the (leftmost) smallest hash of each window of ``window``; of all, if there are fewer."""
    if len(h) <= window:
        return np.array([int(h.argmin())]) if len(h) else np.empty(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(len(h) - window + 1)
    return np.unique(at)


BASE = 0x9E3779B97F4A7C15


def powers(n: int, made: dict[int, tuple[np.ndarray, np.ndarray]] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  kept between calls
    """The first ``n`` powers of BASE and of its inverse, modulo 2**64; made anew only for longer texts than before."""
    if 0 not in made or len(made[0][0]) < n:
        size = 1 << max(12, n.bit_length())
        made[0] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
    up, down = made[0]
    return up[:n], down[:n]


def prefixes(w: np.ndarray) -> np.ndarray:
    """Sums of the first words, each times its power of BASE."""
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers(len(w))[0], out=total[1:])
    return total


def runs(total: np.ndarray, at: np.ndarray, before: int, n: int) -> pa.Array:
    """32-bit hash of the ``n`` words from ``before`` words ahead of each seed; null where the text has none, and where the same
    run began fewer than ``n`` words ago (a short text over and over). ``total``: see ``prefixes``."""
    words = len(total) - 1
    start = at - before
    there = (start >= 0) & (start + n <= words)
    if not there.any():
        return pa.nulls(len(at), pa.int32())
    i = np.where(there, start, 0)
    h = mixed((total[np.minimum(i + n, words)] - total[i]) * powers(words + 1)[1][i])
    order = np.lexsort((i, h))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (i[order[1:]] - i[order[:-1]] < n)
    return pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~there | again)


def points(matches: list[dict[str, int]]) -> list[tuple[int, int]]:
    """Matches as single seeds: of a run, its ends and middle, if no other match lies on its diagonal within it."""
    most: dict[tuple[int, int], int] = {}
    on: dict[int, set[int]] = {}
    for m in matches:
        k = (m["pos"], m["ref_pos"])
        most[k] = max(m["n"], most.get(k, 0))
        on.setdefault(k[0] - k[1], set()).add(k[0])
    line = {d: sorted(x) for d, x in on.items()}
    out = []
    for (x, y), n in most.items():
        out.append((x, y))
        last, of = n - SEED_WORDS, line[x - y]
        if last > 0 and bisect_left(of, x + 1) == bisect_left(of, x + last + 1):
            out += [(x + last // 2, y + last // 2), (x + last, y + last)]
    return out


class Fenwick:
    """Prefix maxima of (value, index) pairs."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def below(self, i: int) -> tuple[float, int]:
        """The largest at positions under ``i``."""
        out = (float("-inf"), -1)
        while i:
            if self.best[i] > out:
                out = self.best[i]
            i &= i - 1
        return out


def chains(matches: list[tuple[int, int]], seed: int = SEED_WORDS, cost: float = GAP_COST) -> list[list[tuple[int, int]]]:
    """Chains of (position, position in the other), each rising in both, best first; every match is in one chain."""
    m = sorted(set(matches), key=lambda x: (x[0], -x[1]))
    ranks = sorted({y for _, y in m})
    tree, score, back = Fenwick(len(ranks)), [], []
    for i, (x, y) in enumerate(m):
        value, j = tree.below(bisect_left(ranks, y))
        gained = value - cost * (x + y)
        score.append(seed + max(0.0, gained))
        back.append(j if gained > 0 else -1)
        tree.put(bisect_left(ranks, y), (score[i] + cost * (x + y), i))
    used, out = [False] * len(m), []
    for i in sorted(range(len(m)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(m[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def extended(a: list[int], b: list[int], i: int, j: int, step: int) -> tuple[int, int]:
    """(words, equal words) to go on from a[i], b[j] in direction ``step``, while equal words outweigh others."""
    score = best = n = length = equal = same = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - 8:
        n += 1
        if a[i] == b[j]:
            score, same = score + 1, same + 1
        else:
            score -= 2
        if score > best:
            best, length, equal = score, n, same
        i, j = i + step, j + step
    return length, equal


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for y in b:
        same = row & places.get(y, 0)
        row = (row + same | row - same) & whole
    return len(a) - row.bit_count()


def parted(a: list[int], b: list[int], chain: list[tuple[int, int]], seed: int = SEED_WORDS, most: int = 8, like: float = 0.6) -> list[list[tuple[int, int]]]:
    """A chain cut at gaps of over ``most`` words that are too unlike, so that one passage doesn't carry another's gap."""
    out = [chain[:1]]
    for (x0, y0), (x, y) in zip(chain, chain[1:]):
        p, q = a[x0 + seed : x], b[y0 + seed : y]
        gap = max(len(p), len(q))
        if gap > most:
            same = sum(map(int.__eq__, p, q)) if len(p) == len(q) else common(p, q)
            if same < like * gap:
                out.append([])
        out[-1].append((x, y))
    return out


def aligned(a: list[int], b: list[int], chain: list[tuple[int, int]], seed: int = SEED_WORDS) -> tuple[int, int, int, int, float]:
    """(start, end, start and end in b, share of equal words) of the alignment through a chain's matches."""
    i0, j0 = chain[0]
    left, equal = extended(a, b, i0 - 1, j0 - 1, -1)
    i, j = i0, j0
    for x, y in chain:
        # up to the next match: what lies between, then what the match adds
        if x > i and y > j:
            p, q = a[i:x], b[j:y]
            equal += sum(map(int.__eq__, p, q)) if len(p) == len(q) else common(p, q)
        elif x < i or y < j:
            over = max(i - x, j - y)
            x, y = x + over, y + over
            if over >= seed:
                continue
            seed_left = seed - over
            equal, i, j = equal + seed_left, x + seed_left, y + seed_left
            continue
        equal, i, j = equal + seed, x + seed, y + seed
    right, more = extended(a, b, i, j, 1)
    start, end, rs, re = i0 - left, i + right, j0 - left, j + right
    return start, end, rs, re, (equal + more) / max(end - start, re - rs)


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_like: float = MIN_LIKE) -> DataFrame:
    """(doc_id, ref_id, start, end, ref_start, ref_end, n_words, likeness): passages of a
    document that an earlier one has; offsets count words, ends are exclusive."""
    rows = id_and_text(df, id_col, text_col).where("doc_id is not null and text is not null")
    flat = pa.schema([("seed", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("once", pa.bool_()), *[(f"run{k}", pa.int32()) for k in range(len(RUNS))]])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, values in texts(batches):
            cols: list[list] = [[] for _ in flat]
            for doc, t in zip(ids.to_pylist(), values, strict=True):
                w = hashes.of(lowered_words(t))
                if len(w) < SEED_WORDS:
                    continue
                h = shingles(w, SEED_WORDS)
                at = minima(h)
                once = np.zeros(len(at), bool)
                once[np.unique(h[at], return_index=True)[1]] = True
                total = prefixes(w)
                for c, x in zip(cols, (h[at], np.full(len(at), doc), at, once, *[runs(total, at, *r) for r in RUNS]), strict=True):
                    c.append(x)
            if cols[0]:
                yield table(flat, *[np.concatenate(c) for c in cols[:4]], *[pa.concat_arrays(c) for c in cols[4:]])

    s = materialise(rows.mapInArrow(seeds, "seed long, doc long, pos int, once boolean, " + ", ".join(f"run{k} int" for k in range(len(RUNS)))))
    first = s.groupBy("seed").agg(F.count("*").alias("n"), F.min("doc").alias("ref"), F.expr("min_by(pos, doc) filter (where once)").alias("ref_pos")).where("n > 1").drop("n")
    # occurrences of seeds that occur again; few, beside all
    often = materialise(join_min(s.drop("once"), "seed", first))
    found = often.where("doc <> ref").select("doc", "ref", "pos", "ref_pos", F.lit(SEED_WORDS).alias("n"))
    for k, (before, n) in enumerate(RUNS):
        run = often.where(F.col(f"run{k}").isNotNull()).select(F.xxhash64("seed", f"run{k}").alias("run"), "doc", (F.col("pos") - before).alias("pos"))
        of = run.groupBy("run").agg(F.count("*").alias("_n"), F.min(F.struct("doc", "pos")).alias("f")).where("_n > 1").select("run", F.col("f.doc").alias("ref"), F.col("f.pos").alias("ref_pos"))
        found = found.unionAll(join_min(run, "run", of).where("doc <> ref").select("doc", "ref", "pos", "ref_pos", F.lit(n).alias("n")))
    found = found.groupBy("doc", "ref").agg(F.collect_list(F.struct("pos", "ref_pos", "n")).alias("m")).where(f"size(m) > 1 or m[0].n > {SEED_WORDS}")
    least = min_words // 4
    chained = pa.schema([("doc", pa.int64()), ("ref", pa.int64()), ("chain", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = chains(points(r["m"]))
                # a run of one word over and over has many seeds at one place of the other text
                for c in [c for c in found if len(c) > 1 and c[-1][0] + SEED_WORDS - c[0][0] >= least] or found[:1]:
                    out.append((r["doc"], r["ref"], [{"x": x, "y": y} for x, y in c]))
            if out:
                yield table(chained, *map(list, zip(*out, strict=True)))

    c = materialise(found.mapInArrow(chain, "doc long, ref long, chain array<struct<x:int,y:int>>"))
    # words of the documents that chains need, each once
    ids = bounded_broadcast(c.select(F.col("doc").alias("doc_id")).unionAll(c.select("ref")).distinct(), BROADCAST_ROWS)
    worded = pa.schema([("doc", pa.int64()), ("w", pa.list_(pa.int64()))])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for doc, values in texts(batches):
            yield table(worded, doc, [hashes.of(lowered_words(t)).view(np.int64) for t in values])

    some = rows.join(ids, "doc_id", "left_semi").mapInArrow(words, "doc long, w array<long>")
    w = materialise(some.groupBy("doc").agg(F.min("w").alias("w")))

    def slice_of(at: str, from_: str, to: str):
        return F.slice(F.col(at), F.greatest(F.lit(0), F.col(from_) - MARGIN) + 1, F.col(to) + 2 * MARGIN - F.greatest(F.lit(0), F.col(from_) - MARGIN))

    c = c.select("doc", "ref", "chain", F.col("chain")[0]["x"].alias("x0"), F.element_at("chain", -1)["x"].alias("x1"), F.col("chain")[0]["y"].alias("y0"), F.element_at("chain", -1)["y"].alias("y1"))
    c = c.join(w.select(F.col("doc").alias("ref"), F.col("w").alias("wr")), "ref").withColumn("b", slice_of("wr", "y0", "y1")).drop("wr")
    c = c.join(w.select("doc", F.col("w").alias("wd")), "doc").withColumn("a", slice_of("wd", "x0", "x1")).drop("wd")
    out = pa.schema([("doc_id", pa.int64()), ("ref_id", pa.int64()), *[(k, pa.int64()) for k in ("start", "end", "ref_start", "ref_end", "n_words")], ("likeness", pa.float64())])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    x0, y0 = max(0, r["x0"] - MARGIN), max(0, r["y0"] - MARGIN)
                    a, b = r["a"], r["b"]
                    moved = [(m["x"] - x0, m["y"] - y0) for m in r["chain"]]
                    if any(a[x : x + SEED_WORDS] != b[y : y + SEED_WORDS] for x, y in moved):
                        continue  # of another text with the same id
                    for part in parted(a, b, moved):
                        s, e, rs, re, like = aligned(a, b, part)
                        if e - s >= min_words and like >= min_like:
                            got.append((r["doc"], r["ref"], s + x0, e + x0, rs + y0, re + y0, e - s, round(like, 6)))
            if got:
                yield table(out, *map(list, zip(*sorted(got), strict=True)))

    return c.select("doc", "ref", "chain", "x0", "y0", "a", "b").mapInArrow(align, "doc_id long, ref_id long, start long, end long, ref_start long, ref_end long, n_words long, likeness double").distinct()
