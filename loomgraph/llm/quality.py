"""Quality rules (operator 6).

Statistics of a text are scored by gradient-boosted trees, trained here on a
bounded sample of labelled rows and flattened into numpy node arrays that score
a batch at a time. On chosen features the trees are monotonic: more symbols,
repeated lines, repeated words, capitals or exclamation marks never raise a score.

Cases: a null text has no words and no lines; texts of fewer words than a window
have no windows; one row comes out for each that goes in; with no labelled rows
every text that passes the base rules is kept; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, id_and_text, shingles, table, texts

TRAIN_ROWS = 3000
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 8
THRESHOLD = 0.5
WHITE = [9, 10, 11, 12, 13, 32]
SYMBOLS = [ord(c) for c in "#*$%&|<>"]
#: Name and monotonic direction of each feature of the model.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "bang_share": -1, "digit_share": -1, "words_per_line": 0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """(the five counts, the features) of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(len(raw) - by[128:192].sum() - by[WHITE].sum())
    symbols = int(by[SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n >= 4:
        _, at, count = np.unique(shingles(hashes.of(words), 3), return_inverse=True, return_counts=True)
        hit = count[at] > 1
        if hit.any():
            mask = np.zeros(n, bool)
            for i in range(3):
                mask[i : n - 2 + i] |= hit
            repeated = int(mask.sum())
    most = max(chars, 1)
    features = [np.log1p(n), chars / max(n, 1), symbols / most, dup / max(len(lines), 1), repeated / max(n, 1), by[65:91].sum() / most, by[33] / most, by[48:58].sum() / most, n / max(len(lines), 1)]
    return [n, chars, symbols, dup, repeated], features


class Trees:
    """Boosted trees as node arrays; node 0 of each tree is its root, and leaves point to themselves."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.feature, self.cut, self.left, self.right, self.value = (np.zeros((0, 2 ** (DEPTH + 1) - 1), t) for t in (np.int16, float, np.int16, np.int16, float))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, l, r, v in zip(self.feature, self.cut, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int16)
            for _ in range(DEPTH):
                at = np.where(x[rows, f[at]] <= c[at], l[at], r[at])
            out += v[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins. A split on a
    feature with a direction must order its children so, and bounds what grows below."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    rate = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    score = np.full(len(y), model.base)
    size = 2 ** (DEPTH + 1) - 1
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(size, np.int16), np.full(size, np.inf), np.zeros(size)
        left, right = np.arange(size, dtype=np.int16), np.arange(size, dtype=np.int16)
        todo = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, depth = todo.pop()
            value[node] = np.clip(g[rows].sum() / (h[rows].sum() + 1), low, high) * RATE
            best = None
            if depth < DEPTH and len(rows) >= 2 * LEAST:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for j, direction in enumerate(directions):
                    b, k = binned[rows, j], len(cuts[j]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], None))
                    if not len(gs):
                        continue
                    gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
                    vl, vr = np.clip(gs / (hs + 1), low, high), np.clip(gr / (hr + 1), low, high)
                    gain = gs**2 / (hs + 1) + gr**2 / (hr + 1) - whole
                    gain[(ns < LEAST) | (len(rows) - ns < LEAST) | (direction * (vr - vl) < 0)] = -1
                    i = int(gain.argmax())
                    if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                        best = (gain[i], j, i, vl[i], vr[i])
            if best is None:
                continue
            _, j, i, vl, vr = best
            feature[node], cut[node] = j, cuts[j][i]
            left[node], right[node] = 2 * node + 1, 2 * node + 2
            goes = binned[rows, j] <= i
            mid = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[directions[j]]
            todo += [(2 * node + 1, rows[goes], *bounds[0], depth + 1), (2 * node + 2, rows[~goes], *bounds[1], depth + 1)]
        made.append((feature, cut, left, right, value))
        one = Trees()
        one.feature, one.cut, one.left, one.right, one.value = (np.stack([m]) for m in made[-1])
        score += one.score(x)
    model.feature, model.cut, model.left, model.right, model.value = (np.stack(a) for a in zip(*made, strict=True))
    return model


def _features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, values in texts(batches):
            yield table(schema, ids, [statistics(t, hashes)[1] for t in values])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, features array<double>")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted to at most ``rows`` labelled documents, those whose ids hash lowest."""
    one = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    some = one.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = df.withColumn("_id", F.col(id_col).cast("long")).join(F.broadcast(some.select(F.col("doc_id").alias("_id"))), "_id", "left_semi")
    one = _features(chosen, id_col, text_col).groupBy("doc_id").agg(F.min("features").alias("features"))  # rows that share an id count once
    got = one.join(F.broadcast(some), "doc_id").orderBy("doc_id").collect()
    return fit(np.array([r.features for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got]), list(FEATURES.values()))


def judge(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of each row."""
    # the model, a few thousand numbers, goes with the function: workers need no copy of this package to read it
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for ids, values in texts(batches):
            both = [statistics(t, hashes) for t in values]
            counts, x = np.array([b[0] for b in both], np.int64), np.array([b[1] for b in both])
            score = 1 / (1 + np.exp(-model.score(x)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield table(schema, ids, *map(pa.array, counts.T.copy()), failed, ~failed & (score >= threshold), score)

    return id_and_text(df, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "base_failed boolean, kept boolean, score double"]))
