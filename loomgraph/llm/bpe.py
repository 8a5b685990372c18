"""BPE encoding and decoding (operator 2).

Each piece of text is encoded with a segment tree over the ranks of its adjacent
pairs. A node holds the smallest (rank, position) below it, so the root (node 1)
is the leftmost pair of lowest rank. A merge rewrites the two pairs beside it and
retires one leaf: three point updates of logarithmic cost, until the root holds
no rank. The words of a stretch of texts are told apart first; the trees of
their short pieces are rows of one array and take their steps together, and long
pieces have a tree of their own. Words repeat, so a bounded memo keeps theirs.

Cases: a null text is an empty text; empty texts give no ids; a piece of any
length is encoded whole; other columns of the input are not looked at; one row
comes out for each row that goes in. Strings of special tokens inside a text
become those tokens, as the vocabulary file says (cut before normalisation).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, release, table, texts

NONE = 1 << 62
MEMO = 60_000
#: Characters of words that a generation of the memo holds, and of texts that are looked up at a time, whatever their number.
MEMO_CHARS, STRETCH_CHARS = 4 << 20, 4 << 20
#: Pieces of up to so many bytes are merged together, and so many words of texts are looked up at a time.
TOGETHER, STRETCH = 64, 50_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def lowered(text: str) -> str:
    """Lower case, each character by itself (no final-sigma rule)."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


class RankTree:
    """A segment tree of minima; a leaf is rank * 2**32 + position, or NONE."""

    def __init__(self, leaves: list[int]):
        self.base = base = 1 << max(0, len(leaves) - 1).bit_length()
        self.node = node = [NONE] * base + leaves + [NONE] * (base - len(leaves))
        for i in range(base - 1, 0, -1):
            node[i] = min(node[2 * i], node[2 * i + 1])

    def put(self, at: int, value: int) -> None:
        node = self.node
        i = at + self.base
        if node[i] == value:
            return
        node[i] = value
        while i > 1:
            other = node[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if node[i] == value:
                return
            node[i] = value


class RankTrees:
    """A segment tree of minima for each of many short pieces, as rows of one array, so that a step merges one pair in all of them."""

    def __init__(self, leaves: np.ndarray):
        n, self.base = leaves.shape
        self.node = node = np.full((n, 2 * self.base), NONE, np.int64)
        node[:, self.base :] = leaves
        at = self.base
        while at > 1:
            at >>= 1
            node[:, at : 2 * at] = np.minimum(node[:, 2 * at : 4 * at : 2], node[:, 2 * at + 1 : 4 * at : 2])
        self.flat = node.ravel()

    def put(self, rows: np.ndarray, *leaves: tuple[np.ndarray, np.ndarray]) -> None:
        """Point updates: in each of ``rows``, the leaf at each first array takes the value in the second."""
        flat, start = self.flat, rows * (2 * self.base)
        places = [at + self.base for at, _ in leaves]
        for i, (_, value) in zip(places, leaves, strict=True):
            flat[start + i] = value
        for _ in range(self.base.bit_length() - 1):
            places = [i >> 1 for i in places]
            for i in places:
                x = start + 2 * i
                flat[start + i] = np.minimum(flat[x], flat[x + 1])


class PairTable:
    """Pairs to (rank, merged id) for many pairs at once: two hash tables, the second for what finds its place in the first taken, the rest by binary search."""

    BITS = (19, 13)

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        pairs = np.array([(a << 32 | b, rank, x) for (a, b), (rank, x) in merges.items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.tables = []
        for bits in self.BITS:
            keys, values = np.full(1 << bits, -1, np.int64), np.zeros((2, 1 << bits), np.int64)
            _, first = np.unique(self.place(pairs[:, 0], bits), return_index=True)
            at = self.place(pairs[first, 0], bits)
            keys[at], values[:, at] = pairs[first, 0], pairs[first, 1:].T
            pairs = np.delete(pairs, first, 0)
            self.tables.append((bits, keys, *values))
        self.rest = pairs

    @staticmethod
    def place(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).view(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, merged id) of each pair; negative ids have no pairs."""
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -2)
        rank, made = np.full(key.shape, NONE, np.int64), np.zeros(key.shape, np.int64)
        for bits, keys, ranks, ids in self.tables:
            at = self.place(key, bits)
            hit = keys[at] == key
            if hit.any():
                rank[hit], made[hit] = ranks[at[hit]], ids[at[hit]]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest[:, 0], key), len(self.rest) - 1)
            hit = self.rest[at, 0] == key
            rank[hit], made[hit] = self.rest[at[hit], 1], self.rest[at[hit], 2]
        return rank, made


class Bpe:
    """A BPE model of a tokenizers JSON file with word ends, byte-level symbols and no decoder."""

    def __init__(self, file: str, memo: int = MEMO):
        """``file``: what the file holds; ``memo``: a bound on the words remembered between the texts of a task, in each of two generations; ``MEMO_CHARS`` bounds them too."""
        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.table = PairTable(self.merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.number = {i: str(i) for i in self.token}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner, self.last = [self.vocab[s] for s in symbols], [self.vocab[s + self.end] for s in symbols]
        self.inner_of, self.last_of = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.most = memo
        self.forget()

    def forget(self) -> None:
        """Empty the memo of words: word -> (ids as text, tokens as text), None for a word without ids (``silent`` if there was one)."""
        self.held = 0
        self.young: dict[str, tuple[str, str] | None] = {}
        self.old: dict[str, tuple[str, str] | None] = {}
        self.silent = False

    def merged(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges, lowest rank first, leftmost first among equals."""
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        ids = [*ids]
        found = [merges.get(p) for p in zip(ids, ids[1:])]
        tree = RankTree([f[0] << 32 | i if f else NONE for i, f in enumerate(found)])
        after, before, put = list(range(1, n + 1)), list(range(-1, n - 1)), tree.put
        node = tree.node
        while (top := node[1]) != NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            ids[i] = x = found[i][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found[i] = f = merges.get((x, ids[k]))
                put(j, NONE)
                put(i, f[0] << 32 | i if f else NONE)
            else:
                put(i, NONE)
            h = before[i]
            if h >= 0:
                found[h] = f = merges.get((ids[h], x))
                put(h, f[0] << 32 | h if f else NONE)
        return [x for x in ids if x >= 0]

    def merged_together(self, ids: np.ndarray) -> np.ndarray:
        """``merged`` of each row at once; rows are filled up with -1, and symbols merged away become -1."""
        n, width = ids.shape
        base = 1 << max(0, width - 2).bit_length()
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int64)], 1).ravel()  # a place past the end of each row
        wide = width + 1
        of = ids.reshape(n, wide)
        leaves, made = np.full((n, base), NONE, np.int64), np.zeros((n, wide), np.int64)
        rank, made[:, : width - 1] = self.table.find(of[:, : width - 1], of[:, 1:width])
        leaves[:, : width - 1] = np.where(rank < NONE, rank << 32 | np.arange(width - 1), NONE)
        tree, made = RankTrees(leaves), made.ravel()
        after = np.tile(np.arange(1, wide + 1), n)
        before = np.tile(np.arange(-1, wide - 1), n)
        rows = np.arange(n)
        while True:
            top = tree.node[rows, 1]
            rows = rows[top != NONE]
            if not len(rows):
                return of
            i = top[top != NONE] & 0xFFFFFFFF
            start = rows * wide
            j = after[start + i]
            x = made[start + i]
            ids[start + i], ids[start + j] = x, -1
            k = np.minimum(after[start + j], width)  # ``width`` holds -1: no symbol
            after[start + i] = k
            before[start + k] = i
            h = before[start + i]
            right, y = self.table.find(x, ids[start + k])
            made[start + i] = y
            some = h >= 0
            h = np.where(some, h, i)
            left, y = self.table.find(ids[start + h], x)
            made[(start + h)[some]] = y[some]
            right = np.where(right < NONE, right << 32 | i, NONE)
            left = np.where(some, np.where(left < NONE, left << 32 | h, NONE), right)
            # a retired leaf is ``j``; where it is past the last pair it holds nothing anyway
            tree.put(rows, (np.minimum(j, base - 1), np.where(j < base, NONE, tree.flat[rows * 2 * base + 2 * base - 1])), (i, right), (h, left))

    def encoded(self, pieces: list[str]) -> list[tuple[str, str]]:
        """(ids, tokens) of each piece, parted by spaces. Short ones are merged together, long ones by themselves."""
        out: list[tuple[str, str]] = [("", "")] * len(pieces)
        raw = np.frombuffer(b"\n".join([p.encode("utf-8", "surrogatepass") for p in pieces]) + b"\n", np.uint8)
        ends = np.nonzero(raw == 10)[0]  # no piece holds a line end
        starts = np.concatenate([[0], ends[:-1] + 1])
        length = ends - starts
        number, token = self.number, self.token
        for k in np.nonzero(length > TOGETHER)[0].tolist():
            ids = self.inner_of[raw[starts[k] : ends[k]]]
            ids[-1] = self.last_of[raw[ends[k] - 1]]
            ids = self.merged(ids.tolist())
            out[k] = " ".join([number[i] for i in ids]), " ".join([token[i] for i in ids])
        low = 0
        for width in (2**k + 1 for k in range(TOGETHER.bit_length())):
            at = np.nonzero((length > low) & (length <= min(width, TOGETHER)))[0]
            low = width
            if not len(at):
                continue
            used = np.arange(width) < length[at, None]
            places = np.where(used, starts[at, None] + np.arange(width), 0)
            ids = np.where(used, self.inner_of[raw[places]], -1)
            rows = np.arange(len(at))
            ids[rows, length[at] - 1] = self.last_of[raw[ends[at] - 1]]
            ids = self.merged_together(ids)
            left = ids >= 0
            flat, sizes = ids[left].tolist(), left.sum(1).tolist()
            numbers, tokens = [number[i] for i in flat], [token[i] for i in flat]
            x = 0
            for k, n in zip(at.tolist(), sizes, strict=True):
                out[k] = (numbers[x], tokens[x]) if n == 1 else (" ".join(numbers[x : x + n]), " ".join(tokens[x : x + n]))
                x += n
        return out

    def parts(self, word: str) -> list[str | tuple[str, str]]:
        """Pieces, and (id, token) of special tokens, of text without spaces or line ends; no piece and no special token goes across those."""
        out: list[str | tuple[str, str]] = []
        for part in self.cut.split(word) if self.cut and "<|" in word else (word,):
            if part in self.special:
                out.append((self.number[self.special[part]], part))
            else:
                out += self.pieces.findall(lowered(part if part.isascii() else unicodedata.normalize("NFC", part)))
        return out

    def learn(self, words: set[str]) -> None:
        """Have the young generation remember all of ``words``."""
        young, old = self.young, self.old
        if len(young) >= self.most or self.held >= MEMO_CHARS:
            self.young, self.old = young, old = {}, young
            self.held = 0
        pieces: dict[str, int] = {}
        simple: list[tuple[str, int]] = []
        others: list[tuple[str, list[int | tuple[str, str]]]] = []
        fresh = words.difference(young)
        self.held += sum(map(len, fresh))
        for w in fresh:
            if w in old:
                young[w] = old[w]
            elif w.isascii() and w.isalpha():  # one piece
                simple.append((w, pieces.setdefault(w.lower(), len(pieces))))
            else:
                others.append((w, [pieces.setdefault(p, len(pieces)) if isinstance(p, str) else p for p in self.parts(w)]))
        if not pieces and not others:
            return
        got = self.encoded(list(pieces)) if pieces else []
        for w, k in simple:
            young[w] = got[k]
        for w, of in others:
            both = [got[k] if isinstance(k, int) else k for k in of]
            young[w] = both[0] if len(both) == 1 else (" ".join([x[0] for x in both]), " ".join([x[1] for x in both])) if both else None
            self.silent |= not both

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, part, _ in self.encode_all([text]) for i in part.split()]

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(index of a text, ids, decoded), both parted by spaces, for stretches of words of each text in order; none for a text without ids."""
        stretches: list[tuple[int, list[str]]] = []
        words: set[str] = set()
        size = chars = 0

        def ready() -> Iterator[tuple[int, str, str]]:
            self.learn(words)
            of = self.young
            for row, some in stretches:
                got = [of[w] for w in some]
                if self.silent:
                    got = list(filter(None, got))
                if got:
                    ids, tokens = zip(*got, strict=True)
                    yield row, " ".join(ids), " ".join(tokens)

        for row, text in enumerate(texts):
            split = list(filter(None, text.replace("\n", " ").split(" "))) if text else []
            for at in range(0, len(split), STRETCH):
                some = split[at : at + STRETCH]
                stretches.append((row, some))
                words.update(some)
                size += len(some)
                chars += len(text) * len(some) // len(split)
                if size >= STRETCH or chars >= STRETCH_CHARS:
                    yield from ready()
                    stretches, words, size, chars = [], set(), 0, 0
        yield from ready()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by single spaces, as files without a decoder ask for; unknown ids are left out."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row. ``path``: a tokenizers JSON file, sent to the workers as text."""
    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vars(spec).get("bpe")  # kept with the broadcast, which a worker keeps between tasks
        if bpe is None:
            bpe = spec.bpe = Bpe(spec.value)
        fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)
        try:
            for ids, values in texts(batches):
                n, both = [0] * len(values), [(hashlib.sha256(), hashlib.sha256()) for _ in values]
                lists: list[list[int]] = [[] for _ in values]
                for row, part, decoded in bpe.encode_all(values):
                    for digest, x in zip(both[row], (part, decoded), strict=True):
                        if n[row]:
                            digest.update(b" ")
                        digest.update(x.encode("utf-8", "surrogatepass"))
                    n[row] += part.count(" ") + 1
                    if keep_ids:
                        lists[row] += map(int, part.split(" "))
                yield table(schema, ids, n, [a.hexdigest() for a, _ in both], [b.hexdigest() for _, b in both], *[lists] * keep_ids)
        finally:
            bpe.forget()
            release()

    return id_and_text(df, id_col, text_col).mapInArrow(run, SCHEMA + ", ids array<int>" * keep_ids)
