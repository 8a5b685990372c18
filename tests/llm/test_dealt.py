"""Operators 11 to 13 against brute force, and on odd, empty and hot tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, periods, queries, trie, urls

DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("conv", "pid", "pos", "a", "b", "bytes", "x", "y", "n", "depth", "key", "kind", "range", "host", "path", "rule", "w", "g", "h", "p", "runs", "row", "owner")


def more(df):
    return df.select("*", *[F.lit("z").alias(c) for c in CLASH if c not in df.columns])


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


def brute_trie(rows):
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    of = {c: [t[2:] for t in sorted(v)] for c, v in of.items()}
    whole = {c: tuple(of.get(c - c % 5, [])[: crc(c) % 9] + of[c][crc(c) % 9 :]) for c in of}
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    kids, saved, leaves = Counter(), Counter(), Counter()
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not kids[k]
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if whole[c] == k))))) for k, m in members.items())


def got_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(queries.prefix_trie(spark, DIR)) == brute_trie(rows)


def test_trie_of_odd_hot_and_deep_conversations(spark):
    rng = np.random.default_rng(4)
    rows = [(c, t, "ua"[t % 2], str(rng.integers(0, 2))) for c in range(300) for t in range(int(rng.integers(1, 12)))]
    rows += [(c, t, "u", "same") for c in range(400, 700) for t in range(3)]  # copies
    rows += [(800, t, "u", f"é{t % 7}") for t in range(900)] + [(805, t, "u", f"é{t % 7}") for t in range(450)]  # one conversation of very many turns
    rows += [(900 + 5 * c, t, "u", "z") for c in range(12) for t in range(c + 1)]  # each the beginning of the next
    rows += [(1000, None, None, None), (1000, 2, "u", "x"), (1000, None, "u", None), (None, 1, "u", "x"), (1001, 1, "u", "x"), (1001, 1, "u", "x"), (1004, 3, "", ""), (-7, 1, "u", "x"), (2003, 1, "u", "x")]
    order = rng.permutation(len(rows)).tolist()
    df = more(spark.createDataFrame([rows[i] for i in order], SCHEMA)).repartition(7)
    # ids below zero are dealt as truncating division says, unlike Python's
    want = brute_trie([r for r in rows if r[0] != -7])
    assert got_trie(trie.prefix_trie(df.where("conv_id is null or conv_id <> -7"))) == want
    assert trie.prefix_trie(df.where("conv_id = -7")).count() == (1 if crc(-7) % 9 else 2)
    assert trie.prefix_trie(more(spark.createDataFrame([], SCHEMA))).isEmpty()


def test_trie_over_many_ranges(spark):
    """Conversations and ends that go on over partitions."""
    rows = [(c, t, "u", f"{t}{c % 3 if t > 5 else ''}") for c in range(40) for t in range(60)] + [(100 + c, 0, "u", "x") for c in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    many = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert got_trie(trie.prefix_trie(df)) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
        spark.conf.set("spark.sql.shuffle.partitions", many)


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def best_rule(url, rules):
    host, path = split_url(url)
    fit = [(-layer, len(h + p), len(h), v, h + p) for h, p, v, layer in rules if (host == h or h and host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit) if fit else None)


def test_urls_of_a_table(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url").collect()
    rules = [(*r, 0) for r in queries.URL_RULES]
    want, seen = [], Counter()
    for r in pages:
        host, path, best = best_rule(r.url, rules)
        junk = any(w in urls.JUNK for label in host.split(".") for w in label.split("-"))
        want.append((r.page_id, host, path, best and best[4], best[3] if best else "block" if junk else "allow"))
        seen[want[-1][3:]] += 1
    assert sorted(map(str, map(tuple, queries.url_rules(spark, DIR).collect()))) == sorted(map(str, want)) and len(seen) >= 6


@pytest.mark.parametrize("partitions", [3, 41])
def test_urls_by_many_nested_rules(spark, partitions):
    rng = np.random.default_rng(partitions)
    label = lambda: "abé"[int(rng.integers(0, 3))] * int(rng.integers(1, 3))
    name = lambda k: ".".join(label() for _ in range(int(rng.integers(1, k))))
    way = lambda k: "".join("/" + label() for _ in range(int(rng.integers(0, k))))
    rules = [(name(4), way(4), "allow" if rng.random() < 0.5 else "block", int(rng.integers(0, 2))) for _ in range(300)] + [("", "/a", "block", 0), ("a.", "", "block", 1)]
    rows = [(i, f"http://{name(5)}{way(6)}" + ("?/a" if i % 3 else "#x?")) for i in range(1500)]
    rows += [(i, "https://A.b.a/a/b/é") for i in range(500)]
    rows += [(1, None), (2, ""), (3, "a.b/a"), (None, "x://a/a"), (4, "://a/a"), (5, "x:///a"), (6, "x://a"), (7, "x://a?/a"), (8, "x://b..a/a"), (9, "x://u@a:80/a"), (9, "x://é\n/a\nb://c/"), (10, "http://" + "a." * 3000 + "b" + "/a" * 30_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        table = spark.createDataFrame(rules + [(None, "/", "block", 0), ("a", None, "block", 0)], "host string, path string, verdict string, layer int")
        got = urls.judged(more(spark.createDataFrame(rows, "page_id long, url string")), table).collect()
        want = []
        for i, u in rows:
            host, path, best = best_rule(u, rules)
            want.append((i, host, path, best and best[4], best and -best[0], best[3] if best else "allow"))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_urls_without_rules_or_rows(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string, layer int")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(r) for r in urls.judged(pages, none, default="block").collect()] == [(1, "a", "/b", None, None, "block")]
    assert urls.judged(more(pages.limit(0)), none).isEmpty() and urls.junk_hosts(pages).isEmpty()


def brute_runs(w, times=4, least=6):
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def test_runs_of_random_words():
    rng = np.random.default_rng(9)
    for k in range(600):
        n = int(rng.integers(0, 90))
        w = rng.integers(0, int(rng.integers(1, 5)), n)
        if n and k % 2:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, 12))
            w = np.array([w[i] if i < a else w[a + (i - a) % p] for i in range(n)])
        got = [(s, e - s, q) for s, e, q in periods.runs_of(w.astype(np.int64)).tolist()] if n else []
        assert got == brute_runs(w.tolist()), w.tolist()


def test_runs_of_a_table(spark):
    """The stated query on every document, by brute force on the words."""
    seen = 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.period_runs(spark, "/root/testdata/sf0.001").collect():
        w = WORD.findall(texts[r.doc_id])
        n, h = len(w), crc(r.doc_id)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 3000 else None
        if runs is None:
            continue
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        seen += len(runs)
    assert seen >= 10


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x " * 9), (5, "a " * 300_000), (6, "b c " * 3 + "b"), (7, "b\x1fc " * 8 + "\u00a0 "), (8, "a b " * 100 + "c d e " * 50 + "e d c d " * 20)]
    docs = more(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.collapse(docs).collect())
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = brute_runs(w) if i != 5 else [(0, 300_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert periods.report(periods.collapse(docs.limit(0))).isEmpty() and periods.repeated(docs).count() == len(rows)


def test_each_stage_of_the_pipeline_by_brute_force(spark, tmp_path):
    """Each stage on what the one before kept: groups by all pairs of shingle sets, secrets by patterns, words by arithmetic, ids by the tokenizers library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.collect())
    first = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known, once, clean, mixed, encoded = out

    assert all(first[r.doc_id] == r for r in known) and len(known) >= 0.9 * len(first)

    sets = {}
    for r in known:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(r.text or "")]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                low[y] = x
    assert sorted(r.doc_id for r in once) == [i for i in ids if top(i) == i]
    assert len(once) < len(known)

    # a document without a base match and without credentials near each other stays as it is; no base match is left
    hexes, access = re.compile("[0-9a-f]{16,}"), re.compile("AKIA[A-Z0-9]{14,}")
    assign = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}""", re.I | re.A)
    before = {r.doc_id: r.text or "" for r in once}
    hit = {i for i, t in before.items() if hexes.search(t) or access.search(t) or assign.search(t)}
    after = {r.doc_id: r.text or "" for r in clean}
    assert set(after) == set(before) and hit
    for i, t in after.items():
        assert not (hexes.search(t) or access.search(t) or assign.search(t))
        assert t == before[i] if i not in hit and "[" not in t else True
    assert all(r.n_chars == len(r.text or "") for r in clean)

    source, size = {r.doc_id: r.source for r in clean}, {r.doc_id: len(WORD.findall(r.text or "")) for r in clean}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, sum(totals.values())
    while True:
        todo = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in todo) for s in todo}
        over = [s for s in todo if share[s] > 3 * totals[s]]
        target.update(share if not over else {s: 3 * totals[s] for s in over})
        if not over:
            break
        left = sum(totals.values()) - sum(target.values())
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 3 and all(after[r.doc_id] == (r.text or "") for r in mixed)
    for s in names:  # the last document that a source takes in part is whole
        words = sum(n * size[i] for i, n in times.items() if source[i] == s)
        assert target[s] - 1 <= words <= target[s] + 3 * max(size[i] for i in size if source[i] == s) + 1

    library = Tokenizer.from_file(queries.tokenizer_file())
    library.no_truncation()
    library.no_padding()
    digest = {i: sha(" ".join(map(str, library.encode(after[i], add_special_tokens=False).ids))) for i in times}
    assert Counter((r.doc_id, r.ids_sha256) for r in encoded) == Counter({(i, digest[i]): n for i, n in times.items()})


def test_memo_of_long_words():
    """Distinct long words are forgotten by their characters, and texts of them are encoded all the same."""
    with open(queries.tokenizer_file(), encoding="utf-8") as f:
        coder = bpe.Bpe(f.read())
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("ABCDabcd0189+/"), 5000)) for _ in range(1200)]
    whole = {k: (ids, tokens) for k, ids, tokens in coder.encode_all(lines[:3])}
    for at in range(0, 1200, 100):
        list(coder.encode_all(lines[at : at + 100]))
        assert sum(map(len, coder.young)) <= bpe.MEMO_CHARS + bpe.STRETCH_CHARS
        assert sum(map(len, coder.old)) <= bpe.MEMO_CHARS + bpe.STRETCH_CHARS
    coder.forget()
    assert {k: (ids, tokens) for k, ids, tokens in coder.encode_all(lines[:3])} == whole
