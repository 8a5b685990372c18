"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, forest, langid, minhash, mixing, periods, pii, quality, secrets, substring, trie, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_table(spark, sf_dir, "documents"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.training_text(docs.where(~langid.held_out()))
    got = langid.identify(docs, model)
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def mixing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.report(docs, pii.train(docs))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


#: (host, path, verdict) of the stated rules.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    stated = spark.createDataFrame([(*r, 0) for r in URL_RULES], "host string, path string, verdict string, layer int")
    got = urls.judged(pages, stated.unionAll(urls.junk_hosts(pages)))
    return got.select("page_id", "host", "path", F.when(F.col("layer") == 0, F.col("rule")).alias("rule"), "verdict")


def period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(periods.collapse(periods.repeated(_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_substring_dedup": substring_dedup,
    "op2_bpe_round_trip": bpe_round_trip,
    "op3_language_id": language_id,
    "op4_mixing_flow": mixing_flow,
    "op5_embedding_dedup": embedding_dedup,
    "op6_quality_rules": quality_rules,
    "op7_secret_scan": secret_scan,
    "op8_minhash_dedup": minhash_dedup,
    "op9_pii_scan": pii_scan,
    "op10_warc_round_trip": warc_round_trip,
    "op11_prefix_trie": prefix_trie,
    "op12_url_rules": url_rules,
    "op13_period_runs": period_runs,
}

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (SELECT payload_digest, max(page_id) AS ref FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
  CASE WHEN r.ref <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r.ref <> p.page_id THEN r.ref END AS refers_to
FROM p LEFT JOIN r ON p.payload_bytes >= 1000 AND p.payload_digest = r.payload_digest
"""

#: 4-word shingle sets held whole, all pairs that share a shingle counted, components by recursion.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, hash(unnest(s)) AS h FROM s),
often AS (SELECT h FROM u GROUP BY h HAVING count(*) > 1),
v AS (SELECT u.doc_id, u.h FROM u SEMI JOIN often ON u.h = often.h),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM v a JOIN v b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comp AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(least(n.doc_id, coalesce(low, n.doc_id)) AS BIGINT) AS component_id,
  least(n.doc_id, coalesce(low, n.doc_id)) = n.doc_id AS kept
FROM n LEFT JOIN comp ON comp.a = n.doc_id
"""

#: Prefixes held whole as lists of (role, text); every node is listed with each of its ancestors. crc32 bit by bit.
TRIE_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL
), crc(c, s, v, k) AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR), 4294967295::BIGINT, 0 FROM t
  UNION ALL
  SELECT c, CASE WHEN k = 7 THEN s[2:] ELSE s END, CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END, (k + 1) % 8
  FROM (SELECT *, CASE WHEN k = 0 THEN xor(v, ascii(s[1])::BIGINT) ELSE v END AS u FROM crc WHERE s <> '')
), h AS (SELECT c, c - c % 5 AS base, xor(v, 4294967295) % 9 AS h FROM crc WHERE s = ''),
r AS (
  SELECT h.c, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h
  UNION ALL SELECT h.c, 1, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h
), w AS (SELECT h.c, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS w FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
p AS (SELECT c, len(w) AS size, unnest(range(0, len(w) + 1)) AS d, w FROM w),
n AS (
  SELECT w[1:d] AS k, d, min(c) AS owner, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE strlen(w[d].text) END) AS bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS ends FROM p GROUP BY ALL
), kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
every AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids ON kids.k = n.k),
up AS (SELECT k[1:j] AS k, sum((n - 1) * bytes) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM every) GROUP BY ALL)
SELECT CAST(e.owner AS BIGINT) AS conv_id, CAST(e.d AS BIGINT) AS depth, CAST(above.owner AS BIGINT) AS parent_conv_id, CAST(e.n AS BIGINT) AS n_convs, CAST(e.kids AS BIGINT) AS n_children,
  CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM every e JOIN up ON up.k = e.k LEFT JOIN n above ON e.d > 0 AND above.k = e.k[1:e.d - 1]
"""

#: The stated rules tried one by one; hosts with a junk word in a label are blocked where none fits.
URL_SQL = r"""
WITH rest AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
rules(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
distinct_urls AS (SELECT DISTINCT host, path FROM u),
best AS (
  SELECT host, path, max_by({'rule': h || p, 'verdict': verdict}, length(h || p)) AS best
  FROM distinct_urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
)
SELECT u.page_id, u.host, u.path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN regexp_matches(u.host, '(^|[.-])(adult|bets|casino|pills)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best ON best.host = u.host AND best.path = u.path
"""

ORACLE = {"op10_warc_round_trip": WARC_SQL, "op8_minhash_dedup": MINHASH_SQL, "op11_prefix_trie": TRIE_SQL, "op12_url_rules": URL_SQL}
