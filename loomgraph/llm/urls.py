"""URL rules by a sort-merge range join over reversed hosts (operator 12).

A rule is a host and the beginning of a path; it fits the urls of its host and of
all subdomains whose path starts with its path. A host is written from its last
label to its first with a dot after each, so a host and its subdomains are an
interval of keys, namely those that begin with the host's. Such intervals lie
within each other or apart. Hosts and rules are sorted together in ranges; a sweep
over a range keeps the stack of rules whose intervals are open. Rules that a range
inherits from earlier ones are the beginnings of its first key, found by an equi-join.

Two sweeps do it: the first gives each distinct host the rule hosts above it, the
second each distinct (rule host, path) the rules of that host that begin the path.
Only distinct keys are swept, so a hot host or url is one key, and rules are never
broadcast, so their number may grow with the data.

Of the rules that fit, those of the lowest ``layer`` count, then the longest by
characters of host and path, then by characters of host; of equal rules, block wins.
Where none fits, the verdict is ``default``.

Cases: null urls and those without ``://`` have an empty host and path; ports and
user names are part of the host; rules with a null host or path are left; an empty
host is fitted by rules of an empty host alone; null ids stay; repeated rows are rows
of their own; other columns are not looked at; no rules leave every url to ``default``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, materialise, table

DEFAULT = "allow"
#: Words of which a label of a junk host is made up.
JUNK = ("adult", "bets", "casino", "pills")
ACTIVE = "array<struct<key:string,tag:string>>"


def parts(url) -> tuple:
    """(host, path) of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_key(host):
    """Labels from last to first, each with a dot behind."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def swept(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, active): for each distinct ``key`` of ``items``, the (key, tag) of all ``rules`` whose key begins it, shortest first. Keys of rules are distinct."""
    events = rules.select("key", F.lit(0).alias("kind"), "tag").unionAll(items.select("key").where("key is not null").distinct().select("key", F.lit(1), F.lit(None).cast("string")))
    events = materialise(events.repartitionByRange("key", "kind").withColumn("range", F.spark_partition_id()))
    # a table of rules of S characters has at most sqrt(2 * S) lengths of keys
    lengths = sorted(r[0] for r in rules.select(F.length("key")).distinct().collect())
    firsts = events.groupBy("range").agg(F.min("key").alias("first"))
    starts = firsts.select("range", F.explode(F.transform(F.filter(F.lit(lengths or [0]), lambda n: n <= F.length("first")), lambda n: F.substring(F.col("first"), F.lit(1), n))).alias("key"))
    inherited = starts.join(rules.select("key", "tag"), "key").select("key", F.lit(0).alias("kind"), "tag", "range")
    schema = pa.schema([("key", pa.string()), ("active", pa.list_(pa.struct([("key", pa.string()), ("tag", pa.string())])))])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for b in batches:
            keys, active = [], []
            for key, kind, tag, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != at:
                    at, stack = of, []
                while stack and not key.startswith(stack[-1]["key"]):
                    stack.pop()
                if kind:
                    keys.append(key)
                    active.append(list(stack))
                elif not stack or stack[-1]["key"] != key:
                    stack.append({"key": key, "tag": tag})
            if keys:
                yield table(schema, keys, active)

    both = events.select("key", "kind", "tag", "range").unionAll(inherited)
    return both.repartition("range").sortWithinPartitions("range", "key", "kind").mapInArrow(sweep, f"key string, active {ACTIVE}")


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, layer, verdict) of each row by ``rules`` (host, path, verdict, layer); rule and layer are null where none fits."""
    host, path = parts(F.col(url_col).cast("string"))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = materialise(p.select("host", "path").distinct())
    r = rules.select("layer", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path", "verdict").where("host is not null and path is not null")
    said = F.struct((-F.col("layer")).cast("int").alias("order"), (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "verdict", F.concat("host", "path").alias("rule"))
    r = r.withColumn("above", host_key(F.col("host"))).select("above", F.concat("above", F.lit("/"), "path").alias("key"), said.alias("said"))
    r = materialise(r.groupBy("above", "key").agg(F.max("said").alias("said")).select("above", "key", F.to_json("said").alias("tag")))
    hosts = urls.select("host").distinct().withColumn("key", host_key(F.col("host")))
    above = swept(hosts, r.select(F.col("above").alias("key"), F.lit(None).cast("string").alias("tag")).distinct())
    above = materialise(hosts.join(above, "key").select("host", F.explode("active.key").alias("above")))
    # (rule host, path) has no slash before its path's, so no rule host's key begins another's
    tried = materialise(urls.join(above, "host").select("host", "path", F.concat("above", F.lit("/"), "path").alias("key")))
    found = materialise(swept(tried, r.select("key", "tag")).where(F.size("active") > 0))
    best = F.array_max(F.transform("active", lambda a: F.from_json(a["tag"], "order int, size int, host_size int, verdict string, rule string")))
    won = tried.join(found.select("key", best.alias("best")), "key").groupBy("host", "path").agg(F.max("best").alias("best"))
    # an image of the url as key: both sides are dealt anew, and AQE may split a url of very many rows
    image = apart(F.xxhash64("host", "path")).alias("k")
    won = materialise(won.select(image, F.col("host").alias("h"), F.col("path").alias("t"), "best"))
    p = p.select("*", image).join(won.withColumnRenamed("k", "j"), (F.col("k") == F.col("j")) & (F.col("host") == F.col("h")) & (F.col("path") == F.col("t")), "left")
    return p.select("page_id", "host", "path", "best.rule", (-F.col("best.order")).alias("layer"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def junk_hosts(pages: DataFrame, layer: int = 1, url_col: str = "url", words: tuple[str, ...] = JUNK) -> DataFrame:
    """A block rule for each host of which a label has one of ``words`` between its hyphens."""
    hosts = pages.select(parts(F.col(url_col).cast("string"))[0].alias("host")).distinct()
    return hosts.where(F.col("host").rlike(f"(^|[.-])({'|'.join(words)})([.-]|$)")).select("host", F.lit("").alias("path"), F.lit("block").alias("verdict"), F.lit(layer).alias("layer"))
