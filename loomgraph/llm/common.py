"""Shared parts: written tables in the shared folder, components, word hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or where that is unset and there is one machine (tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return path or _OWN.get("dir") or _OWN.setdefault("dir", tempfile.mkdtemp(prefix="loomgraph-"))


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._loomgraph_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (a count decides), else unmarked for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def apart(col):
    """A one-to-one image of a long key. Joining on it after grouping by the key
    itself makes Spark deal both sides anew, so AQE may split a hot key."""
    return col.bitwiseXOR(F.lit(0x5BD1E995).cast("long"))


def join_min(rows: DataFrame, key: str, mins: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with the grouped ``mins`` on a long ``key`` that may be hot on the left."""
    r, m = rows.withColumn("_k", apart(F.col(key))), mins.withColumn("_k", apart(F.col(key))).drop(key)
    return r.join(m, "_k").drop("_k")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph as (id, component), component being its smallest id.

    Alternates large-star and small-star steps until the edge set stands still;
    each round's edges are a written table. Ids in no edge, and the smallest of
    each component, do not appear: they are their own component.
    Null ends and loops are ignored. Hot nodes are joined on keys AQE can split.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = materialise(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())

    def mark(t: DataFrame):
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    if not before[0]:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_min(both.where("v > u"), "u", m).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = join_min(large, "u", m)
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e, old = materialise(small), e
        now = mark(e)
        discard(old)
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64, so that hash order is unrelated to content."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Signed 64-bit hash of each run of ``n`` words; a shorter text is one run; none for no words."""
    w = word_hashes
    if not len(w):
        return np.empty(0, np.int64)
    if len(w) < n:
        n = len(w)
    out = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return mixed(out).view(np.int64)


def release() -> None:
    """Give memory that a worker no longer uses back to the system, as idle workers stay for the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\t \\n \\v \\f \\r, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of batches with an id and a text column, a slice of at most 256 rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0), part.column(1).to_pylist()


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
