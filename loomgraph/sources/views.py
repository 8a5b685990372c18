"""Tables and stand-in views: raw tool records, tool vectors, dependency graphs, call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spellings of a field in raw records (fixed values).
NAME_KEYS = ["name", "function_name", "tool_name", "api_name", "function", "tool", "api"]
DESCRIPTION_KEYS = ["description", "desc", "summary", "info"]
PARAMETER_KEYS = ["parameters", "params", "arguments", "args", "inputs"]
RETURN_KEYS = ["returns", "return", "output", "response"]


def raw_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ingest_seq, raw, domain): a ragged JSON record for each part; key spellings go round, some names are blank and some descriptions short."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    key = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    q = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    name = F.when(k % 97 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    about = F.when(k % 89 == 0, F.lit("short")).otherwise(F.concat(F.lit("Handles "), "p_name", F.lit(" of brand "), "p_brand", F.lit(".")))
    inner = F.concat(F.lit('{"size":{"type":"int","description":"Size '), F.col("p_size").cast("string"), F.lit('"},"brand":{"datatype":"str","desc":"Brand of the part","default":'), q(F.col("p_brand")), F.lit('},"flag":"bool","note":{"dtype":"arr"}}'))
    params = F.when(k % 2 == 0, inner).otherwise(F.concat(F.lit('{"type":"dict","properties":'), inner, F.lit(',"required":["size"]}')))
    returns = F.when(k % 3 == 0, F.lit('"int"')).otherwise(F.lit('{"type":"float","description":"Price"}'))
    # a spelling that comes first but holds no object
    params = F.concat(F.when((k % 7 == 0) & (k % len(PARAMETER_KEYS) != 0), F.lit('"parameters":"none",')).otherwise(""), q(key(PARAMETER_KEYS)), F.lit(":"), params)
    raw = F.concat(F.lit("{"), q(key(NAME_KEYS)), F.lit(":"), q(name), F.lit(","), q(key(DESCRIPTION_KEYS)), F.lit(":"), q(about), F.lit(","), params, F.lit(","), q(key(RETURN_KEYS)), F.lit(":"), returns, F.lit("}"))
    return p.select(k.alias("ingest_seq"), raw.alias("raw"), F.col("p_type").alias("domain"))


def tool_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tool, slot, role, vec): five vectors a tool, three inputs and two outputs."""
    e = table(spark, sf_dir, "embeddings")
    slot = F.expr("vec_id % 5").cast("int")
    return e.select(F.expr("vec_id div 5").alias("tool"), slot.alias("slot"), F.when(slot < 3, "in").otherwise("out").alias("role"), F.col("embedding").cast("array<double>").alias("vec"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, seq, tool, amount, args, ok): the call log of each user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("episode"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.col("value").alias("amount"), F.col("props").alias("args"), (F.col("event_type") != "error").alias("ok"), "ts")


def nested_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ingest_seq, raw, domain): a record for each part: a third without parameters (none, or an empty object), a third with
    nested ones, a third as a schema; returns of each form, or none."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    inner = F.concat(F.lit('{"size":{"type":"int","description":"Size '), size, F.lit('"},"where":{"type":"dict","description":"Place of the part","properties":{"zone":{"type":"list","description":"Zones"},"shelf":{"type":"dict","properties":{"row":{"type":"int","description":"Row '), size, F.lit('"}}}}},"tags":{"type":"list","default":["a",1]},"flag":"bool","required":["size"]}'))
    schema = F.concat(F.lit('{"type":"dict","properties":{"brand":{"type":"str","description":"Only '), "p_brand", F.lit('","default":"'), "p_brand", F.lit('"},"note":{"type":"str"}},"required":["brand"]}'))
    params = F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(',"parameters":{}')).otherwise("")).otherwise(F.concat(F.lit(',"parameters":'), F.when(k % 3 == 1, inner).otherwise(schema)))
    returns = F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(',"returns":"int"')).when(k % 4 == 2, F.lit(',"returns":{"type":"float","description":"Price"}')).otherwise(F.lit(',"returns":{"type":"dict","properties":{"price":{"type":"float","description":"Price"},"stock":{"type":"int"}}}'))
    raw = F.concat(F.lit('{"name":"'), "p_name", F.lit('","description":"Handles '), "p_name", F.lit(" of brand "), "p_brand", F.lit('."'), params, returns, F.lit("}"))
    return p.select(k.alias("ingest_seq"), raw.alias("raw"), F.col("p_type").alias("domain"))
