"""Normalising ragged tool records into typed rows (schema on read), and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import DESCRIPTION_KEYS, NAME_KEYS, PARAMETER_KEYS, RETURN_KEYS

NAME_LENGTH = (3, 50)
LEAST_DESCRIPTION = 10
#: Short type names and what they stand for (fixed values).
TYPES = {"str": "string", "int": "integer", "bool": "boolean", "obj": "object", "arr": "array"}


def _fields(raw: Column) -> Column:
    """A record's fields in source order, each value as text."""
    return F.from_json(raw, "map<string,string>")


def clean_name(fields: Column) -> Column:
    """The first spelling with a non-blank name; without marks, blanks as one underscore, lower case."""
    found = F.coalesce(*[F.nullif(F.trim(fields[k]), F.lit("")) for k in NAME_KEYS])
    return F.lower(F.regexp_replace(F.regexp_replace(found, r"(?U)[^\w\s]", ""), r"(?U)\s+", "_"))


def clean_description(fields: Column) -> Column:
    """The first spelling whose trimmed text is long enough."""
    return F.coalesce(*[F.when(F.length(F.trim(fields[k])) >= LEAST_DESCRIPTION, F.trim(fields[k])) for k in DESCRIPTION_KEYS])


def mapped_type(t: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), t), t)


def tools(raw: DataFrame) -> DataFrame:
    """(ingest_seq, domain, name, description, params, returns, status) of each record."""
    f = raw.select("ingest_seq", "domain", _fields(F.col("raw")).alias("f"))
    params = F.coalesce(*[F.when(F.startswith(F.col("f")[k], F.lit("{")), F.col("f")[k]) for k in PARAMETER_KEYS])  # the first spelling that is an object
    returns = F.coalesce(*[F.nullif(F.col("f")[k], F.lit("")) for k in RETURN_KEYS])
    t = f.select("ingest_seq", "domain", clean_name(F.col("f")).alias("name"), clean_description(F.col("f")).alias("description"), params.alias("params"), returns.alias("returns"))
    status = F.when(F.coalesce(F.length("name"), F.lit(0)).between(*NAME_LENGTH), F.when(F.col("description").isNull(), "invalid_description").otherwise("fixed")).otherwise("invalid_name")
    return t.withColumn("status", status)


def parameters(tool_rows: DataFrame) -> DataFrame:
    """(ingest_seq, pos, pname, type, description, default_json): a row for each parameter, in source order."""
    outer = F.from_json("params", "map<string,string>")
    inner = F.coalesce(F.from_json(outer["properties"], "map<string,string>"), outer)
    flat = tool_rows.select("ingest_seq", F.posexplode(F.map_entries(inner)).alias("pos", "p"))
    flat = flat.select("ingest_seq", "pos", F.col("p.key").alias("pname"), F.col("p.value").alias("v"), F.when(F.startswith("p.value", F.lit("{")), F.from_json("p.value", "map<string,string>")).alias("m"))
    bare = F.col("m").isNull()  # a bare value is a type as it stands
    kind = F.when(bare, F.col("v")).otherwise(mapped_type(F.trim(F.coalesce(*[F.col("m")[k] for k in ("type", "datatype", "dtype")]))))
    about = F.when(bare, F.concat(F.lit("Parameter "), "pname")).otherwise(F.trim(F.coalesce(*[F.col("m")[k] for k in ("description", "desc", "info")])))
    return flat.select("ingest_seq", "pos", "pname", kind.alias("type"), about.alias("description"), F.col("m")["default"].alias("default_json"))


def returned(tool_rows: DataFrame) -> DataFrame:
    """(ingest_seq, type, description) of what each tool returns; a bare value is a type."""
    m = F.when(F.startswith("returns", F.lit("{")), F.from_json("returns", "map<string,string>"))
    return tool_rows.where("returns is not null").select("ingest_seq", F.coalesce(m["type"], "returns").alias("type"), F.coalesce(m["description"], F.lit("Function return value")).alias("description"))


def first_by_name(tool_rows: DataFrame) -> DataFrame:
    """The earliest valid record of each name."""
    w = Window.partitionBy("name").orderBy("ingest_seq")
    return tool_rows.where("status = 'fixed'").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def cleaning_stats(tool_rows: DataFrame) -> DataFrame:
    """One row: total_input, fixed, removed_invalid, removed_duplicates, final_count."""
    ok = F.col("status") == "fixed"
    s = tool_rows.agg(F.count("*").alias("total_input"), F.count_if(ok).alias("fixed"), F.count_if(~ok).alias("removed_invalid"), F.count_distinct(F.when(ok, F.col("name"))).alias("final_count"))
    return s.select("total_input", "fixed", "removed_invalid", (F.col("fixed") - F.col("final_count")).alias("removed_duplicates"), "final_count")


def simple_parameters(params: Column) -> Column:
    """JSON of the bare properties where the JSON-Schema form is used, else as it is."""
    inner = F.get_json_object(params, "$.properties")
    schema = F.get_json_object(params, "$.type").isNotNull() & F.startswith(inner, F.lit("{"))
    return F.when(F.coalesce(schema, F.lit(False)), inner).otherwise(params)


def call_schemas(tool_rows: DataFrame) -> DataFrame:
    """(ingest_seq, schema): the function-call JSON of each valid tool, parameters in source order; none are an empty object. Nested ones: see ``schemas``."""
    t = tool_rows.where("status = 'fixed'")
    one = F.struct("type", "description", F.col("default_json").alias("default"))
    p = parameters(t).groupBy("ingest_seq").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("pname").alias("key"), one.alias("value")))).alias("ps"))
    props = F.map_from_entries(F.transform("ps", lambda x: F.struct(x["key"], x["value"])))
    required = F.coalesce(F.from_json(F.get_json_object("params", "$.required"), "array<string>"), F.array().cast("array<string>"))
    inner = F.struct(F.lit("object").alias("type"), props.alias("properties"), required.alias("required"))
    made = F.struct(F.lit("function").alias("type"), F.struct("name", "description", inner.alias("parameters")).alias("function"))
    return t.join(p, "ingest_seq", "left").withColumn("ps", F.coalesce("ps", F.array().cast(p.schema["ps"].dataType))).select("ingest_seq", F.to_json(made).alias("schema"))
