"""Checks of schemas, states and tools, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import leaving


def schema_violations(schemas: DataFrame) -> DataFrame:
    """(name, tbl, field, reason) of schemas(name, body): JSON of table -> {description, fields: {field: {type}}}."""
    text = "map<string,string>"
    is_object = lambda c: F.coalesce(F.startswith(F.trim(c), F.lit("{")), F.lit(False))
    one = lambda tbl, field, reason: F.struct(tbl.alias("tbl"), field.alias("field"), F.lit(reason).alias("reason"))
    none = F.lit(None).cast("string")
    whole = schemas.where(~(is_object(F.col("body")) & F.try_parse_json("body").isNotNull())).select("name", one(none, none, "schema is no object").alias("v"))
    good = schemas.where(is_object(F.col("body")) & F.try_parse_json("body").isNotNull())
    t = good.select("name", F.explode(F.map_entries(F.from_json("body", text))).alias("t")).select("name", F.col("t.key").alias("tbl"), F.col("t.value").alias("def"))
    d = t.withColumn("m", F.when(is_object(F.col("def")), F.from_json("def", text)))
    has = lambda k: F.coalesce(F.map_contains_key("m", k), F.lit(False))
    fields = F.col("m")["fields"]
    found = F.array(
        F.when(F.col("m").isNull(), one(F.col("tbl"), none, "table is no object")),
        F.when(F.col("m").isNotNull() & ~has("description"), one(F.col("tbl"), none, "no description")),
        F.when(F.col("m").isNotNull() & ~has("fields"), one(F.col("tbl"), none, "no fields")),
        F.when(has("fields") & ~is_object(fields), one(F.col("tbl"), none, "fields are no object")),
    )
    tables = d.select("name", F.explode(F.array_compact(found)).alias("v"))
    f = d.where(is_object(fields)).select("name", "tbl", F.explode(F.map_entries(F.from_json(fields, text))).alias("f"))
    bad = F.when(~is_object(F.col("f.value")), "field is no object").when(F.get_json_object("f.value", "$.type").isNull(), "no type")
    of_fields = f.withColumn("reason", bad).where("reason is not null").select("name", F.struct("tbl", F.col("f.key").alias("field"), "reason").alias("v"))
    return whole.unionAll(tables).unionAll(of_fields).select("name", "v.*")


def state_tables(schemas: DataFrame, states: DataFrame) -> DataFrame:
    """(name, tbl, status) of schemas and states(name, body): tables that are matched, missing in the state, extra there, or no object."""
    keys = lambda df, side: df.select("name", F.explode(F.map_entries(F.from_json("body", "map<string,string>"))).alias("t")).select("name", F.col("t.key").alias("tbl"), F.col("t.value").alias(side))
    status = F.when(F.col("state").isNull(), "missing").when(F.col("schema").isNull(), "extra").when(~F.startswith("state", F.lit("{")), "no object").otherwise("matched")
    return keys(schemas, "schema").join(keys(states, "state"), ["name", "tbl"], "full_outer").select("name", "tbl", status.alias("status"))


def enhanced_or_kept(records: DataFrame) -> DataFrame:
    """(name, body): of records(name, body, enhanced) the enhanced JSON if it has name, description and parameters, else the old."""
    from ..functions.parse import has_keys

    return records.select("name", F.when(has_keys(F.col("enhanced"), ["name", "description", "parameters"]), F.col("enhanced")).otherwise(F.col("body")).alias("body"))


def requirement_union(tools: DataFrame) -> DataFrame:
    """(requirement, n_tools) over tools(tool, passed, requirements): what the tools that pass need."""
    return tools.where("passed").select("tool", F.explode(F.array_distinct("requirements")).alias("requirement")).groupBy("requirement").agg(F.count("*").alias("n_tools"))


def environment_counts(tools: DataFrame) -> DataFrame:
    """(domain, n_tools, n_passed, success_rate) over tools(domain, tool, passed)."""
    r = tools.groupBy("domain").agg(F.count("*").alias("n_tools"), F.count_if("passed").alias("n_passed"))
    return r.withColumn("success_rate", F.when(F.col("n_tools") > 0, F.round(100.0 * F.col("n_passed") / F.col("n_tools"), 2)).otherwise(0.0))


def known_only(domains: DataFrame, tools: DataFrame) -> DataFrame:
    """(domain, name) of domains(domain, name) whose tool is known; domains without one go."""
    return domains.join(tools.select("name").distinct(), "name", "left_semi").select("domain", "name")


def described(walks: DataFrame, tools: DataFrame) -> DataFrame:
    """(walk, names, texts): the known tools of walks(walk, path) in order, with their descriptions; walks that know none go. ``tools``: id, description."""
    steps = walks.select("walk", F.posexplode("path").alias("pos", "id")).join(tools.select("id", "description"), "id")
    got = steps.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "description"))).alias("s"))
    return got.select("walk", F.transform("s", lambda x: x["id"]).alias("names"), F.transform("s", lambda x: x["description"]).alias("texts"))


def walk_subgraph(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """(walk, src, dst): every edge of the graph between two nodes of a walk, not only those walked."""
    n = walks.select("walk", F.explode(F.array_distinct("path")).alias("id"))
    begin = n.withColumnRenamed("id", "src")
    return leaving(edges, begin).select("src", "dst").join(begin, "src").join(n.withColumnRenamed("id", "dst"), ["walk", "dst"]).select("walk", "src", "dst").distinct()
