"""What the command line builds from a catalogue: schemas, a similarity graph with named domains, walks and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, communities, graph, schemas, similarity, texts, walks
from ..sources import documents, sinks
from .written import written

CATALOGUE = "ingest_seq long, domain string, name string, description string, params string, returns string"


def clean(spark: SparkSession, path: str, output: str) -> dict:
    """A cleaned catalogue of the raw records under ``path``."""
    raw, bad = documents.read_raw_tools(spark, path)
    tools = written(catalog.tools(documents.in_order(raw)))
    stats = catalog.cleaning_stats(tools)
    documents.write_catalogue(catalog.first_by_name(tools).select("ingest_seq", "domain", "name", "description", "params", "returns"), stats, output)
    return stats.first().asDict() | {"bad_files": bad.count()}


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return documents.read_catalogue(spark, path, CATALOGUE).withColumnRenamed("ingest_seq", "id")


def call_schemas(spark: SparkSession, path: str, output: str, platform: str = "") -> dict:
    """The schemas of a catalogue's tools as one JSON array, as callers of ``platform`` take them, or with what tools return where none is named."""
    g = written(schemas.generic_schemas(catalogue(spark, path), written))
    said = schemas.for_platform(g, F.lit(platform)) if platform else g
    sinks.save_values(said.select("schema"), output)
    return {"tools": g.count()}


def domains(spark: SparkSession, path: str, output: str, least: float = 0.75, resolution: float = 1.0, most: int = 30) -> dict:
    """The graph of tools that are alike by their texts, its communities of at most ``most`` tools, and a folder of tools for each, named by its commonest word."""
    t = catalogue(spark, path).select("id", "name", "description", "params")
    edges = written(texts.alike_sets(texts.hashed_vectors(schemas.embedding_texts(t)), least, written).withColumnRenamed("sim", "weight"))
    nodes = t.select("id")
    found = communities.split_large(communities.louvain(nodes, edges, written, resolution), edges, most, written, resolution)
    members = written(t.select("id", "name").join(found, "id"))
    names = communities.named(members)
    documents.write_graph(nodes, edges, graph.density(nodes, edges, directed=False), f"{output}/graph")
    title = F.concat_ws("_", F.coalesce("name", F.lit("domain")), F.col("community").cast("string"))
    documents.write_domains(members.join(names.select("community", title.alias("domain")), "community").select("id", "name", "domain"), f"{output}/domains")
    return {"tools": members.count(), "edges": edges.count(), "domains": names.count()}


def walks_and_tasks(spark: SparkSession, path: str, output: str, n_walks: int = 10, least: int = 3, most: int = 8) -> dict:
    """Walks over the edges that ``domains`` wrote, from the tool of the smaller id to the other, and a task for each: documents, and the tasks' summary."""
    edges = documents.read_graph(spark, f"{path}/graph")[1].select(F.lit(0).cast("long").alias("graph"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    w = written(walks.walk_batches(edges, n_walks, least, most, written, similarity.greedy_kept))
    name = F.concat(F.lit("walk_"), F.col("walk").cast("string"))
    sinks.save_walks(w.select(name.alias("id"), F.col("kind").alias("walk_type"), F.col("path").alias("sequence"), F.size("path").alias("length"), F.col("steps").alias("edges")), f"{output}/walks")
    tasks = walks.tasks(w).join(w.select("walk", F.col("kind").alias("walk_type"), "path"), "walk")
    sinks.save_tasks(tasks.select(F.col("task_id").alias("id"), name.alias("walk_id"), "walk_type", F.col("description").alias("task_description"), F.col("path").alias("function_sequence"), F.least(F.col("n_functions") / 10.0, F.lit(1.0)).alias("complexity")), f"{output}/tasks")
    return {"walks": w.count()}
