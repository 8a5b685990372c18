"""Command line: clean raw tool records into a catalogue, write its schemas, its domains, walks and tasks, or run a named query over a folder of tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import build, further, more, queries

QUERIES = queries.QUERIES | more.QUERIES | further.QUERIES


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *places: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        for x in places:
            c.add_argument(x)
        c.add_argument("-o", "--output", required=True)
        return c

    command("clean", "raw tool records (JSON files) to a catalogue", "path")
    command("schemas", "schemas of a catalogue's tools as one JSON array", "path").add_argument("--platform", default="")
    c = command("domains", "the similarity graph of a catalogue's tools, and a folder for each of its communities", "path")
    c.add_argument("--least", type=float, default=0.75)
    c.add_argument("--resolution", type=float, default=1.0)
    c.add_argument("--most", type=int, default=30)
    c = command("walks", "walks over a graph that domains wrote, and a task for each", "path")
    c.add_argument("--num-walks", type=int, default=10)
    c.add_argument("--least", type=int, default=3)
    c.add_argument("--most", type=int, default=8)
    q = sub.add_parser("query", help="a named query, written as JSON lines")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("tables")
    q.add_argument("-o", "--output", required=True)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    if a.command == "query":
        QUERIES[a.name](spark, a.tables).write.mode("overwrite").json(a.output)
        return
    run = {
        "clean": lambda: build.clean(spark, a.path, a.output),
        "schemas": lambda: build.call_schemas(spark, a.path, a.output, a.platform),
        "domains": lambda: build.domains(spark, a.path, a.output, a.least, a.resolution, a.most),
        "walks": lambda: build.walks_and_tasks(spark, a.path, a.output, a.num_walks, a.least, a.most),
    }
    print(json.dumps(run[a.command]()))


if __name__ == "__main__":
    main()
