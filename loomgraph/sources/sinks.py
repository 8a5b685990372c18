"""Sinks of single JSON documents: one array of all rows, or a file a row. Tasks write beside the target; the commit moves or joins
what they wrote, so a reader sees the old document or the new one, and a task that is lost or tried again leaves nothing.

Paths are those of any file system that Arrow knows. One array is one file, so the commit copies parts into it one after
another, a block at a time: its memory is a block, whatever the size of the document.

A file a row is for folders that people open: the commit moves them one by one, and the driver holds their names. Many documents
are packed: a line each in a file a task, which readers of documents take as they take files."""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COPY = 1 << 20
SPACE = re.compile(r"[ \t\n\r]*")


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and its name there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (order, file, rows, name of the document if it is one)."""

    files: list


class _Sink(DataSource):
    """Options: ``path``."""

    @classmethod
    def name(cls) -> str:
        return cls.NAME

    def schema(self) -> str:
        return self.SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return self.WRITER(self.options["path"], overwrite)


def elements(fs: arrow_fs.FileSystem, path: str) -> int | None:
    """How many elements the JSON array in a file has; None if it isn't one. Elements are read one by one, so memory is a block or the largest."""
    decode, value = codecs.getincrementaldecoder("utf-8")("surrogatepass").decode, json.JSONDecoder().raw_decode
    text, at, n = "", 0, 0
    with fs.open_input_stream(path) as f:

        def more() -> bool:
            nonlocal text, at
            block = f.read(max(COPY, len(text) - at))
            text, at = text[at:] + decode(block, not block), 0
            return bool(block)

        def peek() -> str:
            """The next character that is no space, where ``at`` is left; none at the end."""
            nonlocal at
            while True:
                at = SPACE.match(text, at).end()
                if at < len(text) or not more():
                    return text[at : at + 1]

        try:
            if peek() != "[":
                return None
            at += 1
            while n or peek() != "]":
                if not peek():
                    return None
                while True:
                    try:
                        end = value(text, at)[1]
                    except ValueError:
                        end = len(text)
                    # a number or an element that is cut at the end of a block goes on in the next
                    if end < len(text) and text[end] in " \t\n\r,]":
                        break
                    if not more():
                        return None
                at, n = end, n + 1
                if peek() == "]":
                    break
                if peek() != ",":
                    return None
                at += 1
            at += 1
            return None if peek() else n
        except ValueError:
            return None


def _copy_between(fs: arrow_fs.FileSystem, path: str, out) -> None:
    """What stands between the brackets of the array in a file, a block at a time."""
    with fs.open_input_file(path) as f:
        first, last = 0, f.size()
        while f.read_at(1, first) != b"[":
            first += 1
        while f.read_at(1, last - 1) != b"]":
            last -= 1
        first, last = first + 1, last - 1
        for step in range(first, last, COPY):
            block = f.read_at(min(COPY, last - step), step)
            out.write((block.lstrip() if step == first else block) if step + COPY < last else (block.strip() if step == first else block.rstrip()))


class ArrayWriter(DataSourceArrowWriter):
    """Rows (value string) as elements of one JSON array, in order of partitions."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, rows = TaskContext.get(), 0
        fs, path = opened(self.path)
        name = f"{path}.{self.run}/{task.partitionId():08d}-{task.taskAttemptId()}"
        fs.create_dir(f"{path}.{self.run}")
        with fs.open_output_stream(name) as out:
            for batch in iterator:
                if batch.num_rows:
                    values = ",\n".join(value or "null" for value in batch.column(0).to_pylist())
                    out.write(((",\n" if rows else "") + values).encode("utf-8", "surrogatepass"))
                    rows += batch.num_rows
        return Written([(task.partitionId(), name, rows, None)])

    def commit(self, messages: list) -> None:
        fs, path = opened(self.path)
        there = not self.overwrite and fs.get_file_info(path).type == arrow_fs.FileType.File and elements(fs, path)
        done = f"{path}.{self.run}/done"
        fs.create_dir(f"{path}.{self.run}")
        with fs.open_output_stream(done) as out:
            out.write(b"[\n")
            empty = not there
            if there:
                _copy_between(fs, path, out)
            for _, name, rows, _ in sorted(x for m in messages if m for x in m.files):
                if not rows:
                    continue
                out.write(b"" if empty else b",\n")
                empty = False
                with fs.open_input_stream(name) as part:
                    while block := part.read(COPY):
                        out.write(block)
            out.write(b"\n]\n")
        fs.move(done, path)
        fs.delete_dir(f"{path}.{self.run}")

    def abort(self, messages: list) -> None:
        fs, path = opened(self.path)
        if fs.get_file_info(f"{path}.{self.run}").type == arrow_fs.FileType.Directory:
            fs.delete_dir(f"{path}.{self.run}")


class DocumentWriter(DataSourceArrowWriter):
    """Rows (name string, body string), each as the file ``name``.json in a folder; a name that comes twice is an error."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, f".{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, files = TaskContext.get(), []
        fs, path = opened(self.path)
        folder = f"{path}/{self.run}/{task.partitionId():08d}-{task.taskAttemptId()}"
        fs.create_dir(folder)
        for batch in iterator:
            for name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"not a name of a document: {name!r}")
                with fs.open_output_stream(f"{folder}/{len(files)}") as out:
                    out.write((body or "null").encode("utf-8", "surrogatepass"))
                files.append((task.partitionId(), f"{folder}/{len(files)}", 1, name))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, path = opened(self.path)
        files = [x for m in messages if m for x in m.files]
        names = [x[3] for x in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("documents of one name")
        if self.overwrite:
            there = fs.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
            fresh = {f"{n}.json" for n in names}
            for f in there:
                if f.base_name.endswith(".json") and f.base_name not in fresh:
                    fs.delete_file(f.path)
        for _, file, _, name in files:
            fs.move(file, f"{path}/{name}.json")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, path = opened(self.path)
        if fs.get_file_info(f"{path}/{self.run}").type == arrow_fs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.run}")


class JsonArray(_Sink):
    NAME, SCHEMA, WRITER = "json_array", "value string", ArrayWriter


class JsonDocuments(_Sink):
    NAME, SCHEMA, WRITER = "json_documents", "name string, body string", DocumentWriter


def register(spark: SparkSession) -> None:
    for sink in (JsonArray, JsonDocuments):
        spark.dataSource.register(sink)


def save_json(df: DataFrame, path: str, append: bool = False) -> None:
    """Rows as one JSON array; appended to the array at ``path`` if there is one. What is there and is no array is replaced."""
    register(df.sparkSession)
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.format("json_array").option("path", path).mode("append" if append else "overwrite").save()


def save_values(df: DataFrame, path: str) -> None:
    """Rows of one column of JSON as one array."""
    register(df.sparkSession)
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.format("json_array").option("path", path).mode("overwrite").save()


def save_documents(df: DataFrame, path: str, name: str = "name", body: str = "body", append: bool = False) -> None:
    """Each row as a document of its own, ``name``.json, in the folder ``path``."""
    register(df.sparkSession)
    df.select(F.col(name).cast("string").alias("name"), F.col(body).cast("string").alias("body")).write.format("json_documents").option("path", path).mode("append" if append else "overwrite").save()


def save_packed(df: DataFrame, path: str, name: str = "name", body: str = "body") -> None:
    """Each row as a document of the folder ``path``, a line each in a file a task; what was there goes. A name that comes twice is an error."""
    fs, to = opened(path.rstrip("/"))
    run = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    x = F.col("name")
    named = df.select(F.col(name).cast("string").alias("name"), F.coalesce(F.col(body).cast("string"), F.lit("null")).alias("body"))
    wrong = F.raise_error(F.concat(F.lit("not a name of a document: "), F.coalesce(x, F.lit("null"))))
    good = F.when(x.isNull() | (x == "") | F.contains(x, F.lit("/")) | F.startswith(x, F.lit(".")), wrong.cast("string")).otherwise(x)
    try:
        named.select(good.alias("name"), "body").write.option("compression", "gzip").json(run)
        if not df.sparkSession.read.schema("name string").json(run).groupBy("name").count().where("count > 1").isEmpty():
            raise ValueError("documents of one name")
        if fs.get_file_info(to).type == arrow_fs.FileType.Directory:
            fs.delete_dir(to)
        fs.move(opened(run)[1], to)
    finally:
        if fs.get_file_info(opened(run)[1]).type == arrow_fs.FileType.Directory:
            fs.delete_dir(opened(run)[1])


def _bodies(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("body"))


def save_walks(walks: DataFrame, path: str, packed: bool = False) -> None:
    """walks(id, ...), a document each, a file each or packed."""
    (save_packed if packed else save_documents)(_bodies(walks, "id"), path)


def save_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A document for each graph of nodes(graph, id) and edges(graph, src, dst, weight): its nodes and edges, in order. A graph is bounded by its sampler."""
    n = nodes.groupBy("graph").agg(F.transform(F.array_sort(F.collect_list(F.struct("id"))), lambda x: F.struct(x["id"].alias("id"))).alias("nodes"))
    e = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight"))).alias("edges"))
    save_documents(_bodies(n.join(e, "graph", "left").select(F.col("graph").cast("string").alias("id"), "nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges")), "id"), path)


def save_tasks(tasks: DataFrame, path: str, packed: bool = False) -> None:
    """tasks(id, walk_type, function_sequence, complexity, ...), a document each, and ``tasks_summary``: counts, means and kinds of walks."""
    kind = lambda k: F.count_if(F.col("walk_type") == k).alias(k)
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    s = tasks.agg(F.count("*").alias("total_tasks"), zero("complexity").alias("avg_complexity"), zero(F.size("function_sequence")).alias("avg_sequence_length"), F.struct(kind("chain"), kind("dag")).alias("walk_types"))
    s = s.select("total_tasks", F.struct("avg_complexity", "avg_sequence_length", "walk_types").alias("statistics"))
    s = s.select(F.lit("tasks_summary").alias("name"), F.to_json(F.struct("*")).alias("body"))
    if packed:
        save_packed(_bodies(tasks, "id"), path)
        save_documents(s, path, append=True)
    else:
        save_documents(_bodies(tasks, "id").unionAll(s), path)


def save_trajectories(trajectories: DataFrame, path: str, packed: bool = False) -> None:
    """trajectories(id, walk_id, success, ...), a document for each that succeeded, and ``generation_summary``: counts, and the walks that failed as an array of their own beside it."""
    (save_packed if packed else save_documents)(_bodies(trajectories.where("success"), "id"), path)
    s = trajectories.agg(F.count("*").alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))
    save_json(s, f"{path}/generation_summary.json")
    save_json(trajectories.where("not success").select("walk_id"), f"{path}/failed_walks.json")
