"""Sinks of single documents, messages in one form, tools in SQL, the order of cyclic graphs, JSON in prose."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import parse, text
from loomgraph.operators import communities, graph, logs, messages, replay
from loomgraph.plans.written import written
from loomgraph.sources import documents, sinks


def load(path):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def test_one_array(spark, tmp_path):
    p = str(tmp_path / "deep" / "a.json")
    df = spark.range(50).repartition(4).select("id", F.concat(F.lit('é"\n'), F.col("id").cast("string")).alias("s"))
    sinks.save_json(df, p)
    assert sorted(r["id"] for r in load(p)) == list(range(50)) and load(p)[0]["s"].startswith('é"\n')
    for k in (1, 2):
        sinks.save_json(spark.createDataFrame([(100 + k, None)], "id long, s string"), p, append=True)
        assert [r["id"] for r in load(p)[50:]] == list(range(101, 101 + k)) and len(load(p)) == 50 + k
    sinks.save_json(df.limit(0), p, append=True)
    assert len(load(p)) == 52
    for bad in ('{"an": "object"}', "{broken", "", "[1, 2"):
        with open(p, "w") as f:
            f.write(bad)
        sinks.save_json(spark.range(2), p, append=True)
        assert sorted(r["id"] for r in load(p)) == [0, 1]
    sinks.save_json(df.limit(0), p)
    assert load(p) == []
    sinks.save_json(spark.range(1), f"file:{p}", append=True)
    assert load(p) == [{"id": 0}] and os.listdir(tmp_path / "deep") == ["a.json"]


def test_a_task_that_fails_leaves_the_old_document(spark, tmp_path):
    p = str(tmp_path / "a.json")
    sinks.save_json(spark.range(3), p)
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        sinks.save_json(bad, p, append=True)
    assert len(load(p)) == 3 and os.listdir(tmp_path) == ["a.json"]


def test_documents_of_rows(spark, tmp_path):
    p = str(tmp_path / "docs")
    put = lambda rows, **k: sinks.save_documents(spark.createDataFrame(rows, "name string, body string"), p, **k)
    put([("a", "[1]"), ("b b", '{"x": "é"}'), ("c", None)])
    assert sorted(os.listdir(p)) == ["a.json", "b b.json", "c.json"] and load(f"{p}/b b.json") == {"x": "é"} and load(f"{p}/c.json") is None
    assert {r.name: r.body for r in documents.read_documents(spark, p).collect()}["a"] == "[1]"
    put([("a", "[2]"), ("d", "4")], append=True)
    assert sorted(os.listdir(p)) == ["a.json", "b b.json", "c.json", "d.json"] and load(f"{p}/a.json") == [2]
    put([("e", "5")])
    assert os.listdir(p) == ["e.json"]
    for rows in ([("x", "1"), ("x", "2")], [("../x", "1")], [(None, "1")]):
        with pytest.raises(Exception):
            put(rows, append=True)
    assert os.listdir(p) == ["e.json"]


def test_graphs_tasks_and_trajectories(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "graph long, id long")
    edges = spark.createDataFrame([(1, 10, 11, 0.5)], "graph long, src long, dst long, weight double")
    sinks.save_graphs(nodes, edges, str(tmp_path / "g"))
    assert load(tmp_path / "g" / "1.json") == {"id": "1", "nodes": [{"id": 10}, {"id": 11}], "edges": [{"source": 10, "target": 11, "weight": 0.5}]}
    assert load(tmp_path / "g" / "2.json")["edges"] == []
    got_nodes, got_edges = documents.graph_of_documents(spark, str(tmp_path / "g"))
    assert sorted((r.graph, r.id) for r in got_nodes.collect()) == [("1", "10"), ("1", "11"), ("2", "20")] and got_edges.first().weight == 0.5
    tasks = "id string, walk_id string, walk_type string, function_sequence array<string>, complexity double"
    sinks.save_tasks(spark.createDataFrame([("task_1", "1", "dag", ["a", "b"], 0.2), ("task_2", "2", "chain", ["a"], 0.4)], tasks), str(tmp_path / "t"))
    s = load(tmp_path / "t" / "tasks_summary.json")
    assert s["total_tasks"] == 2 and s["statistics"]["walk_types"] == {"chain": 1, "dag": 1} and s["statistics"]["avg_sequence_length"] == 1.5
    sinks.save_tasks(spark.createDataFrame([], tasks), str(tmp_path / "none"))
    assert load(tmp_path / "none" / "tasks_summary.json")["statistics"]["avg_complexity"] == 0
    sinks.save_trajectories(spark.createDataFrame([("a", "w1", True), ("b", "w2", False)], "id string, walk_id string, success boolean"), str(tmp_path / "r"))
    assert load(tmp_path / "r" / "generation_summary.json") == [{"total": 2, "successful": 1, "failed": 1}] and load(tmp_path / "r" / "failed_walks.json") == [{"walk_id": "w2"}]
    assert load(tmp_path / "r" / "a.json")["walk_id"] == "w1" and not (tmp_path / "r" / "b.json").exists()


def test_memory_after_resets(spark):
    roles = ["user", "system", "user", "user", "system", "system", "assistant", None, "user"]
    df = spark.createDataFrame([(1, k, r, str(k)) for k, r in enumerate(roles)] + [(2, 7, "user", "x"), (None, 1, "user", "y")], "conv long, pos long, role string, content string")
    for chunk in (2, 3, 4096):
        got = {(r.conv, r.pos): (r.segment, r.place, r.current) for r in messages.memory(df, chunk=chunk).collect()}
        assert [got[1, k] for k in range(9)] == [(0, 1, False), (1, 1, False), (1, 2, False), (1, 3, False), (2, 1, False), (3, 1, True), (3, 2, True), (3, 3, True), (3, 4, True)]
        assert got[2, 7] == (0, 1, True)


def test_history_of_blocks_and_texts(spark):
    mark = text.MARKER
    use = {"type": "tool_use", "tool_use": {"id": "1", "name": "f", "input": {"a": [1, {"b": 'q"'}]}}}
    rows = [
        ("user", "hi", None),
        ("user", None, [{"type": "tool_result", "tool_use_id": "1", "content": "r1"}, {"type": "text", "text": "no"}, "odd", {"type": "tool_result"}]),
        ("assistant", None, [{"type": "text", "text": "first"}, {"type": "thinking", "thinking": "t"}, use, {"type": "text", "text": "last"}]),
        ("assistant", None, []),
        ("assistant", f'  said {mark}[{{"id": "2", "name": "g", "arguments": "{{\\"x\\": 1}}"}}, {{"name": "h", "arguments": "not json"}}, {{"arguments": {{"y": 2}}}}]', None),
        ("assistant", f"kept {mark}[broken", None),
        ("assistant", f"none {mark}[]", None),
        ("system", "gone", None),
        (None, "gone", None),
        ("user", None, None),
    ]
    df = spark.createDataFrame([(1, k, r, c, None if b is None else json.dumps(b)) for k, (r, c, b) in enumerate(rows)], "conv long, pos long, role string, content string, blocks string")
    got = messages.format_history(df, chunk=3).orderBy("place").collect()
    assert [r.place for r in got] == list(range(9)) and [r.role for r in got] == ["user", "tool", "tool", "assistant", "assistant", "assistant", "assistant", "assistant", "user"]
    assert [(r.tool_call_id, r.content) for r in got[1:3]] == [("1", "r1"), ("", "")]
    a = got[3]
    assert (a.content, a.reasoning) == ("last", "t") and json.loads(a.tool_calls) == [{"id": "1", "type": "function", "function": {"name": "f", "arguments": use["tool_use"]["input"]}}]
    assert (got[4].content, got[4].reasoning, got[4].tool_calls) == ("", "", None)
    assert got[5].content == "said" and [c["function"] for c in json.loads(got[5].tool_calls)] == [{"name": "g", "arguments": {"x": 1}}, {"name": "h", "arguments": "not json"}, {"name": "", "arguments": {"y": 2}}]
    assert got[6].content == f"kept {mark}[broken" and got[6].tool_calls is None and (got[7].content, got[7].tool_calls) == ("none", None) and got[8].content == ""


def test_order_of_cycles(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (4, 3), (6, 6), (7, 3), (5, 8)]
    df = graph.topo_order(spark.range(10), spark.createDataFrame(pairs, "src long, dst long"), written)
    got = {r.id: (r.level, r.component, r.depth) for r in df.collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 1), 2: (0, 0, 2), 3: (1, 3, 0), 4: (1, 3, 1), 5: (1, 3, 2), 6: (0, 6, 0), 7: (0, 7, 0), 8: (2, 8, 0), 9: (0, 9, 0)}
    assert graph.topo_order(spark.range(0), spark.createDataFrame([], "src long, dst long"), written).isEmpty()


def test_tools_in_sql(spark):
    tools = replay.Tools().register("add", lambda data, a, b=0: a + b)
    replay.register_table_function(spark, "run_some", tools, {})
    spark.createDataFrame([("add", "1", '{"a": 2, "b": 3}'), ("add", "2", "{}"), ("gone", "3", None)], "tool string, test_id string, parameters string").createOrReplaceTempView("some_tests")
    got = {r.test_id: r for r in spark.sql("SELECT * FROM run_some(TABLE(some_tests) PARTITION BY tool)").collect()}
    assert json.loads(got["1"].results) == {"tool_result": 5} and got["1"].message is None
    assert not got["2"].success and got["2"].message.startswith("TypeError") and got["3"].message == "KeyError: 'gone'" and got["3"].results is None


def test_nested_arrays_in_prose():
    assert text.find_json("see [[1, 2], [3]] ok") == "[[1, 2], [3]]"
    assert text.find_json("[1, [2, [3]]]") == "[2, [3]]"  # two levels are tried before whole brackets
    assert text.find_json('x {"a": [[1]]} y') == '{"a": [[1]]}'
    assert text.find_json("none [ here") is None


def test_report_of_no_tools(spark):
    r = logs.named_report(spark.createDataFrame([], "tool string, ok boolean")).first()
    assert (r.total, r.success_rate, r.failed_tools) == (0, 0.0, [])


def test_validity_names_and_rounds(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 3)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 2, 0.9, "a", "b"), (1, 2, 0.4, "a", "a"), (1, 3, 0.6, "a", "a"), (1, 3, 0.9, None, None)], "src long, dst long, sim double, out_type string, in_type string")
    assert {(r.src, r.dst): (r.n_pairs, r.n_valid, r.valid) for r in graph.edge_validity(edges, pairs, 0.5).collect()} == {(1, 2): (2, 0, False), (1, 3): (2, 1, True), (2, 3): (0, 0, False)}
    members = spark.createDataFrame([(1, 1, "get user"), (1, 2, "get File get"), (1, 3, "make file"), (2, 4, "?"), (3, 5, None)], "community long, id long, name string")
    assert {r.community: (r.name, r.n_members) for r in communities.named(members).collect()} == {1: ("file", 3), 2: (None, 1), 3: (None, 1)}
    out = spark.createDataFrame([('{"b": 1, "gone": {"x": 1}, "a": "1"}',), ("[1]",), (None,)], "t string").select(parse.without_keys(F.col("t"), "gone").alias("t")).collect()
    assert out[0].t == '{"b":1,"a":"1"}' and out[2].t is None
    small, large = (replay.Tools().register("f", (lambda m: lambda data, k: 1 // (k <= m))(m)) for m in (1, 2))
    tests = spark.createDataFrame([("f", str(k), json.dumps({"k": k})) for k in range(4)] + [("g", "9", "{}")], "tool string, test_id string, parameters string")
    got = {r.tool: (r.n_tests, r.n_failed, r.last_round) for r in replay.repair_rounds(tests, [small, large], {}, written).collect()}
    assert got == {"f": (4, 1, 1), "g": (1, 1, 1)}
    assert replay.repair_rounds(tests.where("test_id < 2"), [small, large], {}, written).first().last_round == 0


def test_command_line_to_walks(spark, tmp_path, capsys):
    """Raw records to a catalogue, its schemas, domains, walks and tasks."""
    from loomgraph.__main__ import main

    tools = [{"name": f"{verb} {noun} {k}", "description": f"{verb} the {noun} of a {noun} store", "parameters": {}} for k, verb in enumerate(("get", "list", "find")) for noun in ("user", "file")]
    tools += [{"name": "odd one", "description": "Something else altogether", "parameters": {"x": {"type": "dict", "description": "An x", "properties": {"y": {"type": "int"}}}}}]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text(json.dumps(tools))
    at = {k: str(tmp_path / k) for k in ("raw", "cat", "domains", "walks")}

    def run(*arguments):
        main(list(arguments))
        return json.loads(capsys.readouterr().out.splitlines()[-1])

    assert run("clean", at["raw"], "-o", at["cat"])["final_count"] == 7
    assert run("schemas", at["cat"], "-o", str(tmp_path / "s.json"), "--platform", "openai") == {"tools": 7}
    got = {x["function"]["name"]: x["function"]["parameters"] for x in load(tmp_path / "s.json")}
    assert got["odd_one"]["properties"]["x"]["properties"] == {"y": {"type": "integer", "description": ""}} and got["get_user_0"]["properties"] == {}
    said = run("domains", at["cat"], "-o", at["domains"], "--least", "0.6")
    assert said == {"tools": 7, "edges": 6, "domains": 3}
    assert sorted(x.split("=")[1].split("_")[0] for x in os.listdir(tmp_path / "domains" / "domains") if "=" in x) == ["file", "odd", "user"]
    assert run("walks", at["domains"], "-o", at["walks"], "--num-walks", "1", "--most", "3")["walks"] == 1
    s = load(tmp_path / "walks" / "tasks" / "tasks_summary.json")
    assert s["total_tasks"] == 1 and len(os.listdir(tmp_path / "walks" / "walks")) == 1


def test_packed_documents_and_tasks(spark, tmp_path):
    """Many documents in few files, read as a file each is; beside them documents of their own."""
    p, n = str(tmp_path / "p"), 5000
    df = spark.range(0, n, 1, 4).select(F.concat(F.lit("task_"), F.col("id").cast("string")).alias("name"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit('é"\n').alias("walk_id"))).alias("body"))
    sinks.save_packed(df, p)
    assert sum(f.startswith("part-") for f in os.listdir(p)) == 4
    sinks.save_documents(spark.createDataFrame([("tasks_summary", '{"total_tasks": 5000}'), ("task_odd", "{broken")], "name string, body string"), p, append=True)
    got = {r.name: json.loads(r.body) for r in documents.read_documents(spark, p, "task").collect()}
    assert len(got) == n + 1 and got["task_7"] == {"id": "7", "walk_id": 'é"\n'} and got["tasks_summary"]["total_tasks"] == n
    assert documents.read_tasks(spark, p).where("walk_id is not null").count() == n
    sinks.save_packed(df.where("name = 'task_1'"), p)
    assert [r.name for r in documents.read_documents(spark, p).collect()] == ["task_1"]
    sinks.save_packed(df.limit(0), p)
    assert documents.read_documents(spark, p).isEmpty()
    for rows in ([("x", "1"), ("x", "2")], [("../x", "1")], [(None, "1")], [("", "1")]):
        with pytest.raises(Exception):
            sinks.save_packed(spark.createDataFrame(rows, "name string, body string"), p)
    assert os.listdir(tmp_path) == ["p"]


def test_documents_of_queries_are_few_files(spark, monkeypatch):
    """No query writes a file a row."""
    from loomgraph.plans import further, more

    wrote, save = [], sinks.save_documents
    monkeypatch.setattr(sinks, "save_documents", lambda df, path, **k: wrote.append(df.count()) or save(df, path, **k))
    for f in (further.trajectory_files, further.task_files, further.walk_files, more.graph_documents):
        assert not f(spark, "/root/testdata/sf0.001").isEmpty()
    assert all(n <= 1 for n in wrote)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_arrays_element_by_element(tmp_path, monkeypatch, block):
    """What is an array is told as json.loads tells it, wherever blocks end."""
    from pyarrow import fs

    monkeypatch.setattr(sinks, "COPY", block)
    p = str(tmp_path / "a")
    for said in ("[]", " [ ] ", "[1]", "[12, -3.5e10 ,\n4]\n", '["a,]", {"b": [1, {"c": "é\\n"}]}, null, true]', "[[], [[1]]]", "[NaN]", "", "[", "]", "[1", "[1,", "[1,]", "[1 2]", "[1] x", "[1][2]", "{}", "5", '"[1]"', "[tru]", "[1.5e]", "[01]"):
        with open(p, "w") as f:
            f.write(said)
        try:
            want = json.loads(said)
        except ValueError:
            want = None
        assert sinks.elements(fs.LocalFileSystem(), p) == (len(want) if isinstance(want, list) else None), said


def test_append_holds_a_block(spark, tmp_path):
    """Memory of an append is a block, not the array that is there; and tasks share the array when it is read."""
    import tracemalloc

    p = str(tmp_path / "a.json")
    with open(p, "w") as f:
        f.write("[\n" + ",\n".join(json.dumps({"id": k, "s": "x" * 200}) for k in range(100_000)) + "\n]\n")
    tracemalloc.start()
    sinks.ArrayWriter(p, False).commit([])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20 < os.path.getsize(p) and len(load(p)) == 100_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
    try:
        got = documents.read_array(spark, p, "id long, s string")
        assert got.rdd.getNumPartitions() > 3 and got.agg(F.sum("id")).first()[0] == sum(range(100_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for said in ('[{"id": 1}, {"id": 2}]', '[\n{"id": 1,\n"s": "a"},\n{"id": 2}]', '[{"id": 1}\n,\n{"id": 2}\n]'):
        with open(p, "w") as f:
            f.write(said)
        assert sorted(r.id for r in documents.read_array(spark, p, "id long, s string").collect()) == [1, 2]
