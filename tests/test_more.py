"""Samples, walks, communities, replay and texts on small graphs: what has no SQL."""

import difflib
import json
import os
import random
import subprocess
import sys
from collections import Counter

import pytest

from loomgraph.operators import communities, graph, replay, samples, similarity, walks
from loomgraph.plans.written import written
from loomgraph.sources import documents

PAIRS = {(i, (i * k + k + 1) % 15) for i in range(15) for k in (1, 2, 4)} - {(i, i) for i in range(15)}


@pytest.fixture(scope="module")
def ring(spark):
    nodes = spark.createDataFrame([(i,) for i in range(15)], "id long")
    return nodes, spark.createDataFrame([(a, b, 1.0 + a) for a, b in PAIRS], "src long, dst long, weight double")


def listed(df):
    out = {}
    for r in df.orderBy("sample", "pos").collect():
        out.setdefault(r["sample"], []).append(r.id)
    return out


def test_samples_follow_edges(spark, ring):
    nodes, edges = ring
    first = samples.starts(nodes, 4, 1)
    begin = {r["sample"]: r.id for r in first.collect()}
    both = PAIRS | {(b, a) for a, b in PAIRS}
    for got, most in ((samples.spread(first, edges, 3, 9, written, 1), 9), (samples.spread(first, edges, 2, 9, written, 1, unvisited=True), 9), (samples.by_depth(first, edges, 2, 6, written, 1), 6)):
        paths = listed(got)
        assert set(paths) == set(begin)
        for s, p in paths.items():
            assert p[0] == begin[s] and len(set(p)) == len(p) <= most
            assert all(any((q, x) in PAIRS for q in p[:k]) for k, x in enumerate(p) if k)
    for s, p in listed(samples.chains(first, edges, 6, written, 1)).items():
        assert begin[s] in p and len(set(p)) == len(p) and all((a, b) in PAIRS for a, b in zip(p, p[1:]))
    assert listed(samples.spread(first, edges.limit(0), 3, 9, written, 1)) == {s: [i] for s, i in begin.items()}
    assert both


def test_features_of_known_graphs(spark):
    rows = [(0, i) for i in range(4)] + [(1, 10), (1, 11), (1, 12)] + [(2, 20)]
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (10, 11), (11, 10), (5, 6)], "src long, dst long")
    got = {r["sample"]: r for r in samples.features(spark.createDataFrame(rows, "sample long, id long"), edges).collect()}
    assert (got[0].diameter, got[0].is_dag, got[0].weak_components, got[0].strong_components) == (3, True, 1, 4)
    assert (got[1].diameter, got[1].is_dag, got[1].weak_components, got[1].strong_components) == (0, False, 2, 2)
    assert (got[2].num_nodes, got[2].num_edges, got[2].density, got[2].complexity) == (1, 0, 0.0, 0.0)


def test_samples_of_unlike_nodes(spark):
    rows = [(s, i) for s, ids in enumerate(([1, 2, 3], [1, 2, 3], [3, 4, 5], [7, 8])) for i in ids]
    got = samples.diverse(spark.createDataFrame(rows, "sample long, id long"), 0.7, written, similarity.greedy_kept)
    assert sorted(r["sample"] for r in got.collect()) == [0, 2, 3]


def test_modularity_finds_cliques(spark):
    cliques = [range(k, k + 5) for k in (0, 5, 10)]
    pairs = [(a, b, 1.0) for g in cliques for a in g for b in g if a < b] + [(4, 5, 0.2), (9, 10, 0.2)]
    nodes = spark.createDataFrame([(i,) for i in range(16)], "id long")
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    got = {r.id: r.community for r in communities.louvain(nodes, edges, written).collect()}
    assert got == {i: i - i % 5 for i in range(15)} | {15: 15}
    whole = spark.createDataFrame([(i, 0) for i in range(15)], "id long, community long")
    assert {r.id: r.community for r in communities.split_large(whole, edges, 6, written).collect()} == {i: i - i % 5 for i in range(15)}
    stats = communities.community_stats(whole.limit(0), 2).first()
    assert stats.n_communities == 0 and stats.mean_size is None


def test_frontier_walks_have_no_cycles(spark, ring):
    _, edges = ring
    one = {r.walk: r for r in walks.dag_walks(spark, edges, 6, 5, written).collect()}
    assert len(one) == 6
    for r in one.values():
        depth = {n.id: n.depth for n in r.nodes}
        assert len(depth) == len(r.nodes) <= 5
        assert all((s.src, s.dst) in PAIRS and depth[s.src] < depth[s.dst] for s in r.steps) and len(r.steps) >= len(depth) - 1
    assert walks.dag_walks(spark, edges.limit(0), 3, 5, written).count() == 0


def test_valid_walks_are_no_copies(spark):
    rows = [(0, [1, 2, 3]), (1, [3, 2, 1]), (2, [1, 2, 9]), (3, [1, 2]), (4, list(range(20)))]
    got = walks.valid_walks(spark.createDataFrame(rows, "walk long, path array<long>"), 3, 8, 0.8, written, similarity.greedy_kept)
    assert sorted(r.walk for r in got.collect()) == [0, 2]


def test_pruning_keeps_linked_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "src long, dst long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.1), (1, 2, 0.6), (3, 4, 0.2)], "src long, dst long, sim double")
    left, kept = graph.pruned(nodes, edges, pairs, 0.5)
    assert sorted(r.id for r in left.collect()) == [0, 1, 2] and kept.count() == 2
    assert graph.pruned(nodes, edges, pairs, 0.5, smallest=4)[0].isEmpty()


def test_texts_alike_as_all_pairs(spark):
    texts = ["create file", "create files", "delete file", "x", "xy", "a much longer name of a tool", "a much longer name of the tool", ""]
    got = {(r.src, r.dst) for r in similarity.alike_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.8).collect()}
    assert got == {(a, b) for b in range(len(texts)) for a in range(b) if difflib.SequenceMatcher(None, texts[b], texts[a]).ratio() > 0.8}


def test_failed_tools_leave_state_alone(spark):
    def add(data, k=0):
        data.setdefault("seen", []).append(k)
        return k

    def bad(data, **_):
        data["seen"] = None
        raise KeyError("gone")

    tools = replay.Tools().register("add", add).register("bad", bad)
    events = spark.createDataFrame([(1, 2, "bad", "{}"), (1, 1, "add", '{"k": 3}'), (1, 3, "add", '{"k": 4}'), (2, 1, "none", None)], "episode long, seq long, tool string, args string")
    got = replay.replay(events, tools, {"seen": []}).orderBy("episode", "snapshot_id").collect()
    assert [json.loads(r.state)["seen"] for r in got] == [[], [3], [3], [3, 4], [], []]
    assert [r.success for r in got] == [True, True, False, True, True, False]
    assert replay.replay(events, tools, {"seen": []}, rounds=1).count() == 4
    tests = spark.createDataFrame([("add", "a", '{"k": 1}'), ("add", "b", '{"j": 1}')], "tool string, test_id string, parameters string")
    fixed = replay.Tools().register("add", lambda data, **_: 1)
    assert replay.repaired(tests, [tools, fixed], {})[0] == 1
    assert {r.tool: (r.n_tests, r.passed) for r in replay.tool_verdicts(spark.createDataFrame([("add",), ("idle",)], "tool string"), replay.run_tests(tests, tools, {})).collect()} == {"add": (2, False), "idle": (0, True)}


def test_entry_needs_no_session():
    """The driver imports the entry before it makes a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_settings(tmp_path):
    assert documents.Settings.read() == documents.Settings()
    p = tmp_path / "s.json"
    p.write_text('{"edge": 0.5, "similarity": "None"}')
    assert documents.Settings.read(str(p)).edge == 0.5 and documents.Settings.read(str(p)).similarity is None
    p.write_text('{"edges": 1}')
    with pytest.raises(ValueError):
        documents.Settings.read(str(p))


def test_command_line(spark, tmp_path, capsys):
    from loomgraph.__main__ import main

    (tmp_path / "raw").mkdir()
    tool = {"name": "make file", "description": "Makes a file on disk.", "parameters": {"path": {"type": "str"}}}
    (tmp_path / "raw" / "a.json").write_text(json.dumps([tool, tool, {"name": "x"}]))
    (tmp_path / "raw" / "b.json").write_text(json.dumps({"apis": [{**tool, "function_name": "other", "name": ""}]}))
    (tmp_path / "raw" / "c.json").write_text("{broken")
    main(["clean", str(tmp_path / "raw"), "-o", str(tmp_path / "out")])
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said == {"total_input": 4, "fixed": 3, "removed_invalid": 1, "removed_duplicates": 1, "final_count": 2, "bad_files": 1}
    assert documents.read_catalogue(spark, str(tmp_path / "out"), "name string").count() == 2


def test_edges_counted_where_they_are_found(spark, monkeypatch):
    """Neighbours, and pairs of edges, counted in many blocks without any edges stored are those of the edges."""
    rng = random.Random(9)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rows = [(t, k, "in" if k < 2 else "out", [rng.gauss(0, 1) for _ in range(4)]) for t in range(30) for k in range(4)]
    vecs = spark.createDataFrame(rows, "key long, pos int, role string, vec array<double>")
    edges = {(r.src, r.dst) for r in similarity.dependency_edges(vecs, 0.8).collect()}
    both = edges | {(b, a) for a, b in edges}
    assert {(r.id, r.n_neighbours) for r in similarity.neighbour_counts(vecs, 0.8).collect()} == set(Counter(a for a, _ in both).items())
    few = spark.createDataFrame([(3,), (8,)], "id long")
    assert {(r.src, r.dst) for r in similarity.neighbours_of(vecs, few, 0.8).collect()} == {(a, b) for a, b in both if a in (3, 8)}
    pairs = similarity.best_matches(vecs, 0.8).collect()
    good = Counter((r.src, r.dst) for r in pairs if r.sim >= 0.9 and (r.src + r.in_pos) % 2 == 0)
    got = similarity.checked_edges(vecs, 0.8, 0.9, lambda src, out_pos, dst, in_pos: (src + in_pos) % 2 == 0).collect()
    assert {(r.src, r.dst): (r.n_pairs, r.n_valid, r.valid) for r in got} == {e: (n, good[e], good[e] > 0) for e, n in Counter((r.src, r.dst) for r in pairs).items()}


def test_tools_are_few_files(spark, tmp_path):
    """Packed tools are a file a task and come back as they were."""
    tools = spark.range(300).selectExpr("concat('t', id) AS name", "concat('import json', chr(10), 'x = ', id, chr(10)) AS code").coalesce(2)
    documents.write_tools(tools, str(tmp_path), packed=True)
    assert sum(f.endswith(".gz") for _, _, names in os.walk(tmp_path) for f in names) <= 2
    assert sorted(documents.read_tools(spark, str(tmp_path)).collect()) == sorted(tools.collect())
