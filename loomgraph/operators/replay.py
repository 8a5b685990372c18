"""Replay of events through user functions, and checks of tools by tests.

A tool is a Python function ``tool(data, **parameters) -> result`` that may change ``data``. Tools come from a registry of
vetted functions; stored code is never run."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tools:
    """Functions by name."""

    def __init__(self):
        self.by_name: dict[str, Callable] = {}

    def register(self, name: str, function: Callable) -> Tools:
        self.by_name[name] = function
        return self

    def run(self, name: str, state: dict, parameters: dict) -> tuple[bool, object, dict]:
        """(success, result or error, state): on a copy of ``state``, which stays as it was if the tool fails."""
        own = copy.deepcopy(state)
        try:
            result = self.by_name[name](own, **parameters)
        except Exception as e:  # whatever a tool raises is its result
            return False, f"{type(e).__name__}: {e}", state
        if isinstance(result, str):
            try:
                result = json.loads(result)
            except ValueError:
                result = {"raw_result": result}
        return True, result if isinstance(result, dict) else {"tool_result": result}, own


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def replay(events: DataFrame, tools: Tools, initial: dict, rounds: int | None = None) -> DataFrame:
    """(episode, seq, snapshot_id, success, result, state) of events(episode, seq, tool, args): snapshot 0 is the initial state, and
    each event, in order, adds one; failed calls leave the state alone. ``rounds`` bounds the events of an episode."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = copy.deepcopy(initial), []
        episode = rows["episode"].iloc[0]
        out.append((episode, None, 0, True, None, canonical(state)))
        for k, r in enumerate(rows.sort_values("seq").head(rounds if rounds is not None else len(rows)).itertuples(), 1):
            ok, result, state = tools.run(r.tool, state, json.loads(r.args) if r.args else {})
            out.append((episode, r.seq, k, ok, result if isinstance(result, str) else canonical(result), canonical(state)))
        return pd.DataFrame(out, columns=["episode", "seq", "snapshot_id", "success", "result", "state"]).astype({"seq": "Int64"})

    return events.select("episode", "seq", "tool", "args").groupBy("episode").applyInPandas(run, "episode long, seq long, snapshot_id long, success boolean, result string, state string")


def run_tests(tests: DataFrame, tools: Tools, initial: dict) -> DataFrame:
    """(tool, test_id, success, result) of tests(tool, test_id, parameters): each from the same initial state."""

    def run(batches):
        for rows in batches:
            got = [tools.run(r.tool, initial, json.loads(r.parameters) if r.parameters else {}) for r in rows.itertuples()]
            yield rows[["tool", "test_id"]].assign(success=[g[0] for g in got], result=[g[1] if isinstance(g[1], str) else canonical(g[1]) for g in got])

    return tests.select("tool", "test_id", "parameters").mapInPandas(run, "tool string, test_id string, success boolean, result string")


def tool_verdicts(tools: DataFrame, results: DataFrame) -> DataFrame:
    """(tool, n_tests, passed): tools without tests count as passed."""
    r = results.groupBy("tool").agg(F.count("*").alias("n"), F.bool_and("success").alias("ok"))
    return tools.select("tool").join(r, "tool", "left").select("tool", F.coalesce("n", F.lit(0)).cast("long").alias("n_tests"), F.coalesce("ok", F.lit(True)).alias("passed"))


def repaired(tests: DataFrame, attempts: list[Tools], initial: dict) -> tuple[int, DataFrame]:
    """(attempt, results): the first of bounded attempts at the tools whose tests all pass, else the last. Success is what tests say."""
    results = None
    for k, tools in enumerate(attempts):
        results = run_tests(tests, tools, initial)
        if results.where(~F.col("success")).isEmpty():
            return k, results
    return len(attempts) - 1, results


def repair_rounds(tests: DataFrame, attempts: list[Tools], initial: dict, table) -> DataFrame:
    """(tool, n_tests, n_failed, last_round): each attempt runs the tests that failed in all before it, until none is left;
    n_failed counts those that no attempt passes, last_round is the last in which a test of the tool ran."""
    n = tests.groupBy("tool").agg(F.count("*").alias("n_tests"))
    left, ran = tests.select("tool", "test_id", "parameters"), None
    for k, tools in enumerate(attempts):
        r = table(run_tests(left, tools, initial).select("tool", "test_id", "success").join(left, ["tool", "test_id"]))
        now = r.groupBy("tool").agg(F.count_if(~F.col("success")).alias("n_failed")).withColumn("last_round", F.lit(k).cast("long"))
        ran = now if ran is None else ran.unionAll(now)
        left = r.where("not success").select("tool", "test_id", "parameters")
        if left.isEmpty():
            break
    last = ran.groupBy("tool").agg(F.max_by("n_failed", "last_round").alias("n_failed"), F.max("last_round").alias("last_round"))
    return n.join(last, "tool").select("tool", "n_tests", "n_failed", "last_round")


def register_table_function(spark, name: str, tools: Tools, initial: dict) -> None:
    """Make tools a table function of SQL: ``name``(TABLE(tests) PARTITION BY tool) gives (tool, test_id, success, message, results)
    for each row (tool, test_id, parameters) of the table, every one from the same initial state."""

    class Run:
        def eval(self, row):
            ok, got, _ = tools.run(row["tool"], initial, json.loads(row["parameters"]) if row["parameters"] else {})
            yield row["tool"], row["test_id"], ok, None if ok else got, canonical(got) if ok else None

    spark.udtf.register(name, F.udtf(Run, returnType="tool string, test_id string, success boolean, message string, results string"))
