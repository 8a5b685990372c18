"""Call logs and messages: reports, state snapshots, sessions, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validation_report(calls: DataFrame) -> DataFrame:
    """(episode, total, passed, failed, success_rate)"""
    r = calls.groupBy("episode").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
    return r.withColumn("success_rate", F.round(100.0 * F.col("passed") / F.col("total"), 2))


def named_report(calls: DataFrame) -> DataFrame:
    """One row: total, passed, failed, success_rate (0 of no tools) and the failed tools in order; a tool passes if all its calls do.
    Tools are few next to calls: one name each."""
    t = calls.groupBy("tool").agg(F.bool_and("ok").alias("ok"))
    names = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("tool"))))
    r = t.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), names.alias("failed_tools"))
    return r.withColumn("success_rate", F.when(F.col("total") > 0, F.round(100.0 * F.col("passed") / F.col("total"), 2)).otherwise(0.0))


def batch_summary(calls: DataFrame) -> DataFrame:
    """One row: total, successful and failed episodes. An episode succeeds if all its calls do."""
    e = calls.groupBy("episode").agg(F.bool_and("ok").alias("ok"))
    return e.agg(F.count("*").alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"))


def failed_episodes(calls: DataFrame) -> DataFrame:
    """(episode, n_failed) of episodes in which a call failed: a row each, as there may be very many."""
    return calls.groupBy("episode").agg(F.count_if(~F.col("ok")).alias("n_failed")).where("n_failed > 0")


def state_hashes(calls: DataFrame) -> DataFrame:
    """(episode, state_hash): SHA-256 of an episode's state, written as tool:calls:amount of its successful calls, tools in order.
    Amounts count ten-thousandths, so that the order of addition doesn't matter."""
    part = calls.where("ok").groupBy("episode", "tool").agg(F.count("*").alias("n"), F.sum(F.round(F.col("amount") * 10000).cast("long")).alias("units"))
    state = F.array_sort(F.collect_list(F.struct("tool", "n", "units")))
    text = F.array_join(F.transform(state, lambda x: F.concat_ws(":", x["tool"], x["n"].cast("string"), x["units"].cast("string"))), ",")
    return part.groupBy("episode").agg(F.sha2(text, 256).alias("state_hash"))


def state_snapshots(calls: DataFrame) -> DataFrame:
    """(episode, seq, snapshot_id, state): the running sum of amounts of successful calls after each call."""
    w = Window.partitionBy("episode").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return calls.select("episode", "seq", F.row_number().over(Window.partitionBy("episode").orderBy("seq")).cast("long").alias("snapshot_id"), F.round(F.sum(F.when(F.col("ok"), F.col("amount")).otherwise(0.0)).over(w), 4).alias("state"))


def final_state(calls: DataFrame) -> DataFrame:
    """(episode, n_calls, n_committed, state)"""
    return calls.groupBy("episode").agg(F.count("*").alias("n_calls"), F.count_if("ok").alias("n_committed"), F.round(F.sum(F.when(F.col("ok"), F.col("amount")).otherwise(0.0)), 4).alias("state"))


def tumbling(calls: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start_us, tool, n, amount) of each window."""
    r = calls.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), "tool").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("amount"))
    return r.select(F.unix_micros("w.start").alias("start_us"), "tool", "n", "amount")


def sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(episode, start_us, n) of each session."""
    r = calls.groupBy(F.session_window(F.col("ts").cast("timestamp"), gap).alias("w"), "episode").agg(F.count("*").alias("n"))
    return r.select("episode", F.unix_micros("w.start").alias("start_us"), "n")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): matched, missing (only left) or extra (only right)."""
    l, r = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra").otherwise("matched")
    return l.join(r, key, "full_outer").select(key, status.alias("status"))


def refinement_summary(tools: DataFrame) -> DataFrame:
    """One row of tools(domain, passed): total, passed and failed tools, domains, and those of which all tools passed."""
    d = tools.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("passed").alias("ok"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return d.agg(zero(F.col("n")).alias("total"), zero(F.col("ok")).alias("passed"), zero(F.col("n") - F.col("ok")).alias("failed"), F.count("*").alias("domains"), F.count_if(F.col("n") == F.col("ok")).alias("whole_domains"))


def first_of_each(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key. Spark keeps that many of a key in each task before it deals rows by key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
