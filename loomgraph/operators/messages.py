"""Messages of conversations: what is remembered after resets, and histories in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MARKER

CHUNK = 4096


def _running(rows: DataFrame, key: str, order: list[str], value: Column, name: str, chunk: int) -> DataFrame:
    """``rows`` with the running sum of ``value`` along ``order`` (the first of it a number) of each ``key``: summed within
    chunks and over chunks, so that no task holds a conversation of very many messages whole."""
    r = rows.withColumn("_v", value).withColumn("_c", F.floor(F.col(order[0]) / chunk))
    each = r.groupBy(key, "_c").agg(F.sum("_v").alias("_s"))
    before = each.select(key, "_c", (F.sum("_s").over(Window.partitionBy(key).orderBy("_c")) - F.col("_s")).alias("_b"))  # a row a chunk
    inner = F.sum("_v").over(Window.partitionBy(key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return r.withColumn("_i", inner).join(before, [key, "_c"]).withColumn(name, (F.col("_b") + F.col("_i")).cast("long")).drop("_v", "_c", "_i", "_b")


def memory(messages: DataFrame, reset: str = "system", chunk: int = CHUNK) -> DataFrame:
    """(conv, pos, segment, place, role, content, current) of messages(conv, pos, role, content), pos telling their order.

    A message in the role ``reset`` clears the memory and is the first of a new segment; what comes before the first is segment
    0. Places count from 1 in each segment; the last segment of a conversation is what it remembers. Messages of no conversation go."""
    m = messages.select("conv", "pos", "role", "content")
    m = _running(m, "conv", ["pos"], F.when(F.col("role") == reset, 1).otherwise(0), "segment", chunk)
    m = _running(m, "conv", ["pos"], F.lit(1), "n", chunk)
    parts = m.groupBy("conv", "segment").agg(F.min("n").alias("first"))
    last = parts.groupBy("conv").agg(F.max("segment").alias("last"))
    # a conversation has as many parts as resets, far fewer than messages
    m = m.join(parts, ["conv", "segment"]).join(last, "conv")
    return m.select("conv", "pos", "segment", (F.col("n") - F.col("first") + 1).alias("place"), "role", "content", (F.col("segment") == F.col("last")).alias("current"))


def _get(block: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(block, path), F.lit(""))


def _call(id_: Column, name: Column, arguments: Column) -> Column:
    """A call as JSON; arguments are JSON already."""
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.concat(F.lit('{"id":'), text(id_), F.lit(',"type":"function","function":{"name":'), text(name), F.lit(',"arguments":'), arguments, F.lit("}}"))


def _as_json(text: Column) -> Column:
    """JSON of arguments that were given as an object, or as text that holds one, or as other text."""
    said = F.to_json(F.array(text))
    return F.when(text.isNull(), "{}").when(F.try_parse_json(text).isNotNull(), text).otherwise(F.substring(said, F.lit(2), F.length(said) - 2))


def format_history(messages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, place, role, content, reasoning, tool_call_id, tool_calls) of messages(conv, pos, role, content, blocks), places from 0.

    ``blocks`` is the JSON list of a message that has one in place of a text. A user's text stays; of a user's blocks each tool
    result is a message of the role ``tool``. An assistant's blocks make one message: its last text, its last thought, and its
    calls in order. An assistant's text is cut at the mark of tool calls if a list of calls follows, else kept whole.
    ``tool_calls`` is a JSON list, null for none. Other roles, and user blocks without results, go."""
    m = messages.select("conv", "pos", "role", F.coalesce("content", F.lit("")).alias("content"), F.from_json("blocks", "array<string>").alias("bs"))
    text, none = F.col("bs").isNull(), F.lit(None).cast("string")
    kind = lambda k: F.filter("bs", lambda b: F.get_json_object(b, "$.type") == k)
    columns = lambda content, reasoning, call, calls: F.struct(content.alias("content"), reasoning.alias("reasoning"), call.alias("tool_call_id"), calls.alias("tool_calls"))

    user = m.where((F.col("role") == "user") & text).select("conv", "pos", F.lit(0).alias("sub"), "role", columns(F.col("content"), none, none, none).alias("r"))
    results = m.where((F.col("role") == "user") & ~text).select("conv", "pos", F.posexplode(kind("tool_result")).alias("sub", "b"))
    results = results.select("conv", "pos", "sub", F.lit("tool").alias("role"), columns(_get(F.col("b"), "$.content"), none, _get(F.col("b"), "$.tool_use_id"), none).alias("r"))

    last = lambda k, path: F.coalesce(F.element_at(F.transform(kind(k), lambda b: _get(b, path)), F.when(F.size(kind(k)) > 0, -1)), F.lit(""))
    used = F.transform(kind("tool_use"), lambda b: _call(_get(b, "$.tool_use.id"), _get(b, "$.tool_use.name"), F.coalesce(F.get_json_object(b, "$.tool_use.input"), F.lit("{}"))))
    listed = lambda calls: F.when(F.size(calls) > 0, F.concat(F.lit("["), F.array_join(calls, ","), F.lit("]")))
    merged = m.where((F.col("role") == "assistant") & ~text).select("conv", "pos", F.lit(0).alias("sub"), "role", columns(last("text", "$.text"), last("thinking", "$.thinking"), none, listed(used)).alias("r"))

    said = m.where((F.col("role") == "assistant") & text).withColumn("at", F.instr("content", MARKER))
    tail = F.trim(F.substring("content", F.col("at") + len(MARKER), F.length("content")))
    said = said.withColumn("calls", F.when((F.col("at") > 0) & F.try_parse_json(tail).isNotNull() & F.startswith(tail, F.lit("[")), F.from_json(tail, "array<string>")))
    made = F.transform("calls", lambda c: _call(_get(c, "$.id"), _get(c, "$.name"), _as_json(F.get_json_object(c, "$.arguments"))))
    clean = F.when(F.col("calls").isNotNull(), F.regexp_replace(F.substring("content", F.lit(1), F.col("at") - 1), r"^\s+|\s+$", "")).otherwise(F.col("content"))
    said = said.select("conv", "pos", F.lit(0).alias("sub"), "role", columns(clean, F.lit(""), none, listed(made)).alias("r"))

    every = user.unionAll(results).unionAll(merged).unionAll(said)
    every = _running(every, "conv", ["pos", "sub"], F.lit(1), "place", chunk)
    return every.select("conv", (F.col("place") - 1).alias("place"), "role", "r.*")
