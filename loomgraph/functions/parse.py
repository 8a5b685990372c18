"""Answers of models taken apart: prefixes, code, requirements, tests, queries, thoughts; checks of code and JSON."""

from __future__ import annotations

import ast
import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .text import extract_json

#: What answers begin and end with (fixed values).
PREFIXES = ["Here's the", "Here is the", "The following is", "Below is the", "```json", "```python", "```"]
SUFFIXES = ["```", "Let me know if you need any modifications!", "Is there anything else you'd like me to help with?", "Feel free to ask if you have any questions!"]
#: Modules that need no requirement (fixed values).
STANDARD = ["json", "sys", "os", "datetime", "uuid", "copy", "typing", "pathlib", "re", "collections", "itertools"]
STRINGS = "array<string>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_response(text: Column) -> Column:
    """``text`` without the known beginnings and ends, each taken off at most once, in order, whatever their case."""
    out = stripped(text)
    for pattern in [rf"(?iu)^\Q{p}\E" for p in PREFIXES] + [rf"(?iu)\Q{s}\E$" for s in SUFFIXES]:
        out = stripped(F.regexp_replace(out, pattern, ""))
    return out


def loose_code(text: Column) -> Column:
    """What the first python fence holds, else the first fence of any kind, else the lines from the first ``def`` on, else all."""
    fence = lambda opening: stripped(F.regexp_extract(text, rf"(?s){opening}(.*?)```", 1))
    lines = F.regexp_extract(stripped(text), r"(?s)(?:^|\n)([ \t]*def .*)", 1)
    rest = F.coalesce(F.nullif(lines, F.lit("")), stripped(text))
    python, any_ = text.rlike(r"(?s)```python.*?```"), ~F.contains(text, F.lit("```python")) & text.rlike(r"(?s)```.*?```")
    return F.when(python, fence("```python")).when(any_, fence("```")).otherwise(rest)


def requirements(text: Column) -> Column:
    """Sorted packages: of a JSON list its items; where JSON is found that is no list, what lines install or import; else none."""
    found = extract_json(text)
    listed = F.when(F.startswith(found, F.lit("[")), F.from_json(found, STRINGS))
    line = lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")
    after = lambda l: F.filter(F.split(F.regexp_extract(line(l), r"(?i)(?:^|\s)install\s+(.*)$", 1), r"\s+"), lambda x: x != "")
    module = lambda l: F.regexp_extract(line(l), r"import (\w+)", 1)
    of = lambda l: F.when(F.contains(F.lower(l), F.lit("pip install")), after(l)).when(line(l).rlike(r"^(import|from) .*import |^import ") & ~module(l).isin(*STANDARD), F.array(module(l))).otherwise(F.array().cast(STRINGS))
    scanned = F.flatten(F.transform(F.split(text, "\n"), of))
    return F.array_sort(F.array_distinct(F.coalesce(listed, F.when(found.isNotNull(), scanned), F.array().cast(STRINGS))))


def code_requirements_tests(text: Column) -> Column:
    """struct(code, requirements, tests): the first python fence, and the last json fence that is a list of strings, and of tests."""
    code = F.nullif(stripped(F.regexp_extract(text, r"(?s)```python\n(.*?)\n```", 1)), F.lit(""))
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\n(.*?)\n```"), F.lit(1))
    lists = F.filter(blocks, lambda b: F.startswith(stripped(b), F.lit("[")) & F.try_parse_json(b).isNotNull())
    items = lambda b: F.from_json(b, STRINGS)
    is_object = lambda x: F.startswith(x, F.lit("{"))
    names = F.filter(lists, lambda b: F.forall(items(b), lambda x: ~is_object(x) & ~F.startswith(x, F.lit("["))))
    test = lambda b: F.forall(items(b), lambda x: is_object(x) & F.get_json_object(x, "$.test_id").isNotNull()) | F.get_json_object(F.get(items(b), F.lit(0)), "$.parameters").isNotNull()
    tests = F.filter(lists, lambda b: (F.size(items(b)) > 0) & F.coalesce(test(b), F.lit(False)))
    last = lambda a: F.when(F.size(a) > 0, items(F.element_at(a, -1)))
    return F.struct(code.alias("code"), last(names).alias("requirements"), last(tests).alias("tests"))


def user_queries(text: Column) -> Column:
    """array of struct(node_id, user_query): of the JSON in the first fence or the whole text, else of the pairs a pattern finds."""
    kind = "array<struct<node_id:string,user_query:string>>"
    fence = F.nullif(F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.lit(""))
    body = F.coalesce(fence, text)
    parsed = F.when(F.try_parse_json(body).isNotNull(), F.coalesce(F.from_json(F.get_json_object(body, "$.queries"), kind), F.when(F.startswith(stripped(body), F.lit("[")), F.from_json(body, kind))))
    pattern = r'(?s)"node_id"\s*:\s*"([^"]*)".*?"user_query"\s*:\s*"([^"]*)"'
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("node_id"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("user_query"))
    return F.coalesce(parsed, pairs)


def thought(text: Column) -> Column:
    """struct(thought, rest) of a text with a thought in tags."""
    inner = F.nullif(stripped(F.regexp_extract(text, r"(?s)<thought>(.*?)</thought>", 1)), F.lit(""))
    return F.struct(inner.alias("thought"), stripped(F.regexp_replace(text, r"(?s)^.*?</thought>", "")).alias("rest"))


def observation(message: Column, results: Column) -> Column:
    """Text of test results, an array of struct(parameters, success, result, error)."""
    said = lambda r: F.when(r["success"], F.concat(F.lit("  Result: "), F.coalesce(r["result"], F.lit("{}")))).otherwise(F.concat(F.lit("  Error: "), F.coalesce(r["error"], F.lit("Unknown error"))))
    one = lambda r, i: F.concat(F.lit("\nTest "), (i + 1).cast("string"), F.lit(":\n  Parameters: "), F.coalesce(r["parameters"], F.lit("{}")), F.lit("\n"), said(r), F.lit("\n"))
    return F.concat(F.lit("Message: "), message, F.lit("\n\nIndividual Test Results:\n"), F.array_join(F.transform(results, one), ""))


def has_keys(text: Column, keys: list[str]) -> Column:
    """Whether a text is JSON, and an object with all of ``keys`` if there are any."""
    good = F.try_parse_json(text).isNotNull()
    if not keys:
        return good
    some = F.array(*map(F.lit, keys))
    return good & F.coalesce(F.size(F.array_except(some, F.coalesce(F.json_object_keys(F.when(good, text)), F.array().cast(STRINGS)))) == 0, F.lit(False))


def coerced(result: Column) -> Column:
    """A tool's result as a JSON object: other JSON under ``tool_result``, other text under ``raw_result``."""
    good = F.try_parse_json(result).isNotNull()
    wrapped = F.concat(F.lit('{"tool_result":'), result, F.lit("}"))
    return F.when(good & F.startswith(stripped(result), F.lit("{")), result).when(good, wrapped).otherwise(F.to_json(F.struct(result.alias("raw_result"))))


@F.pandas_udf(StringType())
def code_fault(code: pd.Series, name: pd.Series) -> pd.Series:
    """Why a tool's code won't do: ``syntax`` or ``no function``; null if it will. Code is parsed, never run."""

    def fault(c: str | None, n: str) -> str | None:
        try:
            ast.parse(c or "")
        except (SyntaxError, ValueError, RecursionError):
            return "syntax"
        return None if f"def {n}" in (c or "") else "no function"

    return pd.Series([fault(c, n) for c, n in zip(code, name)])


@F.pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("code", StringType())])))
def functions_of(code: pd.Series) -> pd.Series:
    """The top-level functions of a source text, in order; none if it doesn't parse."""

    def parts(c: str | None) -> list[dict]:
        try:
            tree = ast.parse(c or "")
        except (SyntaxError, ValueError, RecursionError):
            return []
        return [{"name": f.name, "code": ast.get_source_segment(c, f)} for f in tree.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]

    return code.map(parts)


@F.pandas_udf(DoubleType())
def text_ratio(new: pd.Series, kept: pd.Series) -> pd.Series:
    """Twice the matched characters over all (longest matching block first, then on both sides); not symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(new, kept)], dtype=float)


def without_keys(text: Column, *keys: str) -> Column:
    """A JSON object without some of its keys, the others in order (keys of objects inside them sorted); null if it is none."""
    kept = F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, v: ~k.isin(*keys))
    return F.to_json(kept)
