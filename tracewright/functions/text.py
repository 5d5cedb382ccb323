"""Reading agent responses: tool calls, contents, planner messages."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json|python)?\s*(.*?)```", re.S)
#: Python builtins that texts call; they are no tools.
_BUILTINS = frozenset(dir(__builtins__) if not isinstance(__builtins__, dict) else __builtins__)


def response_content(response: Column) -> Column:
    """text of the first choice of a response in JSON, else ''."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit(""))


def tool_calls(response: Column) -> Column:
    """array of (name, arguments); arguments that are no JSON object become {}."""
    calls = F.from_json(F.get_json_object(response, "$.choices[0].message.tool_calls"), "array<struct<function:struct<name:string,arguments:string>>>")
    ok = lambda a: F.when(F.coalesce(F.try_parse_json(a).isNotNull() & F.startswith(F.trim(a), F.lit("{")), F.lit(False)), a).otherwise(F.lit("{}"))
    return F.transform(F.coalesce(calls, F.array().cast("array<struct<function:struct<name:string,arguments:string>>>")), lambda c: F.struct(c.function["name"].alias("name"), ok(c.function["arguments"]).alias("arguments")))


def planner_prompts(message: Column) -> Column:
    """the prompts of a planner's tasks joined by blanks."""
    tasks = F.from_json(message, "struct<worker_tasks:array<struct<prompt:string>>>")["worker_tasks"]
    return F.array_join(F.transform(F.coalesce(tasks, F.array().cast("array<struct<prompt:string>>")), lambda t: F.coalesce(t.prompt, F.lit(""))), " ")


def _named(value) -> str | None:
    if isinstance(value, dict):
        name = value.get("name") or value.get("tool") or (value.get("function") or {}).get("name") if isinstance(value.get("function"), (dict, type(None))) else value.get("name")
        return name if isinstance(name, str) else None
    return None


def _usable(name: str | None) -> bool:
    return bool(name) and "_" in name and name not in _BUILTINS


def tool_name_in(text: str | None) -> str | None:
    """A tool's name in a text: fenced JSON, then bare JSON, then a call in Python code."""
    text = text or ""
    fenced = [m.strip() for m in _FENCE.findall(text)]
    for part in [*fenced, text.strip()]:
        if part.startswith("{"):
            try:
                name = _named(json.loads(part))
            except ValueError:
                continue
            if _usable(name):
                return name
    for part in [*fenced, text]:
        try:
            tree = ast.parse(part)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
        for node in ast.walk(tree):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and _usable(node.func.id):
                return node.func.id
    return None


@F.pandas_udf(StringType())
def _parsed_name(text: pd.Series) -> pd.Series:
    return text.map(tool_name_in)


def tool_name(text: Column | str) -> Column:
    """a tool's name in a text. Where the first JSON object in a fence or the whole text names a tool plainly, that is found in the JVM; only
    the other texts (Python code needs a parser) meet Python."""
    text = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json|python)?\s*(.*?)```"), F.lit(1))
    parts = F.transform(F.concat(fenced, F.array(text)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    v = F.try_parse_json(F.get(F.filter(parts, lambda x: x.startswith("{")), F.lit(0)))
    plain = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    no_name = F.try_variant_get(v, "$.name", "variant").isNull() & F.try_variant_get(v, "$.function", "variant").isNull()
    name = F.coalesce(plain("$.name"), F.when(no_name, plain("$.tool")))
    usable = name.contains("_") & ~name.isin(*sorted(b for b in _BUILTINS if "_" in b))
    found = F.when(usable, name)
    return F.coalesce(found, _parsed_name(F.when(found.isNull(), text)))
