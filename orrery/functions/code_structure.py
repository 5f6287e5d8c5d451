"""Structure of a Python function, from its syntax tree alone; the source is parsed and never run."""

from __future__ import annotations

import ast
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("cyclomatic_complexity", "max_control_depth", "distinct_call_sites")
SCHEMA = ", ".join(f"{n}: double" for n in NAMES)
DYNAMIC = "<dynamic>"

_NESTED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_CONTROL = (ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_COMPREHENSION = (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)


@dataclass(frozen=True)
class CodeStructure:
    cyclomatic_complexity: float
    max_control_depth: float
    distinct_call_sites: float

    def as_array(self):
        return list(astuple(self))


def code_structure(source: str) -> CodeStructure:
    """Of the one top-level function in ``source``. Complexity counts branches, depth counts nested control blocks, and
    calls are told apart by the last name called. What nested functions, classes and lambdas hold doesn't count."""
    functions = [n for n in ast.parse(source).body if isinstance(n, _FUNCTION)]
    if len(functions) != 1:
        raise ValueError(f"one top-level function is needed, found {len(functions)}")
    branches, deepest, calls = 0, 0, set()
    # (node, control depth around it), worked off from the end; the order doesn't matter to the three measures
    todo: list[tuple[ast.AST, int]] = [(n, 0) for n in functions[0].body]

    def put(nodes, depth: int) -> None:
        todo.extend((n, depth) for n in nodes if n is not None)

    def block(depth: int) -> int:
        nonlocal deepest
        deepest = max(deepest, depth + 1)
        return depth + 1

    while todo:
        node, depth = todo.pop()
        if isinstance(node, _NESTED):
            continue
        if isinstance(node, ast.If):
            inner = block(depth)
            while True:  # an elif is on the level of its if
                branches += 1
                put([node.test, *node.body], inner)
                rest = node.orelse
                if not (len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset):
                    break
                node = rest[0]
            put(rest, inner)
        elif isinstance(node, _CONTROL):
            if isinstance(node, ast.For | ast.AsyncFor | ast.While):
                branches += 1
            elif isinstance(node, ast.Match):
                branches += max(0, len(node.cases) - 1)
            put(ast.iter_child_nodes(node), block(depth))
        elif isinstance(node, _COMPREHENSION):
            inner = depth
            for g in node.generators:
                branches += 1 + len(g.ifs)
                put([g.iter], inner)
                inner = block(inner)
                put([g.target, *g.ifs], inner)
            put([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt], inner)
        else:
            if isinstance(node, ast.ExceptHandler | ast.IfExp):
                branches += 1
            elif isinstance(node, ast.BoolOp):
                branches += len(node.values) - 1
            elif isinstance(node, ast.Call):
                f = node.func
                calls.add(f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else DYNAMIC)
            put(ast.iter_child_nodes(node), depth)
    return CodeStructure(float(1 + branches), float(deepest), float(len(calls)))


def _measure(source: str | None) -> tuple:
    try:
        return (*astuple(code_structure(source)), None)
    except (SyntaxError, ValueError, TypeError, RecursionError) as e:
        return (None, None, None, f"{type(e).__name__}: {e}")


def structure_column(source: Column) -> Column:
    """STRUCT of the three measures and ``error``, which is null where they could be taken."""

    @F.pandas_udf(f"struct<{SCHEMA}, error: string>")
    def measure(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_measure(s) for s in sources], columns=[*NAMES, "error"])

    return measure(source)
