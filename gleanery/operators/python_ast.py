"""Findings that need Python's syntax tree: the one place where texts leave the JVM.

Only sources with a Python suffix get here; batches travel as Arrow.
"""

from __future__ import annotations

import ast
import math
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNSAFE_MODULES = {"pickle", "marshal", "shelve", "dill"}
PATH_WORDS = ("secret", "password", "key", "credential", "token")
NAME_WORDS = ("password", "secret", "key", "token", "apikey")
ARGUMENT_WORDS = {"password", "secret", "token", "key"}
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "EXEC")
COMMAND_WORDS = ("os.system", "subprocess", "popen", "exec")
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)

Finding = tuple[str, str, int, str]  # category, rule, line, detail


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def cyclomatic(node: ast.AST) -> int:
    """McCabe's number of a function or method, its nested functions included."""
    n = 1
    for x in ast.walk(node):
        if isinstance(x, BRANCHES):
            n += 1 + (len(x.ifs) if isinstance(x, ast.comprehension) else 0)
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.match_case):
            n += 1
    return n


def halstead_volume(tree: ast.AST) -> float:
    """(operators + operands) * log2 of the different ones, of all expressions."""
    operators: list[str] = []
    operands: list[str] = []
    for x in ast.walk(tree):
        if isinstance(x, (ast.BinOp, ast.UnaryOp, ast.AugAssign)):
            operators.append(type(x.op).__name__)
            held = [x.operand] if isinstance(x, ast.UnaryOp) else [x.left, x.right] if isinstance(x, ast.BinOp) else [x.target, x.value]
        elif isinstance(x, ast.BoolOp):
            operators.append(type(x.op).__name__)
            held = x.values
        elif isinstance(x, ast.Compare):
            operators += [type(o).__name__ for o in x.ops]
            held = [x.left, *x.comparators]
        else:
            continue
        operands += [ast.dump(h) for h in held]
    vocabulary = len(set(operators)) + len(set(operands))
    return (len(operators) + len(operands)) * math.log2(vocabulary) if vocabulary > 1 else 0.0


def maintainability(tree: ast.AST, source: str) -> float:
    """The maintainability index, 0 to 100, from volume, branches and lines of code."""
    lines = sum(1 for x in source.split("\n") if x.strip() and not x.strip().startswith("#"))
    volume, branches = halstead_volume(tree), cyclomatic(tree)
    if not lines or not volume:
        return 100.0
    return max(0.0, (171 - 5.2 * math.log(max(volume, 1.0)) - 0.23 * branches - 16.2 * math.log(lines)) * 100 / 171)


def _call(node: ast.Call) -> Iterator[tuple[str, str]]:
    f = node.func
    if isinstance(f, ast.Name):
        if f.id in ("eval", "exec"):
            yield "dangerous call", f.id
        path = _text(node.args[0]) if f.id == "open" and node.args else None
        if path is not None:
            if any(w in path.lower() for w in PATH_WORDS):
                yield "sensitive file", path
            mode = _text(node.args[1]) if len(node.args) > 1 else None
            if mode is not None and "w" in mode and path.startswith("/"):
                yield "write to absolute path", f"{path} {mode}"
    elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "subprocess":
        if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords):
            yield "subprocess with shell", f.attr


def inspect(source: str, max_complexity: int = 10, min_maintainability: float = 65.0) -> list[Finding]:
    """Findings of one source, distinct; a source that doesn't parse has one alone."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except SyntaxError as e:
        return [("code_quality", "syntax error", e.lineno or 0, "")]
    except (ValueError, RecursionError, MemoryError) as e:
        return [("code_quality", "syntax error", 0, type(e).__name__)]
    lines, out = source.split("\n"), {}

    def add(rule: str, line: int, detail: str, category: str = "security_smells") -> None:
        out[category, rule, line, detail] = None

    if (index := maintainability(tree, source)) < min_maintainability:
        add("low maintainability", 0, f"{index:.2f}", "code_quality")
    for node in ast.walk(tree):
        line = getattr(node, "lineno", 0)
        if isinstance(node, ast.Import):
            for a in node.names:
                if a.name in UNSAFE_MODULES:
                    add("dangerous import", line, a.name)
        elif isinstance(node, ast.Call):
            for rule, detail in _call(node):
                add(rule, line, detail)
        elif isinstance(node, ast.BinOp) and line <= len(lines):
            shown = lines[line - 1]
            if isinstance(node.op, ast.Mod) and any(w in shown.upper() for w in SQL_WORDS):
                add("SQL by formatting", line, shown.strip())
            if isinstance(node.op, ast.Add) and any(w in shown.lower() for w in COMMAND_WORDS):
                add("command by concatenation", line, shown.strip())
        elif isinstance(node, ast.Assign):
            value = _text(node.value)
            for t in node.targets:
                if isinstance(t, ast.Name) and value is not None and len(value) > 3 and any(w in t.id.lower() for w in NAME_WORDS):
                    add("hardcoded value", line, t.id)
        if isinstance(node, ast.FunctionDef):
            for a in node.args.args:
                if a.arg.lower() in ARGUMENT_WORDS and a.annotation is None:
                    add("sensitive parameter without type", line, f"{node.name}.{a.arg}")
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and (c := cyclomatic(node)) > max_complexity:
            add("high complexity", line, f"{node.name} {c}", "code_complexity")
    return list(out)


def python_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, category, rule, line, detail) of Python sources.

    With ``path_col`` only ``.py`` and ``.pyw`` files are read; without, every
    text is taken for Python.  Null texts find nothing.
    """
    kept = docs if path_col is None else docs.where(F.lower(docs[path_col]).rlike(r"\.pyw?$"))
    src = kept.select(kept[id_col].alias("id"), kept[text_col].alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["category", "rule", "line", "detail"]
        for b in batches:
            at: list[int] = []
            rows: list[Finding] = []
            for k, text in enumerate(b.column(1).to_pylist()):
                found = inspect(text)
                at += [k] * len(found)
                rows += found
            cols = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds))], ["id", *names])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, category string, rule string, line int, detail string")
