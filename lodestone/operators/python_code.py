"""Python sources as tables: chunks, symbols, calls, definitions and uses, asynchronous patterns.

A file is parsed once for each kind of row asked for. Files that don't parse, or are nested too deep, have no rows but one
of kind ``failed``.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

KINDS = {
    "chunks": "path string, name string, node_type string, start_line int, end_line int, parent_class string, params array<string>, decorators array<string>",
    "symbols": "path string, fqn string, name string, kind string, scope string, line int, end_line int, type_hint string, is_private boolean",
    "calls": "path string, caller string, callee string, line int",
    "dataflow": "path string, func string, var string, line int, role string, type string",
    "async": "path string, pattern string, name string, line int",
    "bases": "path string, scope string, base string, ord int",
    "call_sites": "path string, func string, callee string, line int, ord int, args array<string>, keywords array<struct<name: string,expr: string>>, assigned_to string",
    "returns": "path string, func string, line int, expr string",
    "failed": "path string, error string",
}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
# Callees that are no functions of a repository.
BUILTINS = frozenset(
    """print len range str int float list dict set tuple open close read write append extend strip split join format upper
    lower startswith endswith replace find count items keys values get pop update clear sort reverse enumerate zip map
    filter sum min max abs round isinstance hasattr getattr setattr callable type super compile dump load loads dumps json
    findall search remove insert copy deepcopy randint randn squeeze tanh matmul reduce_sum softmax expand_dims
    generate_content render_template""".split()
)
_FORMS = {ast.List: "list", ast.Dict: "dict", ast.Set: "set", ast.Tuple: "tuple"}


def _name(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _type(node: ast.AST | None) -> str | None:
    """Of an expression; truth values count as int, as a bool is one."""
    if isinstance(node, ast.Constant):
        v = node.value
        return "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str" if isinstance(v, str) else "None" if v is None else None
    return _name(node.func) if isinstance(node, ast.Call) else _FORMS.get(type(node))


def _scoped(tree: ast.AST) -> Iterator[tuple]:
    """(node, scopes, classes, function) in source order, by a stack: depth is bounded by memory alone."""
    todo = [(n, ("global",), (), None) for n in reversed(list(ast.iter_child_nodes(tree)))]
    while todo:
        node, scopes, classes, func = todo.pop()
        yield node, scopes, classes, func
        if isinstance(node, ast.ClassDef):
            inner = ((*scopes, node.name), (*classes, node.name), func)
        elif isinstance(node, _DEFS):
            inner = ((*scopes, node.name), classes, node.name)
        else:
            inner = (scopes, classes, func)
        todo += [(n, *inner) for n in reversed(list(ast.iter_child_nodes(node)))]


def _chunks(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, _, classes, _ in _scoped(tree):
        if isinstance(node, (*_DEFS, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            params = [] if isinstance(node, ast.ClassDef) else [a.arg for a in node.args.args]
            yield path, node.name, kind, node.lineno, node.end_lineno, classes[-1] if classes else None, params, [ast.unparse(d) for d in node.decorator_list]


def _symbols(path: str, tree: ast.Module) -> Iterator[tuple]:
    def row(name, kind, scopes, node, hint=None):
        scope = ":".join((path, *scopes))
        return path, f"{path}:{scope}:{name}", name, kind, scope, node.lineno, node.end_lineno, hint, name.startswith("_")

    for node, scopes, _, _ in _scoped(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                yield row(a.asname or a.name, "import", scopes, node)
        elif isinstance(node, ast.ClassDef):
            yield row(node.name, "class", scopes, node)
        elif isinstance(node, _DEFS):
            outer = scopes[-2] if len(scopes) > 1 else path  # the kind follows the scope one further out
            yield row(node.name, "method" if outer != "global" else "function", scopes, node, ast.unparse(node.returns) if node.returns else None)
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                for n in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                    if isinstance(n, ast.Name):
                        yield row(n.id, "variable", scopes, node, _type(node.value))
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            yield row(node.target.id, "variable", scopes, node, ast.unparse(node.annotation))


def _calls(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, _, _, func in _scoped(tree):
        if isinstance(node, ast.Call) and func and (callee := _name(node.func)) and callee not in BUILTINS:
            yield path, func, callee, node.lineno


def _dataflow(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, _, _, func in _scoped(tree):
        if isinstance(node, _DEFS):
            for a in node.args.args:
                yield path, node.name, a.arg, node.lineno, "parameter", ast.unparse(a.annotation) if a.annotation else None
        elif func and isinstance(node, ast.Assign):
            for t in node.targets:
                for n in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                    if isinstance(n, ast.Name):
                        yield path, func, n.id, node.lineno, "definition", _type(node.value)
        elif func and isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            yield path, func, node.id, node.lineno, "use", None


def _async(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, _, _, func in _scoped(tree):
        if isinstance(node, ast.AsyncFunctionDef):
            yield path, "async_function", node.name, node.lineno
        elif isinstance(node, ast.Await):
            yield path, "await", func or "<module>", node.lineno
        elif isinstance(node, ast.Call) and (n := _name(node.func)):
            if n in ("create_task", "Thread"):
                yield path, n, func or "<module>", node.lineno
            elif any(w in n for w in ("delay", "apply_async", "enqueue", "submit")):
                yield path, "dispatch", n, node.lineno


def _bases(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, scopes, _, _ in _scoped(tree):
        if isinstance(node, ast.ClassDef):
            for k, b in enumerate(node.bases):
                if name := _name(b):
                    yield path, ":".join((path, *scopes, node.name)), name, k


def _call_sites(path: str, tree: ast.Module) -> Iterator[tuple]:
    targets = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
            targets |= {id(c): node.targets[0].id for c in ast.walk(node.value) if isinstance(c, ast.Call)}
    k = 0
    for node, _, _, func in _scoped(tree):
        if isinstance(node, ast.Call) and func and (callee := _name(node.func)):
            yield path, func, callee, node.lineno, k, [ast.unparse(a) for a in node.args], [(w.arg, ast.unparse(w.value)) for w in node.keywords if w.arg], targets.get(id(node))
            k += 1


def _returns(path: str, tree: ast.Module) -> Iterator[tuple]:
    for node, _, _, func in _scoped(tree):
        if isinstance(node, ast.Return) and func and node.value is not None:
            yield path, func, node.lineno, ast.unparse(node.value)


_ROWS = {"chunks": _chunks, "symbols": _symbols, "calls": _calls, "dataflow": _dataflow, "async": _async, "bases": _bases, "call_sites": _call_sites, "returns": _returns}


def _rows(kind: str) -> Callable:
    columns = [c.split()[0] for c in KINDS[kind].split(", ")]

    def f(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[tuple] = []
            for path, content in zip(part["path"], part["content"], strict=True):
                tree, why = _parsed(content)
                if kind == "failed":
                    out += [(path, why)] if tree is None else []
                elif tree is not None:
                    try:
                        out += list(_ROWS[kind](path, tree))
                    except RecursionError:  # only in printing an expression; its file is in ``failed``
                        continue
            yield pd.DataFrame(out, columns=columns)

    return f


def _parsed(content: str | None) -> tuple[ast.Module | None, str | None]:
    try:
        tree = ast.parse(content or "")
        for node in ast.walk(tree):  # what the extractors print must be printable
            if isinstance(node, (ast.Return, ast.Call)):
                ast.unparse(node)
        return tree, None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, type(e).__name__


def extract(files: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind (see KINDS) from ``files`` (path, content). ``failed`` lists the files that have none, and why."""
    return files.select("path", "content").mapInPandas(_rows(kind), KINDS[kind])


FIXTURE = {
    "app/main.py": "import asyncio\nfrom app.util import load as fetch\n\n\nclass Base:\n    size: int = 3\n\n    def run(self, n):\n        a, b = n, True\n        return fetch(a)\n\n\nasync def main(path: str) -> None:\n    flag = True\n    task = asyncio.create_task(work(path))\n    await task\n    print(flag)\n",
    "app/util.py": "def load(x):\n    def inner(y):\n        return y + x\n    return inner(x)\n\n\ndef _hidden():\n    total = 0\n    for i in range(3):\n        total = total + load(i)\n    return total\n",
    "app/broken.py": "def (:\n",
}


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIXTURE.items()), "path string, content string")
