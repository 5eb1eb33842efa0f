"""File metrics by language, names, patterns, and the sinks."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import file_stats
from lodestone.sources import sinks

PY = '"""Doc."""\nimport os\nfrom app.x import y\n\n# note\nclass A:\n    def f(self):\n        """Doc."""\n        if self and y:\n            return 1\n        return 2\n\ndef g():\n    pass\n'
C = '#include "a.h"\n#include <b.h>\n/* top\n * more\n */\nint f(int x) {\n  // note\n  return x ? 1 : 2;\n}\n\nstruct S {\n};'


@pytest.fixture(scope="module")
def measured(spark):
    files = [("a.py", PY), ("b.c", C), ("c.go", 'import "fmt"\nfunc main() {\n}\n'), ("d.rs", None), ("e.txt", "no"), ("f.js", 'import x from "./y"\nimport z from "react"\nasync function f() {\n  if (a && b) { c() }\n}\n')]
    return {r.path: r for r in file_stats.metrics(spark.createDataFrame(files, "path string, content string")).collect()}


def test_python_metrics(measured):
    r = measured["a.py"]
    assert (r.loc, r.loc_blank, r.num_functions, r.num_classes, r.num_imports, r.fan_out) == (15, 3, 2, 1, 2, 1)
    assert r.loc_code == 11 and r.has_docstring and r.docstring_coverage == 50
    assert r.cyclomatic_complexity == 3
    # the one-line docstring switches the comment on until the next triple quotes
    assert r.loc_comment == 8
    assert r.average_function_length == (5 + 2) / 2  # a line feed before the next def leaves an empty last line


def test_other_languages(measured):
    assert set(measured) == {"a.py", "b.c", "c.go", "d.rs", "f.js"}
    r = measured["b.c"]
    assert (r.language, r.loc, r.loc_blank, r.loc_comment, r.num_imports, r.fan_out, r.num_classes, r.num_functions) == ("c", 12, 1, 4, 2, 1, 1, 1)
    assert r.loc_code == 7 and r.cyclomatic_complexity == 2 and r.average_function_length == 4
    assert (measured["c.go"].num_functions, measured["c.go"].fan_out, measured["c.go"].average_function_length) == (1, 1, 0)
    assert (measured["d.rs"].loc, measured["d.rs"].loc_code, measured["d.rs"].cyclomatic_complexity) == (1, 0, 1)
    assert (measured["f.js"].fan_out, measured["f.js"].cyclomatic_complexity, measured["f.js"].num_functions) == (1, 3, 1)


def test_names_and_patterns(spark):
    s = spark.createDataFrame([("goodName", "function", "python", None), ("goodName", "method", "java", True), ("_Hidden", "function", None, None), ("bad_class", "class", "go", None), ("Fine", "class", None, None), ("x", "variable", None, None), (None, "class", None, None)], "name string, kind string, language string, is_static boolean")
    got = sorted(tuple(r) for r in file_stats.naming_violations(s).collect())
    assert got == [("bad_class", "go", "class", "PascalCase", "other"), ("goodName", "python", "function", "snake_case", "camelCase")]
    p = spark.createDataFrame([("Pool", "class", False), ("Pool:__init__", "method", False), ("Pool:getInstance", "method", True), ("make_pool", "function", True), ("make_other", "function", None), ("subscribe", "function", None), ("notify_all", "function", None)], "name string, kind string, is_static boolean")
    assert {r.pattern: r.symbols for r in file_stats.design_patterns(p).collect()} == {"Singleton": 1, "Factory": 1, "Observer": 2}
    assert file_stats.design_patterns(p.where("FALSE")).count() == 0


def test_artefacts(spark, tmp_path):
    a = sinks.Artefacts(spark, str(tmp_path / "store"))
    assert a.repos() == [] and a.load("r", "edges") is None
    a.save("r", "edges", spark.range(3))
    a.save("r", "edges", a.load("r", "edges").where("id > 0"))
    a.save("r", "nodes", spark.range(1))
    assert a.load("r", "edges").count() == 2 and a.repos() == ["r"] and a.kinds("r") == ["edges", "nodes"]
    assert a.delete("r", "edges") == 1 and not a.exists("r", "edges") and a.delete("none") == 0
    with pytest.raises(ValueError):
        a.exists("..", "x")


def test_graph_and_report(spark, tmp_path):
    n, e = spark.createDataFrame([("a", 1)], "id string, line int"), spark.createDataFrame([], "src string, dst string")
    sinks.write_graph(n, e, str(tmp_path / "g"))
    m, f = sinks.read_graph(spark, str(tmp_path / "g"), n.schema, e.schema)
    assert [tuple(r) for r in m.collect()] == [("a", 1)] and f.count() == 0 and f.columns == ["src", "dst"]
    s = spark.createDataFrame([("God File", "b.py", "low", "high", ["split"]), ("Coupling", "a.py", "High", "low", None)], "smell string, file string, priority string, effort string, strategies array<string>")
    sinks.write_report(s, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect()]
    assert lines[:3] == ["# Refactoring suggestions", "Total: 2", "- High priority: 1"] and [x.split()[1] for x in lines[5:]] == ["Coupling", "God"]
    assert spark.read.option("header", True).csv(str(tmp_path / "r/csv")).count() == 2
