"""Health, contributors, resolution, scans and extractors on literal inputs: nulls, empties, ties, odd files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import contributors, graph, health, python_code, resolution
from lodestone.sources import files

METRICS = "path string, loc int, loc_code int, loc_comment int, num_functions int, num_classes int, cyclomatic_complexity int, average_function_length double, docstring_coverage double, fan_out int"


@pytest.fixture(scope="module")
def measured(spark):
    rows = [("a/x.py", 1000, 800, 80, 12, 2, 18, 60.0, 10.0, 6), ("a/y.py", 50, 40, 4, 2, 0, 3, 10.0, 100.0, 1), ("b/z.py", 40, 30, 3, 1, 1, 2, 5.0, 80.0, 0), ("w.py", 10, 9, 0, 0, 0, 1, 0.0, 0.0, 1), ("v.py", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, METRICS)


def test_smells_of_files(measured):
    got = {(r.type, r.path): r.severity for r in health.smells(measured).collect()}
    assert got == {("God File", "a/x.py"): "medium", ("Long Functions", "a/x.py"): "medium", ("High Cyclomatic Complexity", "a/x.py"): "critical", ("Tight Coupling", "a/x.py"): "medium", ("Orphaned File", "b/z.py"): "medium", ("Orphaned File", "v.py"): "medium", ("Change Hotspot", "a/x.py"): "high"}
    first = health.ranked_suggestions(health.smells(measured), 1).first()
    assert (first.type, first.priority) == ("Change Hotspot", "high")
    god = health.suggestions(health.smells(measured)).where("type = 'God File'").first()
    assert god.strategies == ["Split by Class", "Split by Functionality", "Extract to Package"]


def test_health_of_nothing(measured):
    none = measured.limit(0)
    r = health.payload(none).first()
    assert (r.grade, r.overall_score, r.num_files, r.num_smells, r.suggestions, r.lowest_files) == ("N/A", 0.0, 0, 0, [], [])
    assert health.smells(none).count() == health.file_scores(none).count() == health.modules(none).count() == 0
    assert health.enhanced(none).first().score == 0 and health.enhanced(none).first().maintainability_index == 50
    assert health.trends(none).first().complexity_deviation == 0


def test_grades(spark):
    x = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (40.0,), (0.0,)], "s double").select(health.graded(F.col("s"))["grade"].alias("g"))
    assert [r.g for r in x.collect()] == ["A", "B", "B", "C", "D"]


def test_code_files_and_bots(spark):
    paths = ["src/a.py", "BUILD/a.py", "a/.github/x.yml", "Cargo.lock", "x.min.js", "a\\vendor\\b.py", "doc.md", "x.png", "", None]
    x = spark.createDataFrame([(p,) for p in paths], "p string").select(contributors.is_code(F.col("p")).alias("k"))
    assert [r.k for r in x.collect()] == [True, False, False, False, False, False, True, False, False, False]
    who = [("ci[bot]", "a@b"), ("x", "1+dependabot@users.noreply.github.com"), ("Ann", "ann@x.org"), (None, None)]
    y = spark.createDataFrame(who, "n string, m string").select(contributors.is_bot(F.col("n"), F.col("m")).alias("k"))
    assert [r.k for r in y.collect()] == [True, True, False, False]


def test_display_name_and_lookup(spark):
    x = spark.createDataFrame([(["u1", "Ann Lee"], "e"), (["u1"], "e"), ([], "e"), (None, "e")], "n array<string>, e string")
    assert [r[0] for r in x.select(contributors.display_name(F.col("n"), F.col("e"))).collect()] == ["Ann Lee", "u1", "e", "e"]
    m = spark.createDataFrame([("Ann Lee", ["ann@x"], 3), ("Bob", ["lee@x"], 9)], "name string, emails array<string>, commits long")
    assert contributors.find_author(m, "LEE").first().name == "Ann Lee" and contributors.find_author(m, "lee@x.org").first().name == "Bob"
    assert contributors.find_author(m, "zz").count() == 0


def test_scopes_and_attributes(spark):
    scopes = spark.createDataFrame([("f:global", None), ("f:global:A", "f:global"), ("f:global:A:run", "f:global:A")], "scope string, parent string")
    symbols = spark.createDataFrame([("f:global", "x", "g.x", "A", 1), ("f:global:A", "x", "A.x", None, 2), ("f:global", "y", "old", None, 3), ("f:global", "y", "new", "A", 4), ("f:global:A", "go", "A.go", None, 5)], "scope string, name string, fqn string, type_hint string, ord int")
    uses = spark.createDataFrame([(1, "f:global:A:run", "x", "go"), (2, "f:global:A:run", "y", "go"), (3, "f:global", "none", "go"), (4, "f:global", "x", "gone")], "use_id int, scope string, name string, attr string")
    got = {r.use_id: (r.fqn, r.distance) for r in resolution.lookup(uses, symbols, scopes).collect()}
    assert got == {1: ("A.x", 1), 2: ("new", 2), 3: (None, None), 4: ("g.x", 0)}
    assert {r.use_id: r.attr_fqn for r in resolution.attributes(uses, symbols, scopes).collect()} == {1: None, 2: "A.go", 3: None, 4: None}


def _most_joined(plan):
    """The most rows that a join of an executed plan gave."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _most_joined(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _most_joined(plan.plan())
    rows = plan.metrics().get("numOutputRows")
    below = [_most_joined(plan.children().apply(i)) for i in range(plan.children().size())]
    return max([rows.get().value() if "Join" in kind and rows.isDefined() else 0, *below])


def test_attributes_of_large_classes(spark):
    """A class whose attribute is defined by many symbols meets each use once."""
    n = 300
    scopes = spark.createDataFrame([("g", None)], "scope string, parent string")
    members = [("k:A", "go", f"A.{i}", None, i) for i in range(n)] + [("j:A", "go", "first", None, 1), ("j:A", "go", "last", None, 2), ("j:B", "go", "no", None, 9)]
    symbols = spark.createDataFrame([("g", "x", "x", "A", 1), *members], "scope string, name string, fqn string, type_hint string, ord int")
    uses = spark.createDataFrame([(i, "g", "x", "go") for i in range(n)], "use_id int, scope string, name string, attr string")
    out = resolution.attributes(uses, symbols, scopes)
    assert {r.use_id: r.attr_fqn for r in out.collect()} == dict.fromkeys(range(n), "last")
    assert _most_joined(out._jdf.queryExecution().executedPlan()) == n


def test_scopes_too_deep_are_refused(spark):
    deep = spark.createDataFrame([(f"s{i}", f"s{i - 1}") for i in range(1, 6)], "scope string, parent string")
    symbols = spark.createDataFrame([("s0", "x", "f", None, 1)], "scope string, name string, fqn string, type_hint string, ord int")
    uses = spark.createDataFrame([(1, "s5", "x")], "use_id int, scope string, name string")
    assert resolution.lookup(uses, symbols, deep).first().distance == 5
    with pytest.raises(ValueError, match="deeper"):
        resolution.lookup(uses, symbols, deep, levels=4)


def test_scan_and_archives(spark, tmp_path):
    top = tmp_path / "build" / "repo"  # a folder above the tree doesn't count
    for name in ("a.py", "vendor/b.py", "Out/c.py", "d.min.js", "Cargo.lock", "e.PY", "g.py"):
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("# DO NOT EDIT" if name == "g.py" else "x = 1\n")
    assert {r.path for r in files.tree(spark, str(top)).collect()} == {"a.py", "e.PY"}
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in ("r/a.py", "r/dist/b.py", "r/poetry.lock", "r/c.txt"):
            z.writestr(n, "x = 1\n")
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips/good.zip").write_bytes(b.getvalue())
    (tmp_path / "zips/bad.zip").write_bytes(b"no archive")
    got = {(r.path, r.error) for r in files.archives(spark, str(tmp_path / "zips")).collect()}
    assert got == {("a.py", None), (None, "BadZipFile")}


def test_odd_python_files(spark):
    deep = "def f():\n    return " + " + ".join(["x"] * 3000) + "\n"
    src = spark.createDataFrame([("deep.py", deep), ("bad.py", "def ("), ("ok.py", "def f():\n    print(g(1))\n"), ("null.py", None)], "path string, content string")
    calls = python_code.extract(src, "calls").collect()
    assert [(r.path, r.callee) for r in calls] == [("ok.py", "g")]
    failed = {r.path for r in python_code.extract(src, "failed").collect()}
    assert "bad.py" in failed and not failed & {"ok.py", "null.py"}
    for kind in python_code.KINDS:
        python_code.extract(src, kind).count()


def test_long_chain_has_no_cycle(spark):
    chain = spark.range(40).selectExpr("id AS src", "id + 1 AS dst")
    assert graph.cyclic(chain).count() == 0
    assert graph.cyclic(chain.unionByName(spark.createDataFrame([(100, 101), (101, 100)], "src long, dst long"))).count() == 2
