"""Questions, re-rankings, ordered walks and the knowledge graph on hand-made fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunks, graph, knowledge, python_code, questions, ranking


def rows(df):
    return sorted(tuple(r) for r in df.collect())


QUESTIONS = [
    ("Find the function parse_url", "find_function"),
    ("What type is Config", "find_class"),
    ("Where is parse_url used?", "find_usage"),
    ("which method invokes save", "find_caller"),
    ("show me the implementation of cache", "find_implementation"),
    ("find code pattern for retries", "find_pattern"),
    ("How does login work", "understand_flow"),
    ("What is the entry point?", "understand_startup"),
    ("Which part does the most work", "understand_business_logic"),
    ("core data structures", "understand_data_structures"),
    ("Any background jobs?", "understand_async"),
    ("what is similar to this", "find_similar"),
    ("hello", "custom"),
    ("", "custom"),
    (None, None),
]


def test_intents(spark):
    d = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(QUESTIONS)], "k int, q string")
    got = d.orderBy("k").select(questions.intent(F.col("q"))).collect()
    assert [r[0] for r in got] == [want for _, want in QUESTIONS]


def test_question_parts(spark):
    q = "Show the async function in file 'a/b.py' at line 42:\n```py\nx = 1\n```\nand `y`\n    z = 2\n      w"
    d = spark.createDataFrame([(1, q), (2, None)], "k int, q string").orderBy("k")
    c = F.col("q")
    one, none = d.select(questions.constraints(c).alias("c"), questions.snippets(c).alias("s"), questions.prose(c).alias("p"), questions.keywords(c).alias("w")).collect()
    assert tuple(one.c) == ("a/b.py", 42, "async", None, None)
    assert one.s == ["x = 1", "py\nx = 1\n", "\nand ", "z = 2\nw"]  # single backticks pair up across fences too
    assert "```" not in one.p and one.p.startswith("Show the async")
    assert one.w == ["async", "function", "show"]
    assert tuple(none.c) == (None,) * 5 and none.s == [] and none.p == "" and none.w == []


@pytest.mark.parametrize("q,want", [("javascript class in main.js", ("java", "class_definition", "js")), ("digital things", (None, None, None)), ("a category", ("go", None, None)), ("python function", ("python", "function_definition", None))])
def test_filters_find_substrings(spark, q, want):
    d = spark.createDataFrame([(q,)], "q string").select(questions.filters(F.col("q")).alias("f"))
    assert tuple(d.first().f) == want


def test_time_and_contributions(spark):
    d = spark.createDataFrame([("commits of the last 2 weeks",), ("in the last month",), ("what is static",), ("hello",), (None,)], "q string")
    got = d.select(questions.days_back(F.col("q")), questions.about_contributions(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(14, True), (30, False), (None, True), (None, False), (None, False)]


def test_question_symbols(spark):
    d = spark.createDataFrame([(1, "fetch_user in the long long long sentence of nothing"), (2, None)], "k int, q string")
    got = {r.name: r for r in questions.symbols(d, "k", "q").collect()}
    assert got["fetch_user"].is_primary and abs(got["fetch_user"].confidence - 1.0) < 1e-9
    assert not got["the"].is_primary and abs(got["the"].confidence - 0.7) < 1e-9


CHUNKS = "id int, distance double, path string, language string, node_type string, symbol_name string, parent_class string, params array<string>, decorators array<string>, imports array<string>, text string"


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame(
        [
            (1, 0.0, "app/views/user.py", "python", "function_definition", "load", None, ["a"], [], ["from x import y, z", "import os"], "async def load(a):\n    if a:\n        return db.get(a)\n    for k in a:\n        print (k)"),
            (2, 1.0, "lib/test_b.py", "go", "class_definition", "save", "Store", [], [], [], "import re\nclass Save: # TODO\n    pass"),
            (3, 1.0, None, None, None, None, None, None, None, None, None),
        ],
        CHUNKS,
    )


def test_hybrid(candidates):
    got = {r.id: round(r.score, 6) for r in ranking.hybrid(candidates, "python function load of user").collect()}
    # 1 + language .4 + node type .3 + symbol .6 + def .2 + a word in the path .2 + views .25
    assert got == {1: 2.95, 2: 0.5 + 0.2 + 0.15 + 0.05 + 0.15, 3: 0.5}


def test_features(candidates):
    got = {r.id: r.f for r in ranking.features(candidates).collect()}
    f = got[1]
    assert (f.is_async, f.is_method, f.conditionals, f.loops, f.returns, f.handles, f.params) == (True, False, 1, 1, 1, False, 1)
    assert set(f.imports) == {"x.y", "x.z", "os"} and set(f.calls) == {"load", "db.get", "print"}
    assert got[2].imports == ["re"] and got[2].is_method and got[3].name == "unknown" and got[3].calls == []


def test_unified_and_symbol_driven(spark, candidates):
    near = spark.createDataFrame([("load", 0), ("load", 2)], "symbol_name string, depth int")
    got = ranking.unified(candidates, candidates.where("id = 1"), ["load"], near, 3, "id").collect()
    assert got[0].id == 1 and abs(got[0].score - 1) < 1e-6 and len(got) == 3
    m = ranking.symbol_matches(candidates, ["loading", "of"])
    assert rows(m) == [("load", 1.0)]
    got = ranking.symbol_driven(candidates, m, near.where("FALSE"), "load user", 3, "id").collect()
    # 0.35 + 0.25 + 0.15 * (0.5 + 0.2 + 0.1 + 0.15) + 0.25
    assert (got[0].id, got[0].is_direct, round(got[0].score, 6)) == (1, True, 0.9925) and len(got) == 3
    assert ranking.unified(candidates.where("FALSE"), candidates, ["x"], near, 3, "id").count() == 0


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([("main", "a", "calls"), ("main", "b", "dataflow"), ("a", "c", "calls"), ("b", "c", "calls"), ("c", "db", "contains"), ("c", "main", "calls"), ("x", "y", "calls"), ("y", "x", "calls"), ("z", "y", "calls")], "src string, dst string, type string")


def named(spark, *x):
    return spark.createDataFrame([(v,) for v in x], "node string")


def test_boot_chain(spark, calls):
    names = calls.select(F.col("src").alias("node"), F.col("src").alias("name"))
    assert rows(graph.boot_entries(calls, names)) == [("main",)]
    assert rows(graph.boot_entries(calls.where("src <> 'main'"), names, 2)) == [("b",), ("z",)]  # equal scores: the last name
    got = rows(graph.boot_chain(calls, named(spark, "main"), names))
    assert got == [("a", 1, "main", 1, False, False), ("b", 1, "main", 1, False, False), ("c", 2, "a", 2, False, False), ("db", 3, "c", 0, False, True), ("main", 0, None, 2, True, False)]


def test_preferred_path(spark, calls):
    e = calls.withColumn("downstream", graph.downstream(F.col("dst")))
    one = lambda *a: [(r.path, r.score) for r in graph.preferred_path(e, named(spark, "main"), *a).collect()]
    assert one() == [(["main", "b", "c", "db"], 3 + 2 + 1 + 2)]
    assert one(named(spark, "c")) == [(["main", "b", "c"], 5)]
    assert one(named(spark, "db"), 3) == [] and one(named(spark, "nobody")) == []


def test_ordered_walks(spark, calls):
    assert rows(graph.dfs(calls, named(spark, "main"), 3)) == [("a", 1), ("b", 1), ("c", 2), ("db", 3), ("main", 0)]
    assert rows(graph.dfs(calls, named(spark, "db", "gone"), 3)) == [("db", 0), ("gone", 0)]
    # p goes to q first and meets r at depth 2, which blocks what r's shorter way would reach
    e = spark.createDataFrame([("p", "q", "t"), ("q", "r", "t"), ("p", "r", "t"), ("r", "s", "t")], "src string, dst string, type string")
    assert rows(graph.dfs(e, named(spark, "p"), 2)) == [("p", 0), ("q", 1), ("r", 2)]
    assert rows(graph.cycle_roots(calls)) == [(4, 7, 4 / 7)]  # a and x meet cycles; b and z meet what stays on the stack
    assert rows(graph.cyclic(calls.where("src IN ('x', 'y', 'z')"))) == [("x", "y"), ("y", "x")]
    assert graph.cyclic(e).count() == 0
    with pytest.raises(ValueError, match="over 2 edges"):
        graph.cycle_roots(calls, 2)


def test_split_at(spark):
    d = spark.createDataFrame([(1, "import os\n\ndef a():\n  pass\nclass B:\n  x = (1) => 2\n"), (2, "\n \n"), (3, None)], "k int, text string")
    assert [tuple(r) for r in chunks.split_at(d).orderBy("start_line").collect()] == [(1, 1, 2, None, "import os"), (1, 3, 4, "a", "def a():\n  pass"), (1, 5, 5, "B", "class B:"), (1, 6, 7, None, "x = (1) => 2")]


def test_knowledge_graph(spark):
    files = spark.createDataFrame([("m.py", "class Base:\n    pass\n\n\nclass Sub(Base):\n    def go(self, n):\n        total = add(n, y=2)\n        return total\n\n\ndef add(x, y):\n    return x + y\n")], "path string, content string")
    n, e = knowledge.build(files)
    assert {r.name for r in n.collect()} >= {"Base", "Sub", "go", "add", "total"}
    short = {(r.src.split(":")[-1], r.dst.split(":")[-1], r.type, r.kind) for r in e.collect()}
    assert short == {("go", "add", "calls", "calls"), ("go", "add", "dataflow", "interprocedural_call"), ("add", "go", "dataflow", "return_propagation"), ("go", "go", "dataflow", "def_use"), ("add", "add", "dataflow", "def_use"), ("go", "Base", "inherits", "inherits")}
    props = next(r.props for r in e.collect() if r.kind == "interprocedural_call")
    assert '{"name":"x","expr":"n"}' in props and '{"name":"y","expr":"2"}' in props and '"assigned_to":"total"' in props
    assert knowledge.build(python_code.fixture(spark).limit(0))[1].count() == 0


def test_keywords_meet_symbols_as_one_by_one(spark):
    names = ["parser", "parsing", "Parse", "pars", "a", "", None, "ring", "load_config", "config", "parser"]
    words = ["PARSED", "config", "load_config", "in", None, "rings", "parse", "parse"]
    found = ranking.keyword_matches(spark.createDataFrame([(n,) for n in names], "symbol_name string"), spark.createDataFrame([(w,) for w in words], "word string"))
    expected = []
    for w in sorted({w.lower() for w in words if w and len(w) > 2}):
        one = ranking.symbol_matches(spark.createDataFrame([(n,) for n in names if n], "symbol_name string"), [w])
        expected += [(w, r.symbol_name, round(r.confidence, 9)) for r in one.collect()]
    assert sorted((r.word, r.symbol_name, round(r.confidence, 9)) for r in found.collect()) == sorted(expected)
    assert len(expected) > 5


def test_wide_frontiers_reach_the_same(spark, monkeypatch):
    e = spark.createDataFrame([(i, (i * 7 + 3) % 50, "x") for i in range(50)] + [(1, 2, "x"), (1, 2, "x")], "src long, dst long, type string")
    at = spark.createDataFrame([(1,), (4,)], "node long")
    near = rows(graph.bfs(e, at, 4, "both"))
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    assert rows(graph.bfs(e, at, 4, "both")) == near


def _stages(spark):
    return spark._jsc.sc().dagScheduler().nextStageId()


def test_long_chains_are_peeled_at_once(spark):
    """A chain of 120 edges before a cycle, one behind it and one between two cycles, which stays; nulls go."""
    chain = lambda a, b: list(zip(range(a, b), range(a + 1, b + 1), strict=True))
    stay = [(120, 121), (121, 120), *chain(121, 140), (140, 140)]
    edges = [*chain(0, 120), *stay, *chain(140, 260), *chain(1000, 1100), (None, 121), (140, None)]
    before = _stages(spark)
    got = graph.cyclic(spark.createDataFrame(edges + stay[:2], "src long, dst long")).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted(stay)
    assert _stages(spark) - before < 30
    assert graph.cyclic(spark.createDataFrame(chain(0, 90), "src long, dst long")).isEmpty()


@pytest.mark.parametrize("most", [0, 12])
def test_cyclic_by_rounds_and_by_one_task(spark, monkeypatch, most):
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(45)}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    one = graph.cyclic(frame).collect()
    monkeypatch.setattr(graph, "PEEL_EDGES", most)
    while len(left := {e for e in edges if e[0] in {d for _, d in edges} and e[1] in {s for s, _ in edges}}) < len(edges):
        edges = left
    for got in (one, graph.cyclic(frame).collect()):
        assert {tuple(r) for r in got} == edges and len(got) == len(edges) > 0


@pytest.mark.parametrize("longest", [1, 2, 3, 4, 5, 6])
def test_simple_paths_by_brute_force(spark, longest):
    rng = random.Random(longest)
    edges = sorted({(rng.randrange(14), rng.randrange(14), rng.choice("ab")) for _ in range(40)} | {(0, 5, "a"), (0, 5, "b")})
    sources, targets = [0, 1, 3], [3, 5, 8]
    want, open_ = [], [[s] for s in sources]
    while open_:
        p = open_.pop()
        if p[-1] in targets:
            want.append(p)
        elif len(p) < longest:
            open_ += [[*p, d] for s, d, _ in edges if s == p[-1] and d not in p]
    nodes = lambda x: spark.createDataFrame([(n,) for n in x], "node long")
    got = graph.simple_paths(spark.createDataFrame(edges * 2, "src long, dst long, type string"), nodes(sources), nodes(targets), longest)
    assert sorted(r.path for r in got.collect()) == sorted(want)


def test_simple_paths_walk_only_what_lies_near_both_ends(spark, monkeypatch):
    """Behind the target is a hub of many nodes, three steps away: no way leads over them, so they aren't walked."""
    edges = [(0, 1), (1, 2), (2, 3), (10, 3), (11, 10), *((100 + i, 11) for i in range(500))]
    walked = []
    monkeypatch.setattr(graph, "kept", lambda df, kept=graph.kept: walked.append(out := kept(df)) or out)
    frame = spark.createDataFrame([(a, b, "x") for a, b in edges], "src long, dst long, type string")
    end = lambda n: spark.createDataFrame([(n,)], "node long")
    assert [r.path for r in graph.simple_paths(frame, end(0), end(3), 5).collect()] == [[0, 1, 2, 3]]
    assert max(x.count() for x in walked) < 20
