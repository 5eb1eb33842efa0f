"""Retrieved chunks, call figures, sessions and refresh on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import call_stats, passages, vectors
from lodestone.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_summaries(spark):
    said = ['# one #\nx = 1', 'x = 1\n  """Doc."""\n# later', "", None, " \n\t", "y" * 200, "'''A'''"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, text string")
    got = [r[0] for r in df.orderBy("k").select(passages.summary(F.col("text"))).collect()]
    none = "Code chunk with no visible content."
    assert got == ["one", "Doc.", none, none, none, "y" * 120, "A"]


def test_segment_takes_line_numbers_as_offsets(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\ne\n", 3, 3), ("a\nb", 9, 9), (None, 1, 1)], "content string, s int, e int")
    got = [r[0] for r in df.select(passages.segment(F.col("content"), F.col("s"), F.col("e"), 1)).collect()]
    assert tuple(got[0]) == ("c\nd\n", 3, 4) and got[1].text == "" and got[2] is None


def test_context_of_missing_files_and_lines(spark):
    c = spark.createDataFrame([(1, 2, "r:a.py", 1, 1, "A"), (1, 1, None, None, None, None)], "q int, rank int, path string, start_line int, end_line int, text string")
    f = spark.createDataFrame([("a.py", "l1\nl2\n")], "path string, content string")
    r = passages.assembled(passages.expanded(c, f), "q", most_chars=40).first()
    assert r.sources == "1. unknown: ?–?\n2. r:a.py: 1–1"
    assert r.context == "### Source 1: unknown (?–?)\n\n\n# Additional Context\n\n\n-----\n\n### Source 2: r:a.py (1–1)\n" + "A\n\n# Additional Context\nl1\nl2\n"[:40]


def test_followups(spark):
    c = spark.createDataFrame([(1, 1, "src/app.py", "run", "", None), (1, 2, None, None, None, None), (2, 1, ".env", "", "A b c d e f g h i j", None)], "q int, rank int, path string, symbol_name string, parent_class string, text string")
    got = rows(passages.followups(c, "q"))
    assert got[:3] == [(1, 1, "run implementation in app.py"), (1, 2, "run usage app"), (1, 3, "app logic run")]
    assert got[3:] == [(2, 1, "A b c d e f g h i j initialization .env"), (2, 2, ".env logic A b c d e f g h i j")]


def test_two_hops(spark):
    found = {"what": [("a.py", "run", 1), ("b.py", "go", 2)], "run usage a": [("c.py", "own", 1), ("a.py", "run", 2)]}

    def search(questions, k):
        asked = [r.question for r in questions.collect()]
        return spark.createDataFrame([(1, p, 1, 1, s, None, n) for q in asked for p, s, n in found.get(q, [])], "question_id int, path string, start_line int, end_line int, symbol_name string, parent_class string, rank int")

    best = lambda df, k: df.orderBy("rank", "path").limit(k)
    got = passages.two_hops(spark.createDataFrame([(1, "what")], "question_id int, question string"), search, best)
    assert [r.path for r in got.collect()] == ["a.py", "c.py", "b.py"]


def test_alike_chunks_go_in_order(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    data = [(k % 2, k, None if k % 20 == 19 else v[k].tolist()) for k in range(60)]
    want = []
    for q in (0, 1):
        kept = []
        for k in range(q, 60, 2):
            x = data[k][2]
            if x is None or all(np.dot(x, v[j]) / (np.linalg.norm(x) * np.linalg.norm(v[j])) <= 0.7 for j in kept if data[j][2]):
                kept.append(k)
        want += [(q, k) for k in kept]
    df = spark.createDataFrame(data, "q int, rank int, embedding array<double>").repartition(5)
    assert rows(passages.distinct_in_meaning(df, "q", threshold=0.7)) == want
    with pytest.raises(Exception, match="at most 5"):
        passages.distinct_in_meaning(df, "q", most=5).collect()


def test_pairs_by_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(70, 3))
    g = [None if k < 20 else 1 if k < 69 else 2 for k in range(70)]
    df = spark.createDataFrame([(k, g[k], v[k].tolist()) for k in range(70)], "vec_id long, label int, embedding array<double>")
    got = {r.label: r for r in vectors.pair_stats(df, "label", 0.5, block=6).collect()}
    assert set(got) == {None, 1}
    for label, at in ((None, range(20)), (1, range(20, 69))):
        c = [v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) for i in at for j in at if i < j]
        assert (got[label].pairs, got[label].alike) == (len(c), sum(x > 0.5 for x in c))
        assert np.allclose([got[label]["mean"], got[label].most], [np.mean(c), max(c)])
    assert vectors.pair_stats(df.limit(0), "label").count() == 0


def test_call_figures(spark):
    c = spark.createDataFrame([("a:f", "a:g"), ("a:f", "b:h"), ("a:f", "len"), ("b:h", "a:f"), ("c:x", "len"), ("c:x", "c:x")], "caller string, callee string")
    assert tuple(call_stats.payload(c).first()) == (4, 4, 0, 2)
    assert tuple(call_stats.payload(c.limit(0)).first()) == (0, 0, 0, 0)
    assert sorted(map(str, rows(call_stats.file_dependencies(c.where("callee <> 'len'"))))) == ["('a', 'b')", "('b', 'a')", "('c', None)"]


def test_depths_take_the_cheaper_way(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 9), (1, None)], "src int, dst int")
    deps = spark.createDataFrame([(1, 4), (4, 3), (3, 5)], "src int, dst int")
    start = spark.createDataFrame([(1,), (None,)], "node int")
    assert rows(call_stats.depths(calls, deps, start)) == [(1, 0.0), (2, 1.0), (3, 1.0), (4, 0.5), (5, 1.5)]
    assert call_stats.depths(calls, deps, start.limit(0)).count() == 0


def test_refresh(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "path string, v int")
    e = spark.createDataFrame([("added", "n", None), ("removed", "b", None), ("renamed", "c2", "c"), ("changed", "d", None), ("renamed", "a", "x"), (None, None, None)], "status string, filename string, previous_filename string")
    new = lambda p: p.where("path <> 'n'").withColumn("v", F.lit(2))
    assert rows(events.refreshed(old, "h2", "h1", lambda: e, new)) == [("a", 2), ("c2", 2), ("d", 2)]

    def never(*_):
        raise AssertionError("nothing is compared")

    assert rows(events.refreshed(old, "h1", "h1", never, never)) == rows(old)


def test_fresh_commits(spark):
    log = spark.createDataFrame([("s3", 0), ("s2", 1), ("s1", 2)], "sha string, ord int")
    assert [rows(events.fresh_commits(log, s).select("sha")) for s in ("s2", "s3", "gone", None)] == [[("s3",)], [], [("s1",), ("s2",), ("s3",)], [("s1",), ("s2",), ("s3",)]]
