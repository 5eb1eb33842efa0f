"""Features of code chunks, their similarities, and the three re-rankings of retrieved chunks.

Chunks have (path, language, node_type, symbol_name, parent_class, params, decorators, imports, text); a ranking takes the
candidates a vector search left, with their distances, and adds a score. All but the name ratio is expressions. Null
columns count as empty. Ties are broken by the chunk's key, so results don't depend on the order of arrival.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.functions import text as tx

from . import questions

# Path segments with their boosts, segments of less central code, and the weights of the unified score.
PATH_BOOSTS = {0.25: ["views", "controllers", "routes", "api"], 0.2: ["models", "schemas"], 0.15: ["utils", "helpers", "lib"]}
PERIPHERAL = ["test", "util", "helper", "lib", "vendor"]
WEIGHTS = {"semantic": 0.25, "signature": 0.15, "control_flow": 0.15, "imports": 0.10, "api_calls": 0.15, "symbol": 0.10, "callgraph": 0.10}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _has(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _boost(condition: Column, by: float) -> Column:
    return F.when(condition, F.lit(by)).otherwise(F.lit(0.0))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def hybrid(candidates: DataFrame, question: str, cosine: str | None = None) -> DataFrame:
    """``candidates`` with ``score``: 1 / (1 + distance) and boosts for what the question and the path say.

    ``cosine`` names a column with the similarity of question and text; half of it is added.
    """
    asked = questions.filters(F.lit(question))
    low, path = F.lit(question.lower()), F.lower(_text("path"))
    named = lambda c: (_text(c) != "") & F.contains(low, F.lower(_text(c)))
    words = F.regexp_extract_all(low, F.lit(r"(?U)[a-zA-Z_]\w*"), F.lit(0))
    terms = [
        1 / (1 + F.col("distance")),
        _boost(F.lower(_text("language")) == asked["language"], 0.4),
        _boost(F.lower(_text("node_type")) == asked["node_type"], 0.3),
        _boost(F.contains(path, asked["path"]), 0.3),
        _boost(named("symbol_name"), 0.6),
        _boost(named("parent_class"), 0.4),
        _boost(_has(_text("text"), ["def ", "function "]), 0.2),
        _boost(_has(_text("text"), ["class "]), 0.2),
        _boost(_has(F.lower(F.substring(_text("text"), 1, 400)), ["import "]), 0.15),
        _boost(_has(F.lower(_text("text")), ["todo", "fixme"]), 0.05),
        _boost(F.exists(words, lambda w: F.contains(path, w)), 0.2),
        *(_boost(_has(path, segments), by) for by, segments in PATH_BOOSTS.items()),
    ]
    if cosine:
        terms.append(0.5 * F.coalesce(F.col(cosine), F.lit(0.0)))
    score = terms[0]
    for t in terms[1:]:
        score = score + t
    return candidates.withColumn("score", score)


def features(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the struct ``f``: signature, control flow, imports and calls as read off the text by lines."""
    lines = F.transform(F.split(_text("text"), "\n"), _strip)
    starting = lambda *heads: F.size(F.filter(lines, lambda x: _starts(x, heads)))
    listed = F.flatten(F.transform(_list("imports"), _imported))
    written = F.flatten(F.transform(lines, lambda x: F.concat(F.regexp_extract_all(x, F.lit(r"(?U)^import\s+([\w\.]+(?:\s+as\s+\w+)?)"), F.lit(1)), F.regexp_extract_all(x, F.lit(r"(?U)^from\s+([\w\.]+)\s+import\s+[\w\s,]+"), F.lit(1)))))
    calls = F.transform(F.regexp_extract_all(_text("text"), F.lit(r"(?U)\w+\.\w+\s*\(|\w+\s*\("), F.lit(0)), lambda c: F.regexp_replace(c, r"(?U)\s*\($", ""))
    f = F.struct(
        F.when(_text("symbol_name") == "", "unknown").otherwise(_text("symbol_name")).alias("name"),
        F.size(_list("params")).alias("params"),
        _list("decorators").alias("decorators"),
        F.contains(F.substring(_text("text"), 1, 100), F.lit("async")).alias("is_async"),
        (_text("parent_class") != "").alias("is_method"),
        starting("if ", "elif ").alias("conditionals"),
        starting("for ", "while ").alias("loops"),
        starting("return ").alias("returns"),
        F.exists(lines, lambda x: _has(x, ["try:", "except ", "finally:"])).alias("handles"),
        F.array_distinct(F.filter(F.concat(listed, written), lambda x: x != "")).alias("imports"),
        F.array_distinct(calls).alias("calls"),
    )
    return chunks.withColumn("f", f)


def _starts(x: Column, heads: tuple[str, ...]) -> Column:
    hit = F.startswith(x, F.lit(heads[0]))
    for h in heads[1:]:
        hit = hit | F.startswith(x, F.lit(h))
    return hit


def _imported(entry: Column) -> Column:
    """Names of one import statement: module.name for ``from``, the modules otherwise."""
    halves = F.split(entry, " import ")
    module = _strip(F.regexp_replace(halves[0], "from ", ""))
    some = F.transform(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ","), lambda n: F.concat(module, F.lit("."), _strip(n)))
    return F.when(F.contains(entry, F.lit(" import ")), some).otherwise(F.transform(F.split(F.regexp_replace(entry, "import ", ""), ","), _strip))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all, of two names: a matcher of longest blocks, which no expression has."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def signature_similarity(a: Column, b: Column, names: Column) -> Column:
    """0.4 names, 0.2 parameter counts, 0.15 decorators, 0.1 each of async and method, over their sum."""
    params = 1 - F.abs(a["params"] - b["params"]) / F.greatest(a["params"], b["params"], F.lit(1))
    n, m = F.size(a["decorators"]), F.size(b["decorators"])
    decorated = F.when((n > 0) & (m > 0), F.size(F.array_intersect(a["decorators"], b["decorators"])) / F.greatest(n, m)).otherwise(_boost((n == 0) & (m == 0), 1.0))
    return (0.4 * names + 0.2 * params + 0.15 * decorated + _boost(a["is_async"] == b["is_async"], 0.1) + _boost(a["is_method"] == b["is_method"], 0.1)) / 0.95


def control_flow_similarity(a: Column, b: Column) -> Column:
    near = lambda k: 1 - F.abs(a[k] - b[k]) / F.greatest(a[k], b[k], F.lit(1))
    return 0.3 * near("loops") + 0.3 * near("conditionals") + 0.2 * F.when(a["handles"] == b["handles"], 1.0).otherwise(0.5) + 0.2 * near("returns")


def symbol_relevance(symbol: Column, asked: list[str], resolved: list[str] = ()) -> Column:
    """1 where the chunk's symbol is asked for; else half a point per containment (0.8 if the index knows the symbol
    asked for), by the number of symbols asked for, at most 1."""
    if not asked:
        return F.lit(0.0)
    s, equal, total = F.lower(symbol), F.lit(False), F.lit(0.0)
    for q in asked:
        low = F.lit(q.lower())
        equal = equal | (s == low)
        total = total + _boost((s != "") & (F.contains(s, low) | F.contains(low, s)), 0.5)
        if q in resolved:
            total = F.greatest(total, F.lit(0.8))
    return F.when(equal, 1.0).otherwise(F.least(F.lit(1.0), total / len(asked)))


def unified(candidates: DataFrame, query: DataFrame, asked: list[str], near: DataFrame, k: int, key: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(key, seven parts, score): the ``k`` best of ``candidates`` for the one chunk in ``query``.

    ``near`` has (symbol_name, depth): call distance from what is asked for, e to the minus half of which is that part;
    symbols not in it get 0. Weights are scaled to sum to 1. ``query`` is cut to one row and broadcast.
    """
    q = features(query).select(F.col("f").alias("qf")).limit(1)
    reach = near.groupBy("symbol_name").agg(F.min("depth").alias("_depth"))
    x = features(candidates).crossJoin(F.broadcast(q)).join(reach, "symbol_name", "left")
    a, b = F.col("f"), F.col("qf")
    calls = F.when((F.size(a["calls"]) == 0) & (F.size(b["calls"]) == 0), 1.0).otherwise(tx.jaccard(a["calls"], b["calls"]))
    parts = {
        "semantic": 1 / (1 + F.col("distance")),
        "signature": signature_similarity(a, b, F.col("_names")),
        "control_flow": control_flow_similarity(a, b),
        "imports": tx.jaccard(a["imports"], b["imports"]),
        "api_calls": calls,
        "symbol": symbol_relevance(_text("symbol_name"), asked),
        "callgraph": F.coalesce(F.exp(F.col("_depth") * -0.5), F.lit(0.0)),
    }
    x = x.withColumn("_names", name_ratio(a["name"], b["name"])).select(key, *(F.round(c, 9).alias(n) for n, c in parts.items()))
    score, whole = F.lit(0.0), sum(weights.values())
    for n in parts:
        score = score + F.col(n) * (weights[n] / whole)
    return x.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), key).limit(k)


def symbol_matches(names: DataFrame, words: list[str], least: float = 0.6) -> DataFrame:
    """(symbol_name, confidence): symbols a word of the question names, stems alike: 1 if equal, the ratio of lengths (at
    least ``least``) if one holds the other; the best of a symbol's matches. The words are those of one question."""
    best = F.lit(None).cast("double")
    s = tx.stem(F.lower("symbol_name"))
    for w in sorted({w.lower() for w in words if len(w) > 2}):
        t = tx.stem(F.lit(w))
        ratio = F.least(F.length(s), F.length(t)) / F.greatest(F.length(s), F.length(t))
        one = F.when(s == t, 1.0).when((F.contains(s, t) | F.contains(t, s)) & (ratio >= least), ratio)
        best = F.greatest(best, one)
    return names.select("symbol_name").distinct().withColumn("confidence", best).where("confidence IS NOT NULL")


def keyword_matches(names: DataFrame, words: DataFrame, least: float = 0.6) -> DataFrame:
    """(word, symbol_name, confidence): as ``symbol_matches`` for a table of words (word), a row per match.

    Whatever holds the other's stem at a ratio of lengths of ``least`` has it among its substrings of such lengths, so the
    two sides meet on these by equality. A name of n characters has at most n * n / 4 of them. Empty names, words below
    three characters and nulls match nothing; repeated names and words count once.
    """
    a = names.select("symbol_name", tx.stem(F.lower("symbol_name")).alias("s")).where("s <> ''").distinct()
    b = words.select(F.lower("word").alias("word")).where(F.length("word") > 2).distinct().withColumn("t", tx.stem(F.col("word")))

    def parts(of: str) -> Column:
        n = F.length(of)
        lengths = F.sequence(F.greatest(F.lit(1), F.floor(n * least).cast("int")), F.greatest(F.lit(1), n))
        cut = F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring(F.col(of), i, k)))
        return F.explode(F.array_distinct(F.flatten(cut)))

    inside = a.select("*", parts("s").alias("t")).join(b, "t").select("word", "symbol_name", "s", "t")
    around = b.select("*", parts("t").alias("s")).join(a, "s").where("s <> t").select("word", "symbol_name", "s", "t")
    ratio = F.least(F.length("s"), F.length("t")) / F.greatest(F.length("s"), F.length("t"))
    return inside.unionByName(around).withColumn("confidence", ratio).where(F.col("confidence") >= least).select("word", "symbol_name", "confidence")


def locality(question: str) -> Column:
    """0.5; 0.2 for functions and classes, 0.1 off the peripheral paths, 0.15 where path and question share a word; at most 1."""
    path, kind = F.lower(_text("path")), F.lower(_text("node_type"))
    shared = F.arrays_overlap(tx.tokens(path), tx.tokens(F.lit(question)))
    return F.least(F.lit(1.0), 0.5 + _boost(_has(kind, ["function", "class"]), 0.2) + _boost(~_has(path, PERIPHERAL), 0.1) + _boost(shared, 0.15))


def symbol_driven(candidates: DataFrame, matches: DataFrame, depths: DataFrame, question: str, k: int, key: str) -> DataFrame:
    """(key, is_direct, score): the two best chunks of matched symbols, then the best others, ``k`` less all that match.

    ``candidates`` is what a search of a fixed size left, so one task can rank it.

    Score: 0.35 symbol + 0.25 call graph + 0.15 locality + 0.25 / (1 + distance). A chunk is direct where its symbol is
    in ``matches`` (confidence); ``depths`` (symbol_name, depth) gives the hops from matched symbols for the others:
    0.8 at one, 0.5 at two, 0.2 beyond, 0.1 where the graph doesn't know them.
    """
    near = depths.groupBy("symbol_name").agg(F.min("depth").alias("_depth"))
    x = candidates.join(matches.groupBy("symbol_name").agg(F.max("confidence").alias("_direct")), "symbol_name", "left").join(near, "symbol_name", "left")
    direct = F.col("_direct").isNotNull()
    symbol = F.when(direct, F.col("_direct")).when(F.col("_depth").isNotNull(), 0.1).otherwise(0.0)
    graph = F.when(direct, 1.0).when(F.col("_depth") <= 1, 0.8).when(F.col("_depth") <= 2, 0.5).when(F.col("_depth").isNotNull(), 0.2).otherwise(0.1)
    score = 0.35 * symbol + 0.25 * graph + 0.15 * locality(question) + 0.25 / (1 + F.col("distance"))
    x = x.select(key, direct.alias("is_direct"), F.round(score, 9).alias("score"))
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("is_direct").orderBy(F.desc("score"), key))).withColumn("_n", F.count_if("is_direct").over(W.partitionBy()))
    kept = (F.col("is_direct") & (F.col("_r") <= 2)) | (~F.col("is_direct") & (F.col("_r") <= k - F.col("_n")))
    return x.where(kept).orderBy(F.desc("is_direct"), "_r").drop("_r", "_n")
