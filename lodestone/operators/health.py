"""Code health over any table of file metrics: statistics, scores, smells, suggestions and the payload of a report.

``metrics`` is a table like that of ``file_stats.metrics``: path, language, loc, loc_code, loc_blank, loc_comment,
num_functions, num_classes, cyclomatic_complexity, average_function_length, docstring_coverage (0 to 100) and fan_out;
fan_in where it is known (taken as 0 where the column is absent). Counts that are null are taken as 0. Everything is
an expression over that table and one row of totals, which is what a cross join adds here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and weights of the scores.
COMPLEXITY_MAX, LENGTH_MAX, FAN_OUT_MAX, DEPENDENCIES_MAX, IDEAL_COMMENTS = 15, 50, 20, 15, 0.3
WEIGHTS = {"maintainability": 0.25, "modularity": 0.25, "readability": 0.25, "change_risk": 0.15, "dependency_hygiene": 0.10}
GRADES = [(80, "A", "Excellent"), (60, "B", "Good"), (40, "C", "Fair"), (float("-inf"), "D", "Poor")]
# Fixed values: (ideal, warning, critical) of complexity, lines per function and documentation, by language.
THRESHOLDS = {
    "python": {"cyclomatic_complexity": (5, 10, 20), "lines_per_function": (20, 50, 100), "docstring_coverage": (0.80, 0.50, 0.20)},
    "java": {"cyclomatic_complexity": (10, 15, 20), "lines_per_function": (30, 60, 120), "docstring_coverage": (0.80, 0.50, 0.20)},
    "cpp": {"cyclomatic_complexity": (8, 12, 20), "lines_per_function": (30, 60, 120), "docstring_coverage": (0.70, 0.40, 0.10)},
    "c": {"cyclomatic_complexity": (7, 10, 15), "lines_per_function": (25, 50, 100), "docstring_coverage": (0.70, 0.40, 0.10)},
}
# What a smell costs to mend, how urgent that is, and its score in the longer list (null: not in it).
RULES = [
    ("God File", "high", "high", 85),
    ("Long Functions", "medium", "high", 75),
    ("High Cyclomatic Complexity", "medium", "high", 80),
    ("Tight Coupling", "high", "medium", 70),
    ("Dead/Unused Code", "low", "medium", 30),
    ("Orphaned File", "low", "low", None),
    ("Change Hotspot", "high", "high", 90),
]
# Names of the strategies by smell; those of a god file depend on what it holds.
STRATEGIES = {
    "Long Functions": ["Extract Helper Methods", "Extract to Separate Functions", "Use Guard Clauses"],
    "High Cyclomatic Complexity": ["Extract Methods", "Use Polymorphism", "Simplify Logic"],
    "Tight Coupling": ["Extract Interface/Abstract Class", "Apply Dependency Injection", "Reorganize Module Structure"],
    "Dead/Unused Code": ["Remove Dead Code", "Archive If Uncertain"],
    "Orphaned File": ["Remove Orphaned File", "Integrate Into Existing Module", "Establish Connections"],
    "Change Hotspot": ["Stabilize Through Refactoring", "Isolate Volatile Code", "Improve Test Coverage"],
}
PREVENTIVE = [("Preventive - Architecture", "medium", 60), ("Preventive - Testing", "medium", 65)]

_COUNTS = ["loc", "loc_code", "loc_blank", "loc_comment", "num_functions", "num_classes", "cyclomatic_complexity", "average_function_length", "docstring_coverage", "fan_out", "fan_in"]


def _whole(metrics: DataFrame) -> DataFrame:
    have = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in metrics.columns else F.lit(0)
    return metrics.select("path", *([F.col("language")] if "language" in metrics.columns else []), *(have(c).alias(c) for c in _COUNTS))


def _share(value: Column, most: float) -> Column:
    """How far ``value`` stays below ``most``, from 0 to 1."""
    return F.greatest(F.lit(0.0), (F.lit(float(most)) - value) / F.lit(float(most)))


def _percent(value: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value))


def from_symbols(symbols: DataFrame, languages: Column) -> DataFrame:
    """Metrics of files whose text is not at hand, from ``symbols`` (path, kind, line, end_line, docstring).

    ``languages`` is an expression over path; files without a language are left out. A repository's prefix (before the
    first colon) comes off the path. Code, comments and blanks are 78, 10 and 12 % of the lines; a null line is 0.
    """
    line = F.coalesce("line", F.lit(0))
    end = F.coalesce("end_line", line)
    s = symbols.withColumns({"path": F.regexp_replace("path", "^[^:]*:", ""), "_f": F.col("kind").isin("function", "method"), "_end": end, "_n": F.greatest(F.lit(1), end - line + 1)})
    s = s.withColumn("language", languages).where("language IS NOT NULL")
    documented = F.coalesce(F.col("docstring") != "", F.lit(False))
    x = s.groupBy("path", "language").agg(
        F.greatest(F.max("_end"), F.lit(1)).alias("loc"),
        F.count_if("_f").alias("num_functions"),
        F.count_if(F.col("kind") == "class").alias("num_classes"),
        F.coalesce(F.sum(F.when(F.col("_f"), F.floor(F.greatest(F.lit(0), F.col("_n") - 10) / 5))), F.lit(0)).alias("_long"),
        F.coalesce(F.avg(F.when(F.col("_f"), F.col("_n"))), F.lit(0.0)).alias("average_function_length"),
        F.count_if(F.col("_f") & documented).alias("_documented"),
        F.bool_or(documented).alias("has_docstring"),
    )
    part = lambda k: F.floor(F.col("loc") * k / 100).cast("int")
    x = x.withColumns({"loc_code": part(78), "loc_comment": part(10), "loc_blank": part(12), "cyclomatic_complexity": 1 + F.col("num_functions") + F.col("_long"), "docstring_coverage": F.when(F.col("num_functions") > 0, F.col("_documented") * 100 / F.col("num_functions")).otherwise(0.0)})
    return x.drop("_long", "_documented")


def modules(metrics: DataFrame) -> DataFrame:
    """Sums and means by the first part of the path; files at the top are the module ``root``."""
    module = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("root")
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    return _whole(metrics).groupBy(module.alias("module")).agg(F.count("*").alias("num_files"), *map(total, ["loc", "loc_code", "num_functions", "num_classes"]), F.avg("cyclomatic_complexity").alias("avg_cyclomatic_complexity"), F.avg("average_function_length").alias("avg_function_length"))


def repository(metrics: DataFrame) -> DataFrame:
    """One row of totals and safe ratios; function length is weighted by the number of functions. Empty: zeros."""
    m = _whole(metrics)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    module = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("root")
    x = m.agg(
        F.count("*").alias("num_files"), total("loc", "total_loc"), total("loc_code", "total_loc_code"), total("loc_comment", "total_loc_comment"), total("loc_blank", "loc_blank"),
        total("num_functions", "num_functions"), total("num_classes", "num_classes"), F.coalesce(F.sum(F.col("average_function_length") * F.col("num_functions")), F.lit(0.0)).alias("_length"),
        F.coalesce(F.sum("cyclomatic_complexity"), F.lit(0)).alias("_complexity"), F.count_distinct(module).alias("num_modules"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return x.withColumns({"avg_function_length": per("_length", "num_functions"), "avg_class_size": per("total_loc", "num_classes"), "comment_to_code_ratio": per("total_loc_comment", "total_loc_code"), "avg_cyclomatic_complexity": per("_complexity", "num_files")}).drop("_length", "_complexity")


def graded(score: Column) -> Column:
    """(grade, level) of a score."""
    out = None
    for least, grade, level in reversed(GRADES):
        row = F.struct(F.lit(grade).alias("grade"), F.lit(level).alias("level"))
        out = row if out is None else F.when(score >= least, row).otherwise(out)
    return out


def overall(metrics: DataFrame, cycle_share: float = 0.0) -> DataFrame:
    """One row: the five dimensions, overall_score, grade and level.

    ``cycle_share`` is the share of callers that head a cycle (``graph.cycle_roots``). Without files, dimensions that
    need them are 50.
    """
    m = _whole(metrics)
    r = repository(metrics)
    mean = F.coalesce(F.avg("loc"), F.lit(0.0)).alias("_loc")
    gods = m.crossJoin(F.broadcast(m.agg(mean))).agg(F.count_if(F.col("loc") > 3 * F.col("_loc")).alias("_gods"))
    means = m.agg(F.avg("fan_out").alias("_fan_out"), F.avg("docstring_coverage").alias("_doc"), F.avg("cyclomatic_complexity").alias("_cc"))
    x = r.crossJoin(F.broadcast(gods)).crossJoin(F.broadcast(means))  # a row each
    some = lambda c: F.when(F.col("num_files") > 0, _percent(c)).otherwise(50.0)
    x = x.select(
        _percent((_share(F.col("avg_cyclomatic_complexity"), COMPLEXITY_MAX) * 0.6 + _share(F.col("avg_function_length"), LENGTH_MAX) * 0.4) * 100).alias("maintainability"),
        some(_share(F.col("_fan_out"), FAN_OUT_MAX) * 100 - F.col("_gods") / F.greatest("num_files", F.lit(1)) * 30).alias("modularity"),
        some(F.col("_doc") * 0.6 + F.least(F.lit(100.0), F.col("comment_to_code_ratio") / IDEAL_COMMENTS * 100) * 0.4).alias("readability"),
        some(_share(F.col("_cc"), COMPLEXITY_MAX) * 100).alias("change_risk"),
        some(_share(F.col("total_loc") / F.greatest("num_files", F.lit(1)), DEPENDENCIES_MAX) * 100 - cycle_share * 20).alias("dependency_hygiene"),
    )
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return x.withColumn("overall_score", _percent(total)).withColumn("_g", graded(F.col("overall_score"))).select("*", "_g.grade", "_g.level").drop("_g")


def file_scores(metrics: DataFrame) -> DataFrame:
    """(path, score, complexity, grade, level) of every file."""
    score = (_share(F.col("cyclomatic_complexity"), COMPLEXITY_MAX) * 0.4 + _share(F.col("average_function_length"), LENGTH_MAX) * 0.3 + F.col("docstring_coverage") / 100 * 0.3) * 100
    x = _whole(metrics).select("path", _percent(score).alias("score"), F.col("cyclomatic_complexity").alias("complexity"))
    return x.withColumn("_g", graded(F.col("score"))).select("path", "score", "complexity", "_g.grade", "_g.level")


def step_score(value: Column, limits: tuple[float, float, float], inverse: bool = False) -> Column:
    """100, 75, 50 or 25 by the limits (ideal, warning, critical); ``inverse`` where less is better."""
    meets = (lambda x: value <= x) if inverse else (lambda x: value >= x)
    return F.when(meets(limits[0]), 100).when(meets(limits[1]), 75).when(meets(limits[2]), 50).otherwise(25)


def enhanced(metrics: DataFrame, fan_outs: DataFrame | None = None, language: str = "python") -> DataFrame:
    """One row: the enhanced score with its parts, the maintainability index, debt and priorities.

    ``fan_outs`` (caller, fan_out) is the call graph's; without it modularity is 50. The complexity part takes a high
    complexity as good, as the scores it is compared with do. Without files the score is 0 and the index 50.
    """
    t = THRESHOLDS.get(language, THRESHOLDS["python"])
    m = _whole(metrics).agg(F.count("*").alias("n"), F.avg("cyclomatic_complexity").alias("cc"), F.avg("average_function_length").alias("len"), F.avg(F.col("docstring_coverage") / 100).alias("doc"), F.avg("loc").alias("loc"), F.max("loc").alias("most"))
    spread = F.lit(50.0) if fan_outs is None else F.coalesce(F.greatest(F.lit(0.0), 100 - F.col("fo") * 2), F.lit(50.0))
    if fan_outs is not None:
        m = m.crossJoin(F.broadcast(fan_outs.agg(F.avg("fan_out").alias("fo"))))  # a row each
    x = m.select(
        "n", "cc", "len", "doc", "loc", "most",
        step_score(F.col("cc"), t["cyclomatic_complexity"]).alias("complexity"), step_score(F.col("len"), t["lines_per_function"], inverse=True).alias("function_length"),
        step_score(F.col("doc"), t["docstring_coverage"]).alias("documentation"), spread.alias("modularity"), F.greatest(F.lit(0.0), 100 - F.col("cc") * 3).alias("testing"),
    )
    score = _percent(F.col("complexity") * 0.30 + F.col("function_length") * 0.20 + F.col("documentation") * 0.20 + F.col("modularity") * 0.15 + F.col("testing") * 0.15)
    x = x.withColumn("score", F.when(F.col("n") > 0, score).otherwise(0.0))
    s = F.col("score")
    debt = F.when(s >= 80, "Low").when(s >= 60, "Moderate").when(s >= 40, "High").otherwise("Critical")
    wants = F.array_compact(F.array(F.when(F.col("cc") > 8, "complexity"), F.when(F.col("most") > 500, "size"), F.when(F.col("doc") < 0.5, "documentation")))
    return x.select("complexity", "function_length", "documentation", "modularity", "testing", "score", F.coalesce(maintainability_index(F.col("cc"), F.col("loc"), F.col("doc")), F.lit(50.0)).alias("maintainability_index"), debt.alias("debt"), wants.alias("priorities"))


def maintainability_index(complexity: Column, loc: Column, documented: Column) -> Column:
    """``documented`` from 0 to 1; null where an input is."""
    value = 171 - 5.2 * F.pow(complexity, F.lit(1.5)) - 0.023 * loc + 50 * documented
    return F.when(value.isNotNull(), _percent(value))


def trends(metrics: DataFrame) -> DataFrame:
    """One row: sample deviation of complexity (0 below two files) and its consistency."""
    x = _whole(metrics).agg(F.coalesce(F.nanvl(F.stddev_samp("cyclomatic_complexity"), F.lit(0.0)), F.lit(0.0)).alias("complexity_deviation"))
    d = F.col("complexity_deviation")
    return x.withColumn("consistency", F.when(d < 3, "high").when(d < 7, "medium").otherwise("low"))


def risks(metrics: DataFrame) -> DataFrame:
    """(path, risk_score, reasons) of files with any risk."""
    marks = [(F.col("cyclomatic_complexity") > 10, 30, "High complexity"), (F.col("loc") > 500, 25, "Large file"), (F.col("docstring_coverage") < 30, 15, "Low documentation")]
    total = sum((F.when(on, n).otherwise(0) for on, n, _ in marks), F.lit(0))
    return _whole(metrics).select("path", F.least(total, F.lit(100)).alias("risk_score"), F.array_compact(F.array(*(F.when(on, why) for on, _, why in marks))).alias("reasons")).where("risk_score > 0")


def hotspot_score() -> Column:
    share = lambda c, most: F.least(F.col(c) / F.lit(float(most)), F.lit(1.0))
    return share("cyclomatic_complexity", 10) * 0.4 + share("loc", 500) * 0.3 + share("fan_out", 20) * 0.3


def dead_code(symbols: DataFrame, callers: DataFrame) -> DataFrame:
    """One row (unused, examples): names of ``symbols`` (name) that are no private names and not in ``callers`` (name).

    Ten examples by name. No row where either table is empty or nothing is unused.
    """
    names = symbols.select("name").where("name IS NOT NULL").distinct()
    unused = names.where(~F.startswith("name", F.lit("_"))).join(callers.select("name").distinct(), "name", "left_anti")
    first = unused.orderBy("name").limit(10).agg(F.array_sort(F.collect_list("name")).alias("examples"))
    out = unused.agg(F.count("*").alias("unused")).crossJoin(first).where("unused > 0")  # a row each
    return out.join(callers.limit(1).select(F.lit(1).alias("_any")), how="left_semi")


def smells(metrics: DataFrame, hotspots: int = 5) -> DataFrame:
    """(type, path, severity, value, threshold, num_functions, num_classes): a row for each smell of each file.

    Severity and thresholds are those of the reports: three times the mean size, functions of over 50 lines, complexity
    over 10, fan-out over twice the mean, no dependency either way, and the ``hotspots`` highest scores over 0.5 (ties
    by path). Every smell is one expression, so the metrics are read once beside their means, and once for hotspots.
    """
    m = _whole(metrics)
    x = m.crossJoin(F.broadcast(m.agg(F.avg("loc").alias("_loc"), F.avg("fan_out").alias("_fan_out"))))
    god, coupled = 3 * F.col("_loc"), 2 * F.col("_fan_out")
    smell = lambda on, kind, severity, value, limit: F.when(on, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), value.cast("double").alias("value"), limit.cast("double").alias("threshold")))
    length, cc = F.col("average_function_length"), F.col("cyclomatic_complexity")
    all_ = [
        smell(F.col("loc") > god, "God File", F.when(F.col("loc") > 2 * god, "high").otherwise("medium"), F.col("loc"), god),
        smell(length > 50, "Long Functions", F.when(length < 100, "medium").otherwise("high"), length, F.lit(50)),
        smell(cc > 10, "High Cyclomatic Complexity", F.when(cc > 15, "critical").otherwise("high"), cc, F.lit(10)),
        smell(F.col("fan_out") > coupled, "Tight Coupling", F.lit("medium"), F.col("fan_out"), coupled),
        smell((F.col("fan_in") == 0) & (F.col("fan_out") == 0) & ~F.startswith("path", F.lit("__")), "Orphaned File", F.lit("medium"), F.lit(0), F.lit(0)),
    ]
    out = x.select("path", "num_functions", "num_classes", F.explode(F.array_compact(F.array(*all_))).alias("s")).select("s.type", "path", "s.severity", "s.value", "s.threshold", "num_functions", "num_classes")
    hot = m.withColumn("value", hotspot_score()).where("value > 0.5").orderBy(F.col("value").desc(), "path").limit(hotspots)
    return out.unionByName(hot.select(F.lit("Change Hotspot").alias("type"), "path", F.when(F.col("value") < 0.7, "medium").otherwise("high").alias("severity"), "value", F.lit(0.5).alias("threshold"), "num_functions", "num_classes"))


def _rule(at: int, kind: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for r in RULES if r[at] is not None for v in (r[0], r[at]))), F.col("type")).cast(kind)


def suggestions(found: DataFrame) -> DataFrame:
    """``found`` (smells) with effort, priority and the names of the strategies; unknown smells are left out."""
    fixed = F.try_element_at(F.create_map(*(v for k, names in STRATEGIES.items() for v in (F.lit(k), F.array(*map(F.lit, names))))), F.col("type"))
    god = F.array_compact(F.array(F.when(F.col("num_classes") > 1, "Split by Class"), F.when(F.col("num_functions") > 5, "Split by Functionality"), F.lit("Extract to Package")))
    return found.withColumns({"effort": _rule(1, "string"), "priority": _rule(2, "string"), "strategies": F.when(F.col("type") == "God File", god).otherwise(fixed)}).where("effort IS NOT NULL")


def _rank(c: str, order: list[str], other: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for i, x in enumerate(order) for v in (x, i))), F.col(c)), F.lit(other))


def ranked_suggestions(found: DataFrame, most: int | None = 20) -> DataFrame:
    """The ``most`` first suggestions (all, where None) by priority, high first, then type and path."""
    x = suggestions(found).orderBy(_rank("priority", ["high", "medium", "low"], 1), "type", "path")
    return x if most is None else x.limit(most)


def enhanced_suggestions(found: DataFrame) -> DataFrame:
    """(type, path, severity, effort, impact_score): smells that have a score, and the preventive rows (path null).

    Meant to be ordered by impact, highest first, then effort, lowest first.
    """
    x = found.withColumns({"effort": _rule(1, "string"), "impact_score": _rule(3, "int")}).where("impact_score IS NOT NULL").select("type", "path", "severity", "effort", "impact_score")
    more = found.sparkSession.createDataFrame([(t, None, "medium", e, i) for t, e, i in PREVENTIVE], "type string, path string, severity string, effort string, impact_score int")
    return x.unionByName(more)


def smell_counts(found: DataFrame) -> DataFrame:
    """(type, severity, n)."""
    return found.groupBy("type", "severity").agg(F.count("*").alias("n"))


def score_deciles(scores: DataFrame) -> DataFrame:
    """(decile, files): by tens of ``score``; 100 is in the decile of its own."""
    return scores.groupBy((F.floor(F.col("score") / 10) * 10).cast("int").alias("decile")).agg(F.count("*").alias("files"))


def payload(metrics: DataFrame, cycle_share: float = 0.0, most: int = 20) -> DataFrame:
    """One row, the whole report: overall and dimensions, repository totals, numbers of smells, the ``most`` first
    suggestions and the ``most`` files of the lowest score. Without files the grade is N/A and lists are empty."""
    found = smells(metrics)
    low = file_scores(metrics).orderBy("score", "path").limit(most).agg(F.array_sort(F.collect_list(F.struct("score", "path"))).alias("lowest_files"))
    first = ranked_suggestions(found, most).agg(F.array_sort(F.collect_list(F.struct("type", "path", "effort", "priority"))).alias("suggestions"))
    counts = found.agg(F.count("*").alias("num_smells"))
    x = overall(metrics, cycle_share).crossJoin(repository(metrics)).crossJoin(counts).crossJoin(first).crossJoin(low)  # a row each
    none = F.col("num_files") == 0
    return x.withColumns({"grade": F.when(none, "N/A").otherwise(F.col("grade")), "level": F.when(none, "Unknown").otherwise(F.col("level")), "overall_score": F.when(none, 0.0).otherwise(F.col("overall_score"))})
