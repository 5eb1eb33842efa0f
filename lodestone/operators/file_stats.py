"""Metrics of source files by language, naming rules and design patterns, as expressions over (path, content).

Regular expressions count, nothing is parsed: words in comments and strings count too. Null contents are empty texts of one line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension; what counts as a function, class, import, decision, dependency and documentation
# in each; prefixes of dependencies that don't count; naming rules; name marks of design patterns.
LANGUAGES = {".py": "python", ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go", ".rs": "rust"}
_C_FUNCTION = r"^\s*(?:static|inline|virtual)?\s*\w+\s+\w+\s*\([^)]*\)\s*(?:\{|;)"
_JS_FUNCTION = r"^\s*(?:async\s+)?(?:function\s+\w+|(?:\w+\s*:\s*)?function\s*\()"
_JS_ARROW = r"^\s*\w+\s*=\s*(?:async\s+)?\("
FUNCTIONS = {
    "python": [r"^\s*def\s+\w+\s*\("],
    "java": [r"^\s*(?:public|private|protected|static)?\s*(?:void|int|String|boolean|.*?)\s+\w+\s*\("],
    "c": [_C_FUNCTION],
    "cpp": [_C_FUNCTION],
    "javascript": [_JS_FUNCTION, _JS_ARROW],
    "typescript": [_JS_FUNCTION, _JS_ARROW],
    "go": [r"^\s*func\s+\(.*?\)\s+\w+\s*\(|^\s*func\s+\w+\s*\("],
    "rust": [r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+\w+\s*\("],
}
CLASSES = {
    "python": [r"^\s*class\s+\w+"],
    "java": [r"^\s*(?:public|private)?\s*(?:abstract)?\s*class\s+\w+|^\s*interface\s+\w+"],
    "c": [r"^\s*(?:struct|class|union)\s+\w+\s*\{"],
    "cpp": [r"^\s*(?:struct|class|union)\s+\w+\s*\{"],
    "javascript": [r"^\s*(?:export\s+)?class\s+\w+"],
    "typescript": [r"^\s*(?:export\s+)?class\s+\w+"],
    "go": [r"^\s*type\s+\w+\s+struct"],
    "rust": [r"^\s*(?:pub\s+)?(?:struct|impl|trait)\s+\w+"],
}
IMPORTS = {
    "python": [r"^\s*(?:import|from)\s+"],
    "java": [r"^\s*import\s+[\w.]+;"],
    "c": [r'^\s*#include\s+[<"]'],
    "cpp": [r'^\s*#include\s+[<"]'],
    "javascript": [r"^\s*(?:import|require)\s+"],
    "typescript": [r"^\s*(?:import|require)\s+"],
    "go": [r'^\s*import\s+[\w"./]'],
    "rust": [r"^\s*use\s+[\w:]+"],
}
DECISIONS = {
    "python": "if elif else for while except finally and or with",
    "java": "if else for while switch case catch finally && || ?",
    "c": "if else for while do switch case && || ?",
    "cpp": "if else for while do switch case && || ?",
    "javascript": "if else for while switch case catch && || ?",
    "typescript": "if else for while switch case catch && || ?",
    "go": "if else for switch case default && ||",
    "rust": "if else for while match _ && ||",
}
DEPENDENCIES = {
    "python": (r"^\s*(?:import|from)\s+([\w.]+)", "sys os json re collections typing pathlib ast"),
    "java": (r"^\s*import\s+([\w.]+);", "java."),
    "c": (r'^\s*#include\s+["]([^"]+)["]', ""),
    "cpp": (r'^\s*#include\s+["]([^"]+)["]', ""),
    "javascript": (r"^\s*import\s+.*?from\s+[\"']([^\"']+)[\"']", "react lodash express"),
    "typescript": (r"^\s*import\s+.*?from\s+[\"']([^\"']+)[\"']", "react lodash express"),
    "go": (r'^\s*import\s+(["`][^`"]+["`])', ""),
    "rust": (r"^\s*(use\s+[\w:]+)", "std::"),
}
_BODY = r"\{([^{}]*+(?:\{[^}]*\}[^{}]*+)*?)\}"
BODIES = {
    "python": r"(?s)def\s+\w+\s*\([^)]*\):[^\n]*\n(.*?)(?=\ndef\s|\nclass\s|\z)",
    "java": r"(?:public|private|protected)?\s*(?:\w+\s+)*\w+\s*\([^)]*\)\s*" + _BODY,
    "c": r"\w+\s+\w+\s*\([^)]*\)\s*" + _BODY,
    "cpp": r"\w+\s+\w+\s*\([^)]*\)\s*" + _BODY,
    "javascript": r"(?:function\s+\w+|async?\s+\w+)\s*\([^)]*\)\s*" + _BODY,
    "typescript": r"(?:function\s+\w+|async?\s+\w+)\s*\([^)]*\)\s*" + _BODY,
}
DOCUMENTED = {
    "python": [r"(?s)def\s+\w+\s*\([^)]*\):\s*\n\s*(?:\"\"\"|''').*?(?:\"\"\"|''')"],
    "java": [r"(?s)/\*\*.*?\*/\s*(?:public|private|protected)?\s*(?:\w+\s+)*\w+\s*\("],
    "c": [r"(?s)/\*.*?\*/\s*\w+\s+\w+\s*\([^)]*\)"],
    "cpp": [r"(?s)/\*.*?\*/\s*\w+\s+\w+\s*\([^)]*\)"],
    "javascript": [r"(?s)/\*\*.*?\*/\s*(?:async\s+)?(?:function\s+\w+|\w+\s*=\s*\()"],
    "typescript": [r"(?s)/\*\*.*?\*/\s*(?:async\s+)?(?:function\s+\w+|\w+\s*=\s*\()"],
}
MODULE_DOC = {
    "python": [r"^\s*(?:\"\"\"|''').*?(?:\"\"\"|''')"],
    "java": [r"(?s)^\s*/\*\*.*?\*/"],
    "c": [r"(?s)^\s*/\*.*?\*/"],
    "cpp": [r"(?s)^\s*/\*.*?\*/"],
    "javascript": [r"^\s*(?://|/\*)"],
    "typescript": [r"^\s*(?://|/\*)"],
}
NAMING = {"python": {"function": "^[a-z_][a-z0-9_]*$", "class": "^[A-Z][a-zA-Z0-9]*$"}, "java": {"function": "^[a-z][a-zA-Z0-9]*$", "class": "^[A-Z][a-zA-Z0-9]*$"}}
PATTERNS = {"Factory": "create_|make_|factory", "Adapter/Wrapper": "adapter|wrapper", "Decorator": "decor|wrap"}
CONFIDENCE = {"Singleton": 0.85, "Factory": 0.80, "Observer": 0.70, "Adapter/Wrapper": 0.75, "Decorator": 0.75}

_FLAGS = "(?Umd)"


def language(path: Column) -> Column:
    """By extension; null for files that aren't analysed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)))


def _by_language(lang: Column, choices: dict, other) -> Column:
    out = F.lit(other)
    for name, value in choices.items():
        out = F.when(lang == name, value).otherwise(out)
    return out


def _counts(text: Column, patterns: dict[str, list[str]]) -> dict:
    out = {}
    for name, some in patterns.items():
        n = F.regexp_count(text, F.lit(_FLAGS + some[0]))
        for p in some[1:]:
            n = n + F.regexp_count(text, F.lit(_FLAGS + p))
        out[name] = n
    return out


def _decisions(items: str) -> str:
    """One alternation: words after one look for a boundary, then operators."""
    words = [w for w in items.split() if w[0].isalpha() or w == "_"]
    signs = ["".join("\\" + c for c in w) for w in items.split() if w not in words]
    return "|".join([rf"\b(?:{'|'.join(words)})\b", *signs])


def complexity(lang: Column, text: Column) -> Column:
    """1 and the decision words and operators of the language."""
    return 1 + _by_language(lang, _counts(text, {k: [_decisions(v)] for k, v in DECISIONS.items()}), 0)


def code_lines(lang: Column, lines: Column) -> Column:
    """Lines, stripped beforehand, neither blank nor comments; block comments end with the line that closes them."""
    plain = F.size(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))))

    def step(s: Column, x: Column) -> Column:
        opens, closes = F.contains(x, F.lit("/*")), F.contains(x, F.lit("*/"))
        inside = ~closes & (s["inside"] | opens)
        counts = (x != "") & ~closes & ~inside & ~F.startswith(x, F.lit("//")) & ~F.startswith(x, F.lit("*"))
        return F.struct((s["n"] + counts.cast("int")).alias("n"), F.when(x == "", s["inside"]).otherwise(inside).alias("inside"))

    block = F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), step)["n"]
    return F.when(lang == "python", plain).when(lang.isNotNull(), block).otherwise(F.size(F.filter(lines, lambda x: x != "")))


def comment_lines(lang: Column, lines: Column) -> Column:
    """Comment lines, stripped beforehand; triple quotes switch a comment on and off, whatever else the line has."""

    def python(s: Column, x: Column) -> Column:
        quotes = F.contains(x, F.lit('"""')) | F.contains(x, F.lit("'''"))
        return F.struct((s["n"] + (quotes | s["inside"] | F.startswith(x, F.lit("#"))).cast("int")).alias("n"), (s["inside"] != quotes).alias("inside"))

    def block(s: Column, x: Column) -> Column:
        opens, closes = F.contains(x, F.lit("/*")), F.contains(x, F.lit("*/"))
        counts = opens | closes | s["inside"] | F.startswith(x, F.lit("//")) | F.startswith(x, F.lit("*"))
        return F.struct((s["n"] + counts.cast("int")).alias("n"), (opens | (~closes & s["inside"])).alias("inside"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside"))
    return F.when(lang == "python", F.aggregate(lines, start, python)["n"]).otherwise(F.aggregate(lines, start, block)["n"])


def _without(prefixes: str) -> Callable[[Column], Column]:
    return lambda x: ~x.rlike(f"^(?:{prefixes})")


def dependencies(lang: Column, text: Column) -> Column:
    """Imports of the project's own: those without the prefixes left out."""
    out = {}
    for name, (pattern, prefixes) in DEPENDENCIES.items():
        found = F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(1))
        skip = "|".join(p.replace(".", r"\.") for p in prefixes.split())
        out[name] = F.size(F.filter(found, _without(skip))) if skip else F.size(found)
    return _by_language(lang, out, 0)


def average_function_length(lang: Column, text: Column) -> Column:
    """Mean lines of function bodies; 0 without functions and for go and rust."""
    out = {}
    for name, pattern in BODIES.items():
        bodies = F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(1))
        total = F.aggregate(bodies, F.lit(0), lambda n, b: n + F.size(F.split(b, "\n")))
        out[name] = F.when(F.size(bodies) > 0, total / F.size(bodies)).otherwise(0.0)
    return _by_language(lang, out, 0.0)


def metrics(files: DataFrame) -> DataFrame:
    """(path, language, fifteen metrics) of the files of an analysed language in ``files`` (path, content)."""
    x = files.select("path", language(F.col("path")).alias("language"), F.coalesce("content", F.lit("")).alias("_t")).where("language IS NOT NULL")
    x = x.withColumn("_l", F.transform(F.split("_t", "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s++|(?<!\s)\s++$", "")))
    lang, text, lines = F.col("language"), F.col("_t"), F.col("_l")
    functions = _by_language(lang, _counts(text, FUNCTIONS), 0)
    imports = _by_language(lang, _counts(text, IMPORTS), 0)
    x = x.select(
        "path",
        "language",
        F.size(lines).alias("loc"),
        code_lines(lang, lines).alias("loc_code"),
        F.size(F.filter(lines, lambda s: s == "")).alias("loc_blank"),
        comment_lines(lang, lines).alias("loc_comment"),
        functions.alias("num_functions"),
        _by_language(lang, _counts(text, CLASSES), 0).alias("num_classes"),
        imports.alias("num_imports"),
        complexity(lang, text).alias("cyclomatic_complexity"),
        average_function_length(lang, text).alias("average_function_length"),
        (_by_language(lang, _counts(text, MODULE_DOC), 0) > 0).alias("has_docstring"),
        _by_language(lang, _counts(text, DOCUMENTED), 0).alias("_documented"),
        dependencies(lang, text).alias("fan_out"),
        imports.alias("dependency_count"),
    )
    x = x.withColumn("docstring_coverage", F.when(F.col("num_functions") > 0, F.col("_documented") * 100 / F.col("num_functions")).otherwise(0.0))
    return x.withColumn("comment_to_code_ratio", F.col("loc_comment") / F.greatest("loc_code", F.lit(1))).drop("_documented")


def naming_violations(symbols: DataFrame) -> DataFrame:
    """(name, language, kind, expected, actual) of symbols (name, kind, language) against their language's rules, python's by default."""
    lang = F.coalesce("language", F.lit("python"))
    kind = F.when(F.col("kind").isin("function", "method"), "function").when(F.col("kind") == "class", "class")
    x = symbols.select("name", lang.alias("language"), kind.alias("kind")).where("kind IS NOT NULL AND name IS NOT NULL")
    rule = lambda k: F.when(F.col("language") == "java", NAMING["java"][k]).otherwise(NAMING["python"][k])
    fails = F.when(F.col("kind") == "class", ~F.col("name").rlike(NAMING["python"]["class"])).otherwise(~F.startswith("name", F.lit("_")) & ~F.regexp_like("name", rule("function")))
    expected = F.when(F.col("kind") == "class", "PascalCase").when(F.col("language") == "python", "snake_case").otherwise("camelCase")
    actual = F.when(F.col("kind") == "class", "other").when(F.substring("name", 2, 1 << 30).rlike(r"\p{Lu}"), "camelCase").otherwise("snake_case")
    return x.where(fails).select("name", "language", "kind", expected.alias("expected"), actual.alias("actual"))


def design_patterns(symbols: DataFrame) -> DataFrame:
    """(pattern, symbols, confidence) that names hint at, over symbols (name, kind, is_static): a guess, for information.

    Factories must be static. An observer needs a name that subscribes and one that notifies; a singleton a class whose
    name other names hold, one with ``__init__`` or private and one with instance that is static or starts with ``get_``.
    """
    n = F.lower("name")
    x = symbols.where("name IS NOT NULL").select("name", n.alias("low"), "kind", F.coalesce("is_static", F.lit(False)).alias("is_static"))
    named = [x.where(F.col("low").rlike(p) & (F.col("is_static") if name == "Factory" else F.lit(True))).groupBy().agg(F.count("*").alias("symbols")).select(F.lit(name).alias("pattern"), "symbols") for name, p in PATTERNS.items()]
    marks = x.groupBy().agg(F.count_if(F.col("low").rlike("subscribe|add_listener|attach")).alias("s"), F.count_if(F.col("low").rlike("notify|fire|emit")).alias("e"))
    observer = marks.select(F.lit("Observer").alias("pattern"), F.when((F.col("s") > 0) & (F.col("e") > 0), F.col("s") + F.col("e")).otherwise(0).alias("symbols"))
    classes = x.where("kind = 'class'").select(F.col("name").alias("class")).distinct()
    parts = x.select("name", "low", "is_static", F.explode(F.array_distinct(F.split("name", "[:.]+"))).alias("class")).join(classes, "class")
    single = parts.groupBy("class").agg(F.max(F.contains("name", F.lit("__init__")) | F.contains("name", F.lit("private"))).alias("hidden"), F.max(F.contains("low", F.lit("instance")) & (F.col("is_static") | F.startswith("name", F.lit("get_")))).alias("getter"))
    singleton = single.where("hidden AND getter").groupBy().agg(F.count("*").alias("symbols")).select(F.lit("Singleton").alias("pattern"), "symbols")
    out = singleton.unionByName(observer)
    for d in named:
        out = out.unionByName(d)
    return out.where("symbols > 0").withColumn("confidence", F.try_element_at(F.create_map(*[F.lit(v) for pair in CONFIDENCE.items() for v in pair]), F.col("pattern")))
