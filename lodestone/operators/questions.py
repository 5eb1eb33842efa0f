"""What a question asks for: intent, quoted code, keywords, constraints, symbols and the filters it implies.

All of it is expressions over a text column, so a table of questions is one projection. Patterns run on lower-case text with
Unicode classes and with the line feed as the only line end. A null question has no intent, no filters and empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intents in order of trial with their patterns, keywords, languages, and marks of contribution and startup questions.
INTENTS = {
    "find_function": [r"find\s+(?:the\s+)?(?:function|def)\s+(\w+)", r"(?:function|def)\s+(\w+)", r"show\s+(?:me\s+)?(?:function|def)\s+(\w+)", r"(?:how|what|where)\s+(?:is|are)\s+(?:the\s+)?(?:function|def)\s+(\w+)"],
    "find_class": [r"find\s+(?:the\s+)?(?:class|type)\s+(\w+)", r"(?:class|type)\s+(\w+)", r"show\s+(?:me\s+)?(?:class|type)\s+(\w+)", r"(?:how|what|where)\s+(?:is|are)\s+(?:the\s+)?(?:class|type)\s+(\w+)"],
    "find_usage": [r"(?:where|how)\s+(?:is\s+)?(\w+)\s+(?:used|called)", r"find\s+(?:all\s+)?(?:usages?|calls?|references?)\s+(?:to\s+)?(\w+)", r"who\s+(?:calls?|uses?)\s+(\w+)"],
    "find_caller": [r"(?:what|which)\s+(?:function|method)\s+(?:calls?|invokes?)\s+(\w+)", r"find\s+(?:callers?|callee|references?)\s+(?:of|to)\s+(\w+)", r"(?:who|what)\s+calls?\s+(\w+)"],
    "find_implementation": [r"(?:show|find|implement)\s+(?:me\s+)?(?:the\s+)?implementation\s+(?:of|for)\s+(\w+)", r"how\s+(?:is|are)\s+(?:it|they)\s+implemented", r"implementation\s+of\s+(\w+)"],
    "find_pattern": [r"find\s+(?:code\s+)?pattern\s+(?:for|like)\s+(.+)", r"(?:similar|like)\s+(?:pattern|code)\s+(?:for|to)\s+(.+)", r"pattern[s]?\s+(?:for|like)\s+(.+)"],
    "understand_flow": [r"(?:explain|understand|trace)\s+(?:the\s+)?(?:flow|execution|logic)\s+(?:of|in)\s+(\w+)", r"(?:flow|execution|logic)\s+(?:of|in)\s+(\w+)", r"how\s+(?:does|do)\s+(\w+)\s+work", r"how\s+does\s+data\s+flow", r"(?:trace|explain|show)\s+(?:the\s+)?data\s+flow", r"user\s+request.*(?:flow|through)"],
    "understand_startup": [r"entry\s+point", r"startup", r"boot\s+(?:sequence|flow|process)", r"how\s+does\s+(?:the\s+)?(?:app|application|service|program|system)\s+start", r"how\s+does\s+it\s+start", r"what\s+is\s+the\s+sequence\s+of\s+events.*ready"],
    "understand_business_logic": [r"heavy\s+lifting", r"core\s+logic", r"primary\s+business\s+logic", r"where\s+does\s+the\s+main\s+logic\s+happen", r"which\s+parts?\s+do(?:es)?\s+the\s+most\s+work"],
    "understand_data_structures": [r"core\s+data\s+structures?", r"how\s+is\s+data\s+stored", r"where\s+is\s+state\s+stored", r"data\s+structure", r"state\s+owners?"],
    "understand_async": [r"async", r"asynchronous", r"background\s+(?:job|jobs|task|tasks|worker|workers)", r"threading", r"concurrency", r"parallel\s+execution"],
    "find_similar": [r"find\s+(?:similar|related|equivalent)\s+(?:code|function|implementation)", r"what\s+(?:is|are)\s+similar\s+(?:to|as)\s+(?:this|that)", r"similar\s+(?:code|pattern)\s+(?:to|as)\s+(.+)"],
}
KEYWORDS = "find search locate identify show display function class method implementation usage caller pattern similar related equivalent flow execution trace understand explain code logic entry startup boot ready business state data structure async background thread".split()
LANGUAGES = {"python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript", "java": "java", "c++": "cpp", "cpp": "cpp", "rust": "rust", "go": "go"}
CONTRIBUTION = [r"commit", r"git", r"contribut", r"author", r"who\s+(wrote|made|created|changed|modified|contributed)", r"who\s+is\s+the\s+(most|top)", r"development\s+activity", r"code\s+changes?", r"changed?\s+files?", r"activity", r"lines?\s+(added|deleted)", r"(added|deleted)\s+lines?", r"files?\s+changed?", r"history", r"timeline", r"when\s+was", r"when\s+did", r"recently?", r"last\s+(modified|changed|commit)", r"first\s+commit", r"latest\s+commit", r"project\s+timeline", r"development\s+timeline", r"stats?", r"metrics?", r"frequency", r"how\s+many", r"total\s+commit", r"(top|most|active)", r"recent", r"latest"]
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
COMMON = "the is are and or not a an to from in out if else for while return".split()

_FLAGS = "(?Ud)"  # Unicode classes, line feed as the only line end


def _any(patterns: list[str]) -> str:
    return _FLAGS + "|".join(f"(?:{p})" for p in patterns)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(group))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(_all(text, pattern, group), F.lit(1))


def intent(question: Column) -> Column:
    """The first intent one of whose patterns occurs; ``custom`` for none, null for null."""
    q, out = F.lower(question), F.when(question.isNotNull(), F.lit("custom"))
    for name in reversed(INTENTS):
        out = F.when(q.rlike(_any(INTENTS[name])), name).otherwise(out)
    return out


def about_contributions(question: Column) -> Column:
    return F.coalesce(F.lower(question).rlike(_any(CONTRIBUTION)), F.lit(False))


def snippets(question: Column) -> Column:
    """Fenced code, then code between single backticks (fences have some too), then indented blocks without their indents."""
    q = F.coalesce(question, F.lit(""))
    blocks = _all(q, r"(?m)(?:^(?: {4}|\t)[^\n]*(?:\n|\z))+")
    bare = F.transform(blocks, lambda b: F.array_join(F.transform(F.split(F.regexp_replace(b, r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, _FLAGS + r"^\s+", "")), "\n"))
    return F.concat(_all(q, r"(?s)```[\w]*\n(.*?)\n```", 1), _all(q, r"`([^`]+)`", 1), bare)


def prose(question: Column) -> Column:
    """The question without its code, without white space at the ends."""
    x = F.regexp_replace(F.coalesce(question, F.lit("")), _FLAGS + r"(?s)```[\w]*\n.*?\n```", "")
    return F.regexp_replace(F.regexp_replace(x, "`[^`]+`", ""), _FLAGS + r"^\s+|\s+$", "")


def keywords(question: Column) -> Column:
    """The distinct words that say what is wanted, sorted."""
    words = _all(F.lower(F.coalesce(question, F.lit(""))), r"\b\w+\b")
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, KEYWORDS))))


def constraints(question: Column) -> Column:
    """Struct (file, line, type, method_type, visibility) of what a question fixes; null where it doesn't."""
    q = F.coalesce(question, F.lit(""))
    return F.struct(
        _first(q, r"(?i)(?:in|from|file)\s+(?:the\s+)?file\s+[\"']?([^\s\"']+)[\"']?").alias("file"),
        _first(q, r"(?i)(?:at|around|line)\s+(\d+)").try_cast("bigint").alias("line"),
        F.when(q.rlike(_FLAGS + r"(?i)async\s+(?:function|method)"), "async").alias("type"),
        F.when(q.rlike(_FLAGS + r"(?i)(?:static|class)\s+method"), "static").alias("method_type"),
        F.when(q.rlike(_FLAGS + r"(?i)(?:public|private)\s+(?:method|function)"), F.when(F.contains(q, F.lit("public")), "public").otherwise("private")).alias("visibility"),
    )


def filters(question: Column) -> Column:
    """Struct (language, node_type, path): names are looked for anywhere in the text and the last of the list wins, so
    "javascript" gives java; of a file name only the extension is kept."""
    q = F.lower(question)
    language = F.lit(None).cast("string")
    for name, value in LANGUAGES.items():
        language = F.when(F.contains(q, F.lit(name)), value).otherwise(language)
    node_type = F.when(F.contains(q, F.lit("class")), "class_definition").when(F.contains(q, F.lit("function")) | F.contains(q, F.lit("def ")), "function_definition")
    return F.struct(language.alias("language"), node_type.alias("node_type"), _first(q, r"\w+\.(py|js|ts|java|cpp|c|rs|go)").alias("path"))


def days_back(question: Column) -> Column:
    """How many days "last N units" or "in the last unit" reaches back; null without one."""
    q = F.lower(question)
    days = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
    many = r"(?:last|previous)\s+(\d+)\s+(day|week|month|year)s?"
    return F.coalesce(_first(q, many).try_cast("bigint") * F.try_element_at(days, _first(q, many, 2)), F.try_element_at(days, _first(q, r"in\s+(?:the\s+)?(?:last|previous)\s+(day|week|month|year)")).cast("bigint"))


def symbols(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, confidence, is_primary): the distinct identifiers of each question and how likely they name code.

    0.5, up to 0.2 for length, 0.15 for mixed case or underscores, 0.1 for a first place in the first 30 %, 0.05 unless
    a common word; primary above 0.7. The first place is the first occurrence of the characters, inside words too.
    """
    x = questions.select(F.col(key), F.col(text).alias("_q")).withColumn("name", F.explode(F.array_distinct(_all(F.col("_q"), r"\b[a-zA-Z_]\w*\b"))))
    at = (F.expr("instr(_q, name)") - 1) / F.greatest(F.length("_q"), F.lit(1))
    score = (
        F.lit(0.5)
        + F.least(F.lit(0.2), F.length("name") / 30)
        + F.when(F.contains("name", F.lit("_")) | F.substring("name", 2, 1 << 30).rlike(r"\p{Lu}"), 0.15).otherwise(0.0)
        + F.when(at < 0.3, 0.1).otherwise(0.0)
        + F.when(F.lower("name").isin(COMMON), 0.0).otherwise(0.05)
    )
    return x.select(key, "name", F.round(F.least(F.lit(1.0), score), 9).alias("confidence")).withColumn("is_primary", F.col("confidence") > 0.7)
