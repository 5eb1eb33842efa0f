"""Contributors: normalised identities, totals by author, merged totals, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources import files

# What counts as code in contributions, beside the scan's own lists.
CODE_EXTENSIONS = [".py", ".js", ".java", ".ts", ".tsx", ".jsx", ".go", ".cpp", ".c", ".h", ".hpp", ".rs", ".md", ".txt", ".css", ".scss", ".html", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".bash", ".sql", ".yaml", ".yml"]
MORE_DIRS = [".github", ".gradle", ".idea", ".pytest_cache"]


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def identity(name: Column, email: Column, login: Column, account_email: Column) -> Column:
    """(name, email) of a commit's author, with what stands in where either is empty."""
    raw = F.coalesce(_some(name), _some(login), _some(email), F.lit("unknown"))
    mail = F.coalesce(_some(email), _some(account_email), F.concat(_some(login), F.lit("@users.noreply.github.com")), F.concat(raw, F.lit("@local")))
    return F.struct(F.coalesce(_some(F.trim(raw)), F.lit("unknown")).alias("name"), F.coalesce(_some(F.lower(F.trim(mail))), F.lit("unknown@local")).alias("email"))


def is_bot(name: Column, email: Column) -> Column:
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(email, F.lit("")))
    return F.contains(n, F.lit("[bot]")) | F.contains(m, F.lit("[bot]")) | F.endswith(m, F.lit("bot@users.noreply.github.com"))


def is_code(path: Column) -> Column:
    """Whether a changed file counts: by name, suffix, folders and extension, in lower case; null and empty don't."""
    low = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return files.listed(low, [*files.SKIP_DIRS, *MORE_DIRS]) & files.extension(low).isin(CODE_EXTENSIONS)


def display_name(names: Column, email: Column) -> Column:
    """Of names in order of preference: the first with a blank, or the first, or the address."""
    real = F.filter(names, lambda n: F.contains(n, F.lit(" ")))
    return F.coalesce(F.try_element_at(real, F.lit(1)), F.try_element_at(names, F.lit(1)), email)


def username(email: Column) -> Column:
    """What stands behind a ``+`` in the address, or else its local part as a title."""
    tag = _some(F.split_part(F.split_part(email, F.lit("+"), F.lit(2)), F.lit("@"), F.lit(1)))
    return F.when(F.coalesce(email, F.lit("")) == "", "Unknown").otherwise(F.coalesce(tag, F.initcap(F.translate(F.split_part(email, F.lit("@"), F.lit(1)), "_.", "  "))))


def author_totals(commits: DataFrame, details: DataFrame) -> DataFrame:
    """By address: commits, lines and distinct code files of ``commits`` (sha, name, email, at) and their ``details``
    (sha, path, added, deleted); the first and last commit and up to five names, the latest first.

    Robots are left out, commits without details count as commits. Details are summed by commit before they are joined,
    and files counted apart, so an author with a third of the commits is summed in parts.
    """
    c = commits.where(~is_bot(F.col("name"), F.col("email"))).select("sha", "name", "email", "at")
    d = details.where(is_code(F.col("path")))
    lines = d.groupBy("sha").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    latest = F.reverse(F.array_sort(F.collect_set(F.struct("last", "name"))))
    names = c.groupBy("email", "name").agg(F.max("at").alias("last"), F.min("at").alias("first"), F.count("*").alias("n"))
    who = names.groupBy("email").agg(F.sum("n").alias("commits"), F.min("first").alias("first_commit"), F.max("last").alias("last_commit"), F.slice(latest, 1, 5)["name"].alias("names"))
    sums = c.join(lines, "sha").groupBy("email").agg(zero("added").alias("lines_added"), zero("deleted").alias("lines_deleted"))
    touched = c.select("sha", "email").join(d.select("sha", "path"), "sha").select("email", "path").distinct().groupBy("email").agg(F.count("*").alias("files_changed"))
    x = who.join(sums, "email", "left").join(touched, "email", "left").na.fill(0, ["lines_added", "lines_deleted", "files_changed"])
    return x.withColumns({"net_lines": F.col("lines_added") - F.col("lines_deleted"), "display": display_name(F.col("names"), F.col("email"))})


def merged_totals(totals: DataFrame, groups: DataFrame) -> DataFrame:
    """Totals by person from ``totals`` by address and ``groups`` (email, person); files are summed, not counted again.

    An address without a group is a person of its own. The name shown is the first display name with a blank.
    """
    x = totals.join(groups.withColumnRenamed("person", "_p"), "email", "left").withColumn("person", F.coalesce("_p", "email"))
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    shown = F.array_sort(F.collect_set("display"))
    return x.groupBy("person").agg(*map(total, ["commits", "files_changed", "lines_added", "lines_deleted", "net_lines"]), F.min("first_commit").alias("first_commit"), F.max("last_commit").alias("last_commit"), F.array_sort(F.collect_set("email")).alias("emails"), display_name(shown, F.min("email")).alias("name"))


def find_author(merged: DataFrame, query: str) -> DataFrame:
    """The first author (by commits, then name) whose name holds the query or is held by it, or else whose address does."""
    q = F.lit(query.lower())
    holds = lambda x: F.contains(F.lower(x), q) | F.contains(q, F.lower(x))
    place = F.when(holds(F.col("name")), 0).when(F.exists("emails", holds), 1)
    return merged.withColumn("_place", place).where("_place IS NOT NULL").orderBy("_place", F.col("commits").desc(), "name").limit(1).drop("_place")
