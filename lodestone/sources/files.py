"""Sources of files: trees, archives and commit logs as tables, with the scan filter before contents are used."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a scan leaves out and what it takes. Names are compared in lower case.
SKIP_DIRS = [".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "node_modules", "dist", "build", ".next", "coverage", "vendor", "third_party", "target", "out", ".turbo"]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "composer.lock"]
SKIP_SUFFIXES = [".min.js", ".min.css", ".bundle.js", ".generated.js", ".generated.ts", ".generated.tsx", ".g.dart", ".pb.go", ".designer.cs"]
GENERATED = "@generated|@auto-generated|auto-generated|autogenerated|generated by|do not edit"
EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".cpp", ".h"]
MAX_BYTES = 1_500_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def listed(path: Column, folders: list[str] = SKIP_DIRS) -> Column:
    """Whether names alone let a relative path pass: folders, lock files and suffixes, in lower case."""
    parts = F.split(F.lower(path), "/")
    suffixes = "|".join(x.replace(".", r"\.") for x in SKIP_SUFFIXES)
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, folders))) & ~F.element_at(parts, -1).isin(LOCK_FILES) & ~F.lower(path).rlike(f"(?:{suffixes})$")


def scannable(path: Column, size: Column) -> Column:
    """By listing alone, of a path relative to the tree's top: extension, folders, lock files, suffixes and size."""
    return extension(path).isin(EXTENSIONS) & listed(path) & (size <= MAX_BYTES)


def generated(content: Column) -> Column:
    return F.lower(F.substring(content, 1, 2048)).rlike(GENERATED)


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ext, size, sha, content) of the scannable files under ``folder``, paths relative to it.

    The filter runs on the listing (path and length), so left-out files are not read.
    """
    top = folder.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    own = F.regexp_replace(F.col("path"), "^[a-z0-9+.-]+:/*", "/")
    start = len(re.sub("^[a-z0-9+.-]+:/*", "/", top)) + 2
    x = raw.where(scannable(F.substr(own, F.lit(start)), F.col("length"))).withColumn("path", F.substr(own, F.lit(start)))
    x = x.select("path", extension(F.col("path")).alias("ext"), F.col("length").alias("size"), F.sha1("content").alias("sha"), F.decode("content", "UTF-8").alias("content"))
    return x.where(~generated(F.col("content")))


_BAD_PATH = re.compile(r"(?:^|/)(?:%s)(?:/|$)" % "|".join(map(re.escape, SKIP_DIRS)))


def _wanted(path: str, size: int) -> bool:
    """``scannable``, for a member of an archive before it is unpacked."""
    low = path.lower()
    return size <= MAX_BYTES and low.endswith(tuple(EXTENSIONS)) and not low.endswith(tuple(SKIP_SUFFIXES)) and not _BAD_PATH.search(low) and low.rsplit("/", 1)[-1] not in LOCK_FILES


def archives(spark: SparkSession, glob: str) -> DataFrame:
    """(archive, path, size, content, error) of the scannable files in ZIP archives; a single root folder is taken off.

    Members are filtered before they are unpacked. An archive or member that can't be read has one row with the
    ``error`` and no content, so it is neither lost unseen nor fails the job.
    """
    columns = ["archive", "path", "size", "content", "error"]

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        roots = {i.filename.split("/")[0] for i in infos}
                        cut = len(next(iter(roots))) + 1 if len(roots) == 1 and all("/" in i.filename for i in infos) else 0
                        for i in infos:
                            path = i.filename[cut:]
                            if not _wanted(path, i.file_size):
                                continue
                            try:
                                row = (name, path, i.file_size, z.read(i).decode("utf-8", "replace"), None)
                            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError) as e:
                                row = (name, path, i.file_size, None, type(e).__name__)
                            yield pd.DataFrame([row], columns=columns)
                except zipfile.BadZipFile as e:
                    yield pd.DataFrame([(name, None, None, None, type(e).__name__)], columns=columns).astype({"size": "Int64"})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(unpack, "archive string, path string, size long, content string, error string")


def numstat(lines: DataFrame) -> DataFrame:
    """(sha, added, deleted, path) from ``git log --numstat`` lines (sha, value); ``-`` of binary files counts 0."""
    p = F.split("value", "\t")
    x = lines.where(F.size(p) == 3)
    return x.select("sha", F.coalesce(p[0].try_cast("bigint"), F.lit(0)).alias("added"), F.coalesce(p[1].try_cast("bigint"), F.lit(0)).alias("deleted"), p[2].alias("path"))
