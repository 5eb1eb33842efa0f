"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, importance, jaccard_join, mixing, pii
from lodestone.llm.shared import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample: those the classifier rejects go. Null and empty texts stay."""
    out, threshold = importance.weighed(docs, table(spark, sf_dir, "labels"))
    return out.where(F.col("_key") >= threshold()).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest doc_id. Texts without words stay."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Texts without words stay."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("_hits") == 0).select(*docs.columns)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; n_chars follows the text. Null texts stay null."""
    out = pii.sanitised(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it and their places in its schedule."""
    return mixing.mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("privacy", privacy), ("mixing_sources", mixing_sources)]

#: Classifier, sampling and groups can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def _shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the session names for checkpoints; a temporary one only where it names none, as in tests."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    return f"{folder or tempfile.mkdtemp(prefix='lodestone-')}/pipeline-{uuid.uuid4().hex}"


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written there to its end, in any file system that Spark reads."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what stands between them is in the folder the cluster shares.

    With a ``folder`` of the caller's the run can be resumed: stages that it already holds whole are read, not computed
    again, and the last one's is the corpus.
    """
    at = folder or _shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        if folder is None or not _complete(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
