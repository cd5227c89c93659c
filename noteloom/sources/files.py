"""Reading notes and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows in fewer files, or of fewer tasks of a scan, than there are cores are dealt to all: a file may be one row group, which one task reads,
    however many are planned for it. Tables in more files stay as they are read."""
    cores, tasks = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows.repartition(max(cores, tasks)) if min(len(rows.inputFiles()), tasks) < cores else rows


def indexable(files: DataFrame, index_pdf: bool = True) -> DataFrame:
    """files (path): .md always, .pdf if asked for; case does not matter."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(ext.isin(*(["md", "pdf"] if index_pdf else ["md"])))


def pruned(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (path) whose file is still listed."""
    return entries.join(files.select("path").distinct(), "path", "left_semi")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """path, text and mtime of the Markdown files below a folder."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return got.select("path", F.decode("content", "UTF-8").alias("text"), F.unix_millis("modificationTime").alias("mtime"))


def documents_as_sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
