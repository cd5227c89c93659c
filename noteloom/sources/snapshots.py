"""Index snapshots, manifests and checkpoints in a shared folder.

A snapshot is a folder named by the hash of its rows; a pointer is a small file of its own for each save, and the newest one
counts. Writers only ever add: rows first, then the pointer, so a reader sees a whole snapshot or the one before it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "at long, snapshot string, info string"


def identity(rows: DataFrame) -> str:
    """A hash of all rows, whatever their order and partitions."""
    columns = sorted(rows.columns)
    h = F.xxhash64(*[F.col(c) for c in columns])
    n, x, s = rows.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first()
    return f"{n:x}-{(x or 0) & (1 << 64) - 1:016x}-{(s or 0) & (1 << 64) - 1:x}"


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def point(spark: SparkSession, root: str, snapshot: str, info: str = "") -> None:
    row = spark.createDataFrame([(time.time_ns(), snapshot, info)], POINTER)
    row.coalesce(1).write.json(f"{root}/pointers/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")


def current(spark: SparkSession, root: str) -> str | None:
    """The snapshot of the newest pointer; null if there is none."""
    if not _exists(spark, f"{root}/pointers"):
        return None
    newest = spark.read.schema(POINTER).option("recursiveFileLookup", True).json(f"{root}/pointers").orderBy(F.col("at").desc()).first()
    return newest and newest["snapshot"]


def save(index: DataFrame, root: str, info: str = "") -> bool:
    """Writes a snapshot and points to it; does nothing if the newest one holds the same rows. Returns whether it wrote."""
    spark, name = index.sparkSession, identity(index)
    if current(spark, root) == name:
        return False
    if not _exists(spark, f"{root}/snapshots/{name}/_SUCCESS"):
        index.write.mode("overwrite").parquet(f"{root}/snapshots/{name}")
    point(spark, root, name, info)
    return True


def load(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame:
    """The newest snapshot. An error if there is none, or if its rows are not there: never an empty index instead."""
    name = current(spark, root)
    if name is None:
        raise FileNotFoundError(f"no index has been saved in {root}")
    if not _exists(spark, f"{root}/snapshots/{name}/_SUCCESS"):
        raise FileNotFoundError(f"the snapshot {name} of {root} is missing or not whole; the index must be built again")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/snapshots/{name}")


def create_empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def tidy(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes all but the ``keep`` newest snapshots and their pointers' targets; returns how many went. Readers of an older one may fail then."""
    rows = spark.read.schema(POINTER).option("recursiveFileLookup", True).json(f"{root}/pointers").groupBy("snapshot").agg(F.max("at").alias("at")).orderBy(F.col("at").desc()).collect()
    gone = 0
    for row in rows[keep:]:
        fs, p = _fs(spark, f"{root}/snapshots/{row['snapshot']}")
        gone += fs.delete(p, True)
    return gone


# ---------------------------------------------------------------- manifest and checkpoint

MANIFEST = "path string, hash string, mtime long, source_type string, file_name string, title string, page_count int, chunk_ids array<string>"


def manifest_of(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The manifest of chunk rows (path as source_key, id, chunk_index, ...) with their sources' hashes (path, hash)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"])
    first = lambda c: F.min_by(c, "chunk_index").alias(c)
    each = rows.groupBy(F.col("source_key").alias("path")).agg(*[first(c) for c in ("mtime", "source_type", "file_name", "title")], F.max("page_end").alias("page_count"), ids.alias("chunk_ids"))
    return each.join(hashes.select("path", "hash"), "path").select("path", "hash", "mtime", "source_type", "file_name", "title", "page_count", "chunk_ids")


def due(sources_since: int, seconds_since: float, sources: int = 2_000, seconds: float = 20 * 60) -> bool:
    """Whether a rebuild should save what it has: after 2,000 sources or 20 minutes."""
    return sources_since >= sources or seconds_since >= seconds


def persist(portable: DataFrame, index: DataFrame, manifest: DataFrame, root: str, checkpoint: str = "") -> None:
    """Saves in the order that a crash can be told from: the checkpoint as not saved, portable entries, index, manifest, the checkpoint as saved."""
    spark = index.sparkSession
    if checkpoint:
        point(spark, f"{root}/checkpoint", "saving", checkpoint)
    save(portable.orderBy("path"), f"{root}/portable")
    save(index, f"{root}/index")
    save(manifest, f"{root}/manifest")
    if checkpoint:
        point(spark, f"{root}/checkpoint", "saved", checkpoint)


def checkpoint_saved(spark: SparkSession, root: str) -> bool:
    return current(spark, f"{root}/checkpoint") == "saved"


def clear_checkpoint(spark: SparkSession, root: str) -> None:
    fs, p = _fs(spark, f"{root}/checkpoint")
    fs.delete(p, True)
