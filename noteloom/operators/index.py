"""Index maintenance: manifests, changes, upserts, portable objects, failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V


def source_hash(sources: DataFrame) -> DataFrame:
    return sources.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))


def changed(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources whose (path, hash) the manifest does not have."""
    return now.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the new rows' sources are replaced."""
    return index.join(new.select("path").distinct(), "path", "left_anti").unionByName(new)


def last_value(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal key the last by ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def retained(rows: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(live.select(key).distinct(), key, "left_semi")


def portable_objects(chunks: DataFrame, size: int = 64) -> DataFrame:
    """Groups of ``size`` chunks of a source, addressed by the hash of their content."""
    g = chunks.groupBy("path", F.floor(F.col("chunk_index") / size).cast("long").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("body"), F.count("*").alias("n_chunks"))
    return g.select("path", "part", "n_chunks", F.sha2("body", 256).alias("address"))


def failures(log: DataFrame) -> DataFrame:
    """log (path, ts, message) to one row per path: first and last time, last message, attempts."""
    return log.groupBy("path").agg(F.min("ts").alias("first_failed_at"), F.max("ts").alias("last_failed_at"), F.max_by("message", F.struct("ts", "message")).alias("message"), F.count("*").alias("attempts"))


def profile_status(profile: DataFrame, version: int, provider: str, identity: str, dimensions: int, pdf: bool) -> DataFrame:
    """Why a stored index cannot be used; ready if it can."""
    checks = [("version", F.col("index_version") != version), ("provider", F.col("provider") != provider), ("identity", F.col("identity") != identity), ("dimensions", F.col("dimensions") != dimensions), ("pdf", F.col("index_pdf") != pdf)]
    status = F.lit("ready")
    for name, bad in reversed(checks):
        status = F.when(bad, f"rebuild: {name}").otherwise(status)
    return profile.withColumn("status", status)


# ---------------------------------------------------------------- failures


def record(stored: DataFrame, log: DataFrame) -> DataFrame:
    """Stored failures with new ones: a path keeps its first time and takes the last message; attempts are as the last message says."""
    new = failures(log).withColumn("attempts", V.attempts(F.col("message")))
    both = stored.select(*new.columns).unionByName(new)
    last = F.max_by(F.struct("message", "attempts"), F.struct("last_failed_at", "message"))
    return both.groupBy("path").agg(F.min("first_failed_at").alias("first_failed_at"), F.max("last_failed_at").alias("last_failed_at"), last.alias("m")).select("path", "first_failed_at", "last_failed_at", "m.message", "m.attempts")


def cleared(stored: DataFrame, done: DataFrame) -> DataFrame:
    """Without the paths that were indexed since."""
    return stored.join(done.select("path").distinct(), "path", "left_anti")


def by_last_failure(stored: DataFrame) -> DataFrame:
    return stored.orderBy(F.col("last_failed_at").desc(), "path")


def retry_outcomes(asked: DataFrame, sources: DataFrame, tried: DataFrame, ready: bool = True, index_pdf: bool = True) -> DataFrame:
    """What becomes of paths that are to be indexed again: busy while the index is not ready, missing, not-indexable, failed or success.
    tried: path, error (null if it went well)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = asked.select("path").distinct().join(sources.select("path", F.lit(True).alias("there")).distinct(), "path", "left").join(tried.groupBy("path").agg(F.max("error").alias("error")), "path", "left")
    outcome = F.when(F.lit(not ready), "busy").when(F.col("there").isNull(), "missing").when(~ext.isin(*(["md", "pdf"] if index_pdf else ["md"])), "not-indexable").when(F.col("error").isNotNull(), "failed").otherwise("success")
    return rows.select("path", outcome.alias("outcome"))


# ---------------------------------------------------------------- rebuilds


def pending(files: DataFrame, manifest: DataFrame, by_hash: bool = True) -> DataFrame:
    """Files (path, mtime, hash) that a resumed rebuild still has to index: those whose kind and hash the manifest lacks; without ``by_hash``
    the time of change stands for the hash."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext == "pdf", "pdf").otherwise("markdown")
    keys = ["path", "source_type", "hash" if by_hash else "mtime"]
    return files.withColumn("source_type", kind).join(manifest.select(*keys), keys, "left_anti")


#: What a checkpoint and a manifest must share with the present settings.
PROFILE = ("index_version", "provider", "identity", "dimensions", "index_pdf")


def can_resume(checkpoints: DataFrame, now: DataFrame) -> DataFrame:
    """checkpoints (run, snapshot_saved, and of the checkpoint and its manifest each value of PROFILE, as c_ and m_), now (one row of them): run, resumes."""
    same = F.lit(True)
    for p in PROFILE:
        same = same & F.col(f"c_{p}").eqNullSafe(F.col(p)) & F.col(f"m_{p}").eqNullSafe(F.col(p))
    one = now.select(*PROFILE).limit(1)
    return checkpoints.crossJoin(F.broadcast(one)).select("run", (F.coalesce("snapshot_saved", F.lit(False)) & same).alias("resumes"))


def status(counts: DataFrame, profile_ok: bool, busy: bool, error: str | None = None) -> DataFrame:
    """counts (n_sources, n_chunks) with the index's state and what is said of it."""
    state = "error" if error else "indexing" if busy else "ready" if profile_ok else "needs-rebuild"
    said = F.lit(error) if error else F.concat(F.col("n_sources").cast("string"), F.lit(" sources, "), F.col("n_chunks").cast("string"), F.lit(" chunks"))
    return counts.select(F.lit(state).alias("state"), said.alias("message"), "n_sources", "n_chunks")


# ---------------------------------------------------------------- portable entries


def portable_hits(wanted: DataFrame, entries: DataFrame, objects: DataFrame, dimensions: int) -> DataFrame:
    """wanted (path, hash), entries (path, hash, address, n_chunks), objects (address, path, chunk_index, vector) to the entries that can be used again: path, hash.

    An entry is a miss if its hash differs, if an object is missing, holds another path's chunks or a vector of another width, or if
    its chunks are more or fewer than it says.
    """
    own = wanted.join(entries, ["path", "hash"]).select("path", "hash", "address", "n_chunks")
    rows = own.join(objects.select("address", F.col("path").alias("of"), "chunk_index", F.size("vector").alias("width")), "address", "left")
    good = F.col("of").isNotNull() & (F.col("of") == F.col("path")) & (F.col("width") == dimensions)
    whole = rows.groupBy("path", "hash").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good"), F.count("chunk_index").alias("n"))
    said = own.groupBy("path", "hash").agg(F.sum("n_chunks").alias("want"))
    return whole.join(said, ["path", "hash"]).filter("good and n = want").select("path", "hash")


def absent(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """Objects whose address is not stored yet; objects of one address are written once."""
    return objects.dropDuplicates(["address"]).join(stored.select("address"), "address", "left_anti")


def reused(prepared: DataFrame, stored: DataFrame, embedded) -> DataFrame:
    """prepared (path, hash, source_type, ...) with stored (path, hash, source_type, vector): rows whose path, hash and type are stored take its vector, and only the rest
    is embedded, by ``embedded`` (rows to rows with vector)."""
    keys = ["path", "hash", "source_type"]
    have = stored.select(*keys, "vector").dropDuplicates(keys)
    return prepared.join(have, keys).unionByName(embedded(prepared.join(have, keys, "left_anti")))
