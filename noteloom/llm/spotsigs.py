"""SpotSigs: signatures of content words that follow common words, with DataFrame functions alone.

A common word is an antecedent; with the next ``CHAIN`` content words (words that are not common) it
forms a spot signature. A text's fingerprint is the sorted list of its distinct signatures' hashes.
Likeness is the Jaccard coefficient of two fingerprints. For a search of near duplicates
fingerprints are partitioned by their length and compared only within the lengths, and after the
prefixes, that a given likeness allows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions_for

CHAIN = 2
# Common words of four languages; fixed values, as equal texts must have equal fingerprints everywhere.
COMMON = {
    "en": "a an and are as at be been but by can could did do for from had has have he her his i if in is it its not of on or our she so that the their there they this to was we were which will with would you",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qui que sa se ses son sont sur un une vous",
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es hat ich im in ist mit nach nicht noch oder sich sie sind so um und von vor war was wie wird zu zum zur",
    "es": "al como con de del el ella en es esta este fue ha la las lo los mas no o para pero por que se si sin sobre su sus un una y ya",
}
ANCHORS = sorted({w for words in COMMON.values() for w in words.split()})
_GLUE = "_"  # never part of a word


def fingerprinted(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the sorted distinct signature hashes (array of long) of column ``text``.

    Words are runs of letters and digits in lower case. They are joined by single spaces, and each
    common word is glued to what follows, so that splitting at spaces gives content words with the
    common words before them; each of these common words gives a signature of its own, with this content word and
    that of the next token. A text without any signature gets one over all its words; one without words gets none.
    Null is an empty text; a text of any length is one row's array. Of ``rows`` all columns stay but those named _plain, _tokens and _spots.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    glued = F.regexp_replace(F.col("_plain"), f"(?<= )({'|'.join(ANCHORS)}) ", f"$1{_GLUE}")
    rows = rows.withColumn("_plain", plain).withColumn("_tokens", F.split(F.trim(glued), " "))
    content = lambda x: F.substring_index(x, _GLUE, -1)
    chain = lambda x, y: F.concat(content(x), F.lit(" "), content(F.coalesce(y, F.lit(""))))
    anchors = lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - F.length(content(x)) - 1), _GLUE)
    spot = lambda x, y: F.when(F.contains(x, F.lit(_GLUE)), F.transform(anchors(x), lambda z: F.xxhash64(z, chain(x, y))))
    spots = F.flatten(F.array_compact(F.zip_with("_tokens", F.slice("_tokens", 2, F.greatest(F.size("_tokens"), F.lit(1))), spot)))
    rows = rows.withColumn("_spots", F.array_sort(F.array_distinct(spots)))
    whole = F.when(F.trim("_plain") == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64("_plain")))
    return rows.withColumn(out, F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(whole)).drop("_plain", "_tokens", "_spots")


def likeness(a: str, b: str) -> Column:
    """Jaccard coefficient of two fingerprints; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, both.cast("double") / all_).otherwise(F.lit(1.0))


def printed(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.hex(x)), ".")


def successors(docs: DataFrame, bucket_chars: int = 8_000_000, max_buckets: int = 1 << 20) -> DataFrame:
    """Adds ``next_text``, the text of the next row by doc_id; after the last comes the first.

    Rows are dealt to buckets by a piecewise linear estimate of the id's rank, so neighbours share a
    bucket; the first row of each bucket is also given to the bucket before. Texts move once. The
    table of first rows has one small row per bucket, at most ``max_buckets`` (16 MB), and is broadcast.
    Rows with equal doc_id follow each other by hash of their text, then by text; null ids come last.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max_buckets, partitions_for(total, bucket_chars))
    cuts = rows.filter("doc_id is not null").approxQuantile("_id", [i / 64 for i in range(65)], 1e-3) if buckets > 1 else []
    if cuts:
        marks = sorted({int(c) for c in cuts})
        seg = F.aggregate(F.array(*[F.lit(c).cast("long") for c in marks[1:]]), F.lit(0), lambda n, c: n + (F.col("_id") >= c).cast("int"))
        lo, hi = F.array(*[F.lit(c).cast("double") for c in marks]), F.array(*[F.lit(c).cast("double") for c in [*marks[1:], marks[-1] + 1]])
        part = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (F.col("_id") - F.get(lo, seg)) / (F.get(hi, seg) - F.get(lo, seg))))
        rows = rows.withColumn("_b", F.floor((seg + part) * (buckets / len(marks))).cast("int"))
    else:
        rows = rows.withColumn("_b", F.lit(0))
    first = rows.groupBy("_b").agg(F.min("_id").alias("_id"))
    back = F.lag("_b").over(W.orderBy("_b"))  # over one row per bucket
    last = F.max("_b").over(W.partitionBy(F.lit(1)))
    ghosts = first.select("_id", F.coalesce(back, last).alias("_to"), back.isNull().alias("_wrap"))
    copies = rows.join(F.broadcast(ghosts), "_id").select("doc_id", "text", "_id", F.col("_to").alias("_b"), F.lit(True).alias("_ghost"), "_wrap")
    both = rows.select("doc_id", "text", "_id", "_b", F.lit(False).alias("_ghost"), F.lit(False).alias("_wrap")).unionByName(copies)
    order = W.partitionBy("_b").orderBy("_ghost", "_wrap", "_id", F.xxhash64("text"), "text")
    return both.withColumn("next_text", F.lead("text").over(order))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints each text and its edited text: the last half of its code points replaced by the first as many
    of the next document. Columns: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint (arrays of
    long), near_edited, near_next.

    docs: doc_id, text; other columns are ignored. Null text is empty; two empty fingerprints are alike (1.0).
    A table of one row is its own next document. Repeated rows each give a row. Empty table: no rows.
    """
    order = W.partitionBy("_b").orderBy("_ghost", "_wrap", "_id", F.xxhash64("text"), "text")
    rows = fingerprinted(successors(docs), "text", "fingerprint").withColumn("_next", F.lead("fingerprint").over(order)).filter(~F.col("_ghost"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = fingerprinted(rows.withColumn("edited_text", edited), "edited_text", "edited_fingerprint")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited_text", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next").alias("near_next"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (a, b, likeness) of class representatives with likeness >= threshold, and each
    document's class (doc_id, class_id).

    Texts with equal fingerprints form a class, named by its smallest doc_id, so copies are never paired.
    Representatives are partitioned by fingerprint length; a pair can reach the threshold only if its
    lengths fall into the same or the next partition and it shares one of the first signatures of each.
    Documents without words, null or blank ones too, belong to no class. Rows that share a doc_id may be in several classes;
    a null doc_id names none, but takes part. Empty table: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save("prints", fingerprinted(docs.select("doc_id", "text"), "text", "sig").filter(F.size("sig") > 0).select("doc_id", "sig", F.sha2(printed("sig"), 256).alias("h")))
    classes = scratch.save("classes", prints.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig")))
    members = prints.select("doc_id", "h").join(classes.select("h", "class_id"), "h").select("doc_id", "class_id")
    reps = classes.select("h", "sig", F.size("sig").alias("n"))
    n = F.col("n")
    head = F.slice("sig", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    keys = reps.withColumn("p", F.floor(F.log(n) / math.log(1 / threshold)).cast("int")).select("h", "n", "p", F.explode(head).alias("s"))
    near = keys.withColumn("p", F.explode(F.array("p", F.col("p") + 1)))
    a, b = (df.select("s", "p", *[F.col(c).alias(f"{c}_{x}") for c in ("h", "n")]) for x, df in (("a", keys), ("b", near)))
    fits = (F.col("n_b") <= F.col("n_a")) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9) & (F.col("h_a") != F.col("h_b"))
    pairs = a.join(b, ["s", "p"]).filter(fits).select(F.least("h_a", "h_b").alias("l"), F.greatest("h_a", "h_b").alias("r")).distinct()
    side = lambda x: classes.select(F.col("h").alias(x), F.col("sig").alias(f"s{x}"), F.col("class_id").alias(f"c{x}"))
    both = pairs.join(side("l"), "l").join(side("r"), "r").withColumn("likeness", likeness("sl", "sr")).filter(F.col("likeness") >= threshold)
    return both.select(F.least("cl", "cr").alias("a"), F.greatest("cl", "cr").alias("b"), "likeness"), members
