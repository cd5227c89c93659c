"""MinHash near-duplicate detection with odd sketches.

1. One pass over the texts gives each document's shingle set digest, banded MinHash keys and an odd
   sketch: the parity bitmap of its MinHash samples. The number of bands follows from the threshold,
   so that a pair at the threshold is missed with a probability below 1e-6.
2. Documents with equal sets form a class; only its smallest id goes on, so copies are never paired.
3. Each bucket of a band elects its smallest member as hub, and every member is compared with the hubs
   of its buckets: a number of pairs linear in the documents, whatever the size of a bucket.
4. Members that are not linked to their hub are strays. A few of them, drawn by hash, are hubs in turn.
   What then still lies in another component is compared with those members of the hub that it can be
   linked to: 1 - Jaccard is a metric, so their distances from the hub differ by at most 1 - threshold; and
   their sets' differences from the hub must share elements, how many follows from their sizes, so that they
   have one in common among the first few in order of rarity (see ``confirm``), which copies with edits of
   their own have not.
   Before sets are compared, odd sketches, by the population count of their XOR, weed out pairs that are too
   far apart.
5. All candidates are confirmed on full sets; components follow from the confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, Rolling, Scratch, mix, ragged, row_slices, runs, seeds, signed, utf8, words
from .components import components

SKETCH_BITS = 1024


@dataclass(frozen=True)
class Rule:
    """Links need ``over * intersection >= under * union`` on sets of ``shingle`` words."""

    shingle: int = 5
    under: int = 80
    over: int = 100
    rows: int = 5
    miss: float = 1e-6
    draws: int = 2

    @property
    def threshold(self) -> float:
        return self.under / self.over

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(self.miss) / math.log(1 - min(self.threshold, 0.999) ** self.rows)))

    @property
    def most_bits(self) -> int:
        """Population count of the XOR of two odd sketches that a pair at the threshold exceeds with a probability of about 1e-6."""
        k = self.bands * self.rows
        differ = k * (1 - self.threshold) + 5 * math.sqrt(k * self.threshold * (1 - self.threshold))
        flips = 2 * differ
        return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips) + 4 * math.sqrt(2 * flips * flips / SKETCH_BITS))


def shingles(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes, sorted within each text, the text of each, and the number of texts.

    A text of fewer words than ``size`` has one shingle of all its words; one without words has none.
    """
    offsets, data = utf8(col)
    n = len(offsets) - 1
    starts, ends, owner = words(offsets, data, SPACE)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), n
    word = Rolling(LOWER[data]).ranges(starts, ends)
    first = runs(owner)
    count = np.diff(np.append(first, len(owner)))
    salt = seeds(size, 3)
    # Positions that have ``size`` words left in their text, or the first word of a shorter text.
    left = np.repeat(first + count, count) - np.arange(len(owner))
    at = np.flatnonzero((left >= size) | (np.isin(np.arange(len(owner)), first) & (left < size)))
    take = np.minimum(left[at], size)
    sums = take.astype(U64)
    for k in range(size):
        on = take > k
        sums[on] += mix(word[at[on] + k] * salt[k])
    sums = mix(sums)
    doc = owner[at]
    order = np.lexsort((sums, doc))
    sums, doc = sums[order], doc[order]
    new = np.ones(len(sums), bool)
    new[1:] = (sums[1:] != sums[:-1]) | (doc[1:] != doc[:-1])
    return sums[new], doc[new], n


def sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (set digest), bands (array of long), odd (array of long)."""
    bands, rows = rule.bands, rule.rows
    multipliers, adders = seeds(bands * rows, 11) | U64(1), seeds(bands * rows, 12)
    salts = seeds(bands * rows, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 2 << 20):
                sums, doc, n = shingles(part.column(1), rule.shingle)
                size = np.bincount(doc, minlength=n)
                h = np.zeros((2, n), np.int64)
                band, odd = np.zeros((n, bands), np.int64), np.zeros((n, SKETCH_BITS // 64), np.int64)
                if len(sums):
                    first = runs(doc)
                    has = doc[first]
                    least = np.empty((len(first), bands * rows), U64)
                    for i in range(bands * rows):
                        least[:, i] = np.minimum.reduceat(sums * multipliers[i] + adders[i], first)
                    h[0, has] = signed(mix(np.add.reduceat(mix(sums ^ salts[0]), first)))
                    h[1, has] = signed(mix(np.add.reduceat(mix(sums * U64(0x9E3779B97F4A7C15)), first)))
                    value = mix(least + salts)
                    key = mix(value.reshape(len(first), bands, rows).sum(2) + seeds(bands, 14))
                    band[has] = signed(key)
                    bit = (value % U64(SKETCH_BITS)).astype(np.int64) + np.arange(len(first))[:, None] * SKETCH_BITS
                    parity = np.bincount(bit.ravel(), minlength=len(first) * SKETCH_BITS).reshape(len(first), SKETCH_BITS) & 1
                    odd[has] = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(h[0]), pa.array(h[1]), lists(band), lists(odd)], names=["doc_id", "n_shingles", "h1", "h2", "bands", "odd"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, odd array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, both, either, size, marks): sizes of the intersection and union of the full sets of each pair (a, b),
    and of a's set.

    marks are the first elements of the symmetric difference of a's set and b's, in an order in which all
    elements outside of b's set come first. With alpha = (1 - threshold) / (1 + threshold), two sets A and B are
    linked only if |A ^ B| <= alpha * (|A| + |B|). With g(A) = |A ^ b| - alpha * |A|, their differences from b
    then share at least t = (g(A) + g(B)) / 2 elements, so the first one that they share is among the first
    |A ^ b| - t + 1 of A's and as many of B's. As g(A) >= g(B) - 2 * alpha * |A| and |A| <= |B| / threshold, no
    set needs more than its first alpha * |A| * (1 + 1 / threshold) + 1 elements; and the one of the two whose g
    is smaller needs no more than its first alpha * |A| + 1. All elements outside of b's set are given in any
    case, so that they can be put in order of rarity.
    """
    theta = rule.threshold
    share = (1 - theta) / (1 + theta) * (1 + 1 / theta)
    rows = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    rows = rows.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "ta", 1 << 20):
                (sa, da, n), (sb, db, _) = (shingles(part.column(i), rule.shingle) for i in (2, 3))
                s, d = np.concatenate([sa, sb]), np.concatenate([da, db])
                order = np.lexsort((s, d))
                s, d = s[order], d[order]
                same = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
                both = np.bincount(d[1:][same], minlength=n)
                either = np.bincount(d, minlength=n) - both
                # Elements of one set only: in b's set or not, then by hash.
                single = np.ones(len(s), bool)
                single[1:] &= ~same
                single[:-1] &= ~same
                of_b = np.concatenate([np.zeros(len(sa), bool), np.ones(len(sb), bool)])[order]
                s, d, of_b = s[single], d[single], of_b[single]
                order = np.lexsort((s, of_b, d))
                s, d = s[order], d[order]
                count = np.bincount(d, minlength=n)
                outside = np.bincount(da, minlength=n) - both
                take = np.maximum(outside, np.minimum(count, np.floor(np.bincount(da, minlength=n) * share + 1e-9).astype(np.int64) + 1))
                marks = s[ragged(np.cumsum(count) - count, take)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(signed(marks)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64()), pa.array(np.bincount(da, minlength=n), pa.int64()), lists], names=["a", "b", "both", "either", "size", "marks"])

    return rows.mapInArrow(run, "a long, b long, both long, either long, size long, marks array<long>")


def _flips():
    """Population count of the XOR of two odd sketches, columns odd_l and odd_r."""
    return sum((F.bit_count(F.get("odd_l", F.lit(i)).bitwiseXOR(F.get("odd_r", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: one row per document: doc_id, n_shingles, class_id (smallest id with the same
    set), component_id, kept. links: confirmed pairs (a, b, both, either) of class representatives.

    docs: doc_id, text; other columns are ignored. Null, empty and blank texts have no shingles and are linked with
    nothing: component_id is their own id. Null doc_id: n_shingles is counted, component_id is null, kept is
    true. Ids should be unique: rows that share a doc_id are in the same component if their texts are equal, and each gives a row; if
    their texts differ, the links of one of them may be lost.
    Empty table: no rows. Texts of any length are used whole.
    """
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = scratch.save("prints", sketch(src, rule))
    full = prints.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.save("classes", full.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id")))
    reps = scratch.save("reps", full.select("doc_id", "h1", "h2", "bands", "odd").join(classes, ["h1", "h2"]).filter("doc_id = class_id").dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "bands", "odd"))
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    hubs = scratch.save("hubs", keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).filter("hub <> other").select("key", "hub"))
    scratch.release()
    inside = scratch.save("inside", keys.join(hubs, "key").filter("doc_id <> hub"))
    first = scratch.save("first", inside.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
    needed = first.select(F.col("a").alias("doc_id")).unionByName(first.select(F.col("b").alias("doc_id"))).distinct()
    texts = scratch.save("texts", src.join(needed.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    del needed
    scratch.release()
    near = scratch.save("near", confirm(first, texts, rule))
    linked = F.lit(rule.over) * F.col("both") >= F.lit(rule.under) * F.col("either")
    # Members of hubs that have strays: n elements differ from the hub's, and g as in ``confirm``, times ``unit``.
    unit, slack = rule.over + rule.under, rule.over - rule.under
    reach = 1 - rule.threshold
    n = F.col("either") - F.col("both")
    far = near.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), (1 - F.col("both") / F.col("either")).alias("d"), linked.alias("linked"), n.alias("n"), (F.lit(unit) * n - F.lit(slack) * F.col("size")).alias("g"), (F.col("size") - F.col("both")).alias("own"), "marks")
    group = scratch.save("around", far.join(far.filter("not linked").groupBy("hub").agg(F.min("g").alias("g_stray")), "hub"))
    sketches = reps.select("doc_id", "odd")
    tried = first.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))

    def alike(pairs: DataFrame) -> DataFrame:
        both_ = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("odd").alias("odd_l")), "a").join(sketches.select(F.col("doc_id").alias("b"), F.col("odd").alias("odd_r")), "b")
        return both_.filter(_flips() <= rule.most_bits).select("a", "b")

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # A few strays of each hub, drawn by hash, are hubs in turn and gather most of the others.
    drawn = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(r))) for r in range(rule.draws)]
    elected = group.filter("not linked").groupBy("hub").agg(F.array_distinct(F.array(*drawn)).alias("e")).select("hub", F.explode("e").alias("e"))
    elected = scratch.save("elected", elected)
    pairs = group.select("hub", "doc_id").join(elected, "hub").filter("doc_id <> e").select(*ordered("doc_id", "e")).distinct()
    again = scratch.save("again", alike(pairs.join(tried, ["a", "b"], "left_anti")))
    near2 = scratch.save("near2", confirm(again, texts, rule))
    found = scratch.save("joined", components(near.unionByName(near2).filter(linked).select("a", "b"), scratch))
    # What is left: strays against members of other components that share a mark of the same hub.
    component = F.coalesce("component", "doc_id").alias("component")
    marked = group.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("hub", "doc_id", "d", "n", "g", "g_stray", "own", "linked", component, F.posexplode("marks").alias("at", "mark"))
    several = marked.groupBy("hub", "mark").agg(F.count("*").alias("times"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("linked").alias("all_linked")).filter("x <> y and not all_linked").select("hub", "mark", "times")
    several = scratch.save("several", several)
    # Marks outside of the hub's set in order of rarity, after those that link nothing; the hub's own keep their places.
    common = marked.join(several, ["hub", "mark"]).withColumn("of_hub", F.col("at") >= F.col("own"))
    here = W.partitionBy("hub", "doc_id")
    place = F.col("own") - F.count_if(~F.col("of_hub")).over(here) + F.row_number().over(here.orderBy("of_hub", "times", "mark")) - 1
    common = common.withColumn("at", F.when(F.col("of_hub"), F.col("at")).otherwise(place))
    # Of two, the one with the smaller g has the shared mark among its first n - t + 1 (column low).
    least = F.ceil((F.col("g") + F.greatest("g", "g_stray")) / (2 * unit))
    parted = scratch.save("parted", common.withColumn("low", F.col("at") <= F.col("n") - least).drop("g_stray", "own", "of_hub", "times"))
    l, r = (parted.select("hub", "mark", *[F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "d", "n", "g", "at", "linked", "component", "low")]) for s in "lr")
    apart = (F.col("component_l") != F.col("component_r")) & (F.abs(F.col("d_l") - F.col("d_r")) <= reach + 1e-9) & ~(F.col("linked_l") & F.col("linked_r"))
    turn = F.struct("g_l", "doc_id_l") < F.struct("g_r", "doc_id_r")
    enough = F.lit(2 * unit) * F.least(F.col("n_l") - F.col("at_l"), F.col("n_r") - F.col("at_r")) >= F.col("g_l") + F.col("g_r")
    pairs = l.filter("low_l").join(r, ["hub", "mark"]).filter(apart & turn & enough).select(*ordered("doc_id_l", "doc_id_r")).distinct()
    second = scratch.save("second", alike(pairs.join(tried.unionByName(again), ["a", "b"], "left_anti")))
    more = scratch.save("more", confirm(second, texts, rule).filter(linked))
    links = scratch.save("links", near.unionByName(near2).filter(linked).unionByName(more).drop("size", "marks"))
    # The last links join components, so only these are gathered again.
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    bridges = more.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = scratch.save("merged", components(bridges, scratch).select(F.col("node").alias("component"), F.col("component").alias("last")))
    nodes = found.unionByName(merged.select(F.col("component").alias("node"), "component").join(found.select("node"), "node", "left_anti"))
    found = scratch.save("components", nodes.join(merged, "component", "left").select("node", F.coalesce("last", "component").alias("component")))
    group = classes.join(found, F.col("class_id") == F.col("node"), "left").select("h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component"))
    group = scratch.save("groups", group)
    out = prints.select("doc_id", "n_shingles", "h1", "h2").join(group, ["h1", "h2"], "left").drop("h1", "h2")
    mine = F.when(F.col("doc_id").isNull(), None).otherwise(F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    members = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"), mine.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return members, links
