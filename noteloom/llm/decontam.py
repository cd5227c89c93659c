"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: every task keeps, for its own block of documents, a posting
list of token positions for each term (a position names a document and a place in it, since the
block's tokens are numbered through). All posting lists of a document thus lie together and a
search needs no shuffle. A phrase is searched from its rarest term: that term's postings, shifted
by the term's offset in the phrase, are intersected with the shifted lists of the other terms, next
rarest first, until none is left or all terms agree.

Test items are the queries. They are sent to the tasks in blocks whose size is checked against
``block_bytes``; a larger set takes more blocks, each of them searched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, Scratch, U64, row_slices, runs, utf8, words

#: Bytes 00-2F, 3A-60 and 7B-7F separate words (after lower-casing A-Z).
GAP = np.zeros(256, bool)
GAP[0:0x30] = GAP[0x3A:0x61] = GAP[0x7B:0x80] = True

HITS = "doc_id long, row_id long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>, near array<string>"


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and text index of each word, and the number of texts."""
    offsets, data = utf8(col)
    data = LOWER[data]
    starts, ends, docs = words(offsets, data, GAP)
    return Rolling(data).ranges(starts, ends), docs, len(offsets) - 1


class Windows:
    """The windows of a block of items: ``window`` consecutive words, or all words of a shorter item."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        hashes, item, _ = tokens(pa.array(texts, pa.large_string()))
        self.ids, self.vocabulary = ids, np.unique(hashes)
        term = np.searchsorted(self.vocabulary, hashes)
        phrases: dict[bytes, set[int]] = {}
        bounds = runs(item)
        self.terms: dict[int, np.ndarray] = {}
        for lo, hi in zip(bounds, np.append(bounds, len(item))[1:], strict=True):
            self.terms[int(item[lo])] = np.unique(term[lo:hi])
            for at in range(lo, max(hi - window, lo) + 1):
                phrases.setdefault(term[at : min(at + window, hi)].tobytes(), set()).add(int(item[lo]))
        self.phrases = [(np.frombuffer(k, term.dtype), sorted(v)) for k, v in phrases.items()]
        size = max((len(p) for p, _ in self.phrases), default=0)
        self.matrix = np.full((len(self.phrases), size), len(self.vocabulary), np.int64)  # the last column stands for no term
        for i, (p, _) in enumerate(self.phrases):
            self.matrix[i, : len(p)] = p


class Postings:
    """Position lists by term for a block of documents; only terms of the test vocabulary are ever asked for."""

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, vocabulary: np.ndarray):
        at = np.searchsorted(vocabulary, hashes)
        at[at == len(vocabulary)] = 0
        known = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
        self.docs = docs
        term = at[known]
        order = np.argsort(term, kind="stable")
        self.positions = known[order]
        self.first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        self.sizes = np.append(np.diff(self.first), np.iinfo(np.int64).max)

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the phrase starts, within one document."""
        order = np.argsort(self.sizes[terms], kind="stable")
        found = self.of(terms[order[0]]) - order[0]
        found = found[(found >= 0) & (found + len(terms) <= len(self.docs))]
        for k in order[1:]:
            if not len(found):
                return found
            own, want = self.of(terms[k]), found + k
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            found = found[own[at] == want]
        return found[self.docs[found] == self.docs[found + len(terms) - 1]]

    def near(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Documents in which some ``reach`` successive words hold all terms. The last of these words is a term, and the rarest term stands among them."""
        rare = self.of(terms[np.argmin(self.sizes[terms])])

        def within(p: np.ndarray, own: np.ndarray) -> np.ndarray:
            """Those of p that have a position of ``own`` in their document, at them or fewer than ``reach`` words before."""
            last = own[np.maximum(np.searchsorted(own, p, "right") - 1, 0)]
            return p[(last <= p) & (p - last < reach) & (self.docs[last] == self.docs[p])]

        ends = np.concatenate([within(self.of(t), rare) for t in terms])
        for t in terms[np.argsort(self.sizes[terms], kind="stable")]:
            ends = within(ends, self.of(t))
            if not len(ends):
                break
        return np.unique(self.docs[ends])


def search(docs: DataFrame, items: DataFrame, window: int = 13, proximity: int | None = None, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: n_words, the token spans hit by a window, the items found, and with ``proximity``
    also the items all of whose words stand among so many successive words (column near).

    docs: doc_id, text. items: item_id, text. Null and empty texts have no words and are never hit;
    such items are never found. Null item_id: found, but not named. Repeated rows are treated each for itself;
    repeated items count once by id. Other columns are ignored. Empty tables give no rows, or no hits. Texts are searched whole; memory: a
    text, or 8 MiB of texts, with its postings, and the windows of ``block_bytes`` of items.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    src = src.withColumn("row_id", F.monotonically_increasing_id())
    if blocks > 1:  # written, so that every block sees the same numbers
        src = Scratch(docs.sparkSession).save("numbered", src)

    def one(block: int) -> DataFrame:
        part = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.collect()  # at most about block_bytes
        shared = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = Windows(*shared.value, window)
            for batch in batches:
                for piece in row_slices(batch, "text", 8 << 20):
                    yield scan(piece, queries)

        def scan(batch: pa.RecordBatch, queries: Windows) -> pa.RecordBatch:
            hashes, owner, n = tokens(batch.column(1))
            index = Postings(hashes, owner, queries.vocabulary)
            hit = np.zeros(len(hashes) + 1, np.int64)
            found: dict[int, set[int]] = {}
            near: dict[int, set[int]] = {}
            if len(queries.phrases) and len(hashes):
                for i in np.flatnonzero(index.sizes[queries.matrix].min(axis=1) > 0):
                    terms, its = queries.phrases[i]
                    at = index.phrase(terms)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + len(terms), -1)
                    for d in np.unique(owner[at]).tolist():
                        found.setdefault(d, set()).update(its)
                if proximity is not None:
                    for item, terms in queries.terms.items():
                        if index.sizes[terms].min() > 0:
                            for d in index.near(terms, proximity).tolist():
                                near.setdefault(d, set()).add(item)
            covered = np.cumsum(hit[:-1]) > 0
            first = np.searchsorted(owner, np.arange(n + 1))
            spans: list[list] = [[] for _ in range(n)]
            if covered.any():
                change = covered.copy()
                change[1:] &= ~(covered[:-1] & (owner[1:] == owner[:-1]))
                last = covered.copy()
                last[:-1] &= ~(covered[1:] & (owner[1:] == owner[:-1]))
                for lo, hi in zip(np.flatnonzero(change).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True):
                    d = int(owner[lo])
                    spans[d].append({"lo": lo - int(first[d]), "hi": hi - int(first[d])})
            names = lambda m, d: sorted({queries.ids[k] for k in m.get(d, ()) if queries.ids[k] is not None})
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array([names(found, d) for d in range(n)], pa.list_(pa.string())), pa.array([names(near, d) for d in range(n)], pa.list_(pa.string()))],
                names=["doc_id", "row_id", "n_words", "spans", "items", "near"],
            )

        return src.mapInArrow(run, HITS)

    out = one(0)
    if blocks == 1:
        return out.drop("row_id")
    for b in range(1, blocks):
        out = out.unionByName(one(b))
    return out.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")).drop("row_id")


def hits(found: DataFrame) -> DataFrame:
    """Adds n_hit, the number of words in the union of the spans."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(acc["end"], x["lo"]))).alias("n"), F.greatest(acc["end"], x["hi"]).alias("end"))
    return found.withColumn("n_hit", F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, proximity: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans, near and contaminated: at least one word in ``share`` is hit. See ``search``."""
    return hits(search(docs, items, window, proximity)).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
