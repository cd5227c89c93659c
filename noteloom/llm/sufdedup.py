"""Repeated byte strings by suffix order and longest-previous-factor arrays.

Suffixes matter only where a string of ``length`` bytes stands twice, so the corpus is thinned first:
of every window of ``length`` bytes the smallest ``gram``-byte hash inside (leftmost in a tie) is its
anchor. Equal windows have equal anchors at the same place, so windows need be compared only within
an anchor's group. Consecutive windows with one anchor form a slice.

1. One pass counts anchors; a second keeps the slices of anchors that occur more than once.
2. Slices with equal content are counted together, first within a batch of texts; only one of each content
   goes on. All windows of a slice that occurs twice are repeated; each batch that holds it hears so once.
3. Distinct slices that share an anchor are sent to one task, which sorts the suffixes that start in
   their windows, takes longest common prefixes of neighbours, and finds for each suffix, by the
   previous and next smaller positions in suffix order, the longest previous factor (and the longest
   following one by the larger positions). Suffixes are cut after ``length`` bytes.
4. Windows with a factor of ``length`` bytes are repeated; their bytes are merged into spans.

Groups are pre-aggregated by content before any shuffle that gathers bytes, so a passage that a third
of all documents hold costs one slice there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, U64, binary_array, mix, partitions_for, ragged, row_slices, runs, signed, utf8

#: Places in a buffer take 31 bits, as many as a text in Spark can have; the hash keeps the other 33.
PLACE = U64((1 << 31) - 1)


def anchors(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, content, doc, start, count) of each slice: its anchor's hash, the hash of its content, its text,
    the first window's start in the text and the number of windows."""
    rolling = Rolling(data)
    g = rolling.grams(gram)
    none = tuple(np.zeros(0, t) for t in (U64, U64, np.int64, np.int64, np.int64))
    m = len(data) - length + 1
    if m <= 0:
        return none
    key = (g & ~PLACE) | np.arange(len(g), dtype=U64)
    # Minimum over length - gram + 1 neighbours by doubling.
    span, want = 1, length - gram + 1
    while span * 2 <= want:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < want:
        key = np.minimum(key[: m + 0], key[want - span : want - span + m])
    at = (key[:m] & PLACE).astype(np.int64)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return none
    starts = ragged(offsets[long], size[long] - length + 1)
    doc = np.repeat(long, size[long] - length + 1)
    a = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    lo = starts[first]
    anchor = a[first]
    content = mix(rolling.ranges(lo, lo + count - 1 + length) + (anchor - lo).astype(U64))
    return g[anchor], content, doc[first], lo - offsets[doc[first]], count


PLACES = "array<struct<doc_id:long,row_key:long,start:int,n:int>>"


def slices_of(docs: DataFrame, length: int, gram: int, full: bool) -> DataFrame:
    """docs: row_key, doc_id, text (binary). Without ``full``: key and n, the anchors counted within each batch. With it:
    a row for each distinct content of a batch (batch, key, content, places), however often it stands there."""
    place = pa.struct([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in row_slices(batch, "text", 2 << 20):
                offsets, data = utf8(part.column(2))
                key, content, doc, start, count = anchors(offsets, data, length, gram)
                if full:
                    order = np.lexsort((content, key))
                    key, content, doc, start, count = (x[order] for x in (key, content, doc, start, count))
                    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1]))) if len(key) else np.zeros(0, np.int64)
                    own = pa.array(doc, pa.int64())
                    places = pa.StructArray.from_arrays([part.column(1).take(own), part.column(0).take(own), pa.array(start, pa.int32()), pa.array(count, pa.int32())], fields=list(place))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), places)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), number)), pa.array(signed(key[first])), pa.array(signed(content[first])), lists], names=["batch", "key", "content", "places"])
                    number += 1
                else:
                    k, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return docs.mapInArrow(run, f"batch long, key long, content long, places {PLACES}" if full else "key long, n long")


def joined_spans(members: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """row_key and spans (array of struct(lo, hi)), from whole slices (batch, places, first). Neighbours make one span, so that there is a row for each
    text of a batch, not for each slice. With ``keep_first`` the place ``first`` stays out."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = t.column("places").combine_chunks()
        flat = lists.flatten()
        row, start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        if keep_first:
            each = np.diff(lists.offsets.to_numpy())
            first = t.column("first").combine_chunks()
            on = np.zeros(len(row), bool)
            for i in range(3):
                on |= flat.field(i).to_numpy(zero_copy_only=False) != np.repeat(first.field(i).to_numpy(zero_copy_only=False), each)
            row, start, n = row[on], start[on], n[on]
        order = np.lexsort((start, row))
        row, lo, hi = row[order], start[order], (start + n - 1 + length)[order]
        # Slices of one text stand in order and those of one length of windows end in order too.
        new = np.append(True, (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])) if len(row) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        top = np.maximum.reduceat(hi, begin) if len(begin) else hi
        row, lo = row[begin], lo[begin]
        text = runs(row)
        spans = pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(top, pa.int64())], ["lo", "hi"])
        return pa.table({"row_key": pa.array(row[text], pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(np.append(text, len(row)), pa.int32()), spans)})

    return members.groupBy("batch").applyInArrow(run, "row_key long, spans array<struct<lo:long,hi:long>>")


def previous_smaller(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest following factors.

    order: the suffixes' positions in suffix order; lcp[i]: the common prefix of order[i-1] and order[i]
    (lcp[0] = 0). A position's longest previous factor is the larger of the common prefixes with the nearest
    smaller positions above and below it in suffix order; following factors take the larger positions.
    """
    n = len(order)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for out, sign in ((before, 1), (after, -1)):
        for step in (1, -1):
            stack: list[tuple[int, int]] = []  # (position, least common prefix from it to the next one on the stack)
            for i in range(n) if step == 1 else range(n - 1, -1, -1):
                common = int(lcp[i]) if step == 1 else int(lcp[i + 1]) if i + 1 < n else 0
                p = sign * int(order[i])
                while stack and stack[-1][0] >= p:
                    # An equal position is the same suffix; it is no other occurrence.
                    common = min(common, stack.pop()[1])
                if stack:
                    out[i] = max(out[i], common)
                stack.append((p, common))
    return before, after


def factors(blob: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int, chunk: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """For each start: whether its ``length`` bytes also start at a smaller rank, and at a larger one."""
    m = len(starts)
    earlier, later = np.zeros(m, bool), np.zeros(m, bool)
    if not m:
        return earlier, later
    padded = np.concatenate([blob, np.zeros(length + 8, np.uint8)])
    head = np.zeros(m, U64)
    for k in range(8):
        head = (head << U64(8)) | padded[starts + k]
    major = np.argsort(head, kind="stable")
    bounds = np.append(runs(head[major]), m)
    lo = 0
    view = np.lib.stride_tricks.sliding_window_view(padded, length)
    while lo < m:
        hi = int(bounds[max(np.searchsorted(bounds, lo + chunk, "right") - 1, np.searchsorted(bounds, lo, "right"))])
        pick = major[lo:hi]
        lo = hi
        rows = np.ascontiguousarray(view[starts[pick]])
        order = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
        rows, pick = rows[order], pick[order]
        words = rows[:, : length // 8 * 8].view(U64)
        same = (words[1:] == words[:-1]).all(1) & (rows[1:, length // 8 * 8 :] == rows[:-1, length // 8 * 8 :]).all(1)
        # Only suffixes next to one with which they share ``length`` bytes can have such a factor. Within a run
        # of them all common prefixes are ``length``, and between runs they are shorter.
        linked = np.zeros(len(pick), bool)
        linked[1:] |= same
        linked[:-1] |= same
        at = np.flatnonzero(linked)
        if not len(at):
            continue
        lcp = np.where(np.concatenate([[False], same])[at], length, 0)
        before, after = previous_smaller(rank[pick[at]], lcp)
        earlier[pick[at]] = before >= length
        later[pick[at]] = after >= length
    return earlier, later


def repeats(docs: DataFrame, length: int = 200, gram: int = 100, keep_first: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """row_key (hash of doc_id and text) and spans (array of struct(lo, hi)), byte
    ranges covered by windows of ``length`` bytes that also start elsewhere; with ``keep_first`` only by windows
    that also start earlier, in an order by doc_id and place, so that the first copy stays.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    src = rows.select("row_key", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = slices_of(src, length, gram, False).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    often = scratch.save("often", counted)
    scratch.release()
    got = scratch.save("slices", slices_of(src, length, gram, True).join(often, "key"))
    scratch.drop("often")
    least = F.min(F.array_min("places"))  # by doc_id, row_key, start
    distinct = scratch.save("distinct", got.groupBy("key", "content").agg(F.sum(F.size("places")).alias("times"), least.alias("first")))
    shared = distinct.groupBy("key").agg(F.min("content").alias("x"), F.max("content").alias("y")).filter("x <> y").select("key")
    shared = scratch.save("shared", shared)
    twice = distinct.filter("times > 1").select("key", "content", "first")
    whole = joined_spans(got.join(twice, ["key", "content"]).select("batch", "places", "first"), length, keep_first)
    # Slices to be sorted: one of each content, of anchors with several contents.
    picked = distinct.join(shared, "key").select(F.col("first.row_key").alias("row_key"), F.struct("key", F.col("first.start").alias("start"), F.col("first.n").alias("n")).alias("s"))
    picked = scratch.save("picked", picked.groupBy("row_key").agg(F.collect_list("s").alias("s"), F.sum(F.col("s.n") + length).alias("bytes")))
    total = picked.agg(F.sum("bytes")).first()[0] or 0
    scratch.drop("shared")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 2 << 20):
                offsets, data = utf8(part.column(2))
                lists = part.column(3)
                flat = lists.flatten()
                each = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                own = np.repeat(np.arange(len(each)), each)
                start, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
                size = n - 1 + length
                blob = data[ragged(offsets[own] + start, size)]
                at = np.concatenate([[0], np.cumsum(size)])
                own_ids = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([flat.field(0), part.column(0).take(own_ids), part.column(1).take(own_ids), pa.array(start, pa.int32()), binary_array(blob, at)], names=["key", "row_key", "doc_id", "start", "bytes"])

    texts = src.join(picked.select("row_key", "s"), "row_key")
    bytes_ = texts.select("row_key", "doc_id", "text", "s").mapInArrow(cut, "key long, row_key long, doc_id long, start int, bytes binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        row, doc, start = (t.column(i).to_numpy() for i in (1, 2, 3))
        offsets, blob = utf8(t.column(4))
        # Repeated rows give the same slice more than once; one of each is enough.
        by = np.lexsort((start, row, doc))
        new = np.ones(len(by), bool)
        new[1:] = (row[by][1:] != row[by][:-1]) | (start[by][1:] != start[by][:-1]) | (doc[by][1:] != doc[by][:-1])
        by = by[new]
        n = np.diff(offsets)[by] - length + 1
        starts = ragged(offsets[:-1][by], n)
        rank = np.arange(len(starts))  # slices are in order of place, and of one row do not share windows
        earlier, later = factors(blob, starts, rank, length)
        on = earlier if keep_first else earlier | later
        edge = np.zeros(len(on), bool)
        edge[np.cumsum(n) - n] = True
        begin = np.flatnonzero(on & (edge | ~np.concatenate([[False], on[:-1]])))
        stop = np.flatnonzero(on & np.concatenate([edge[1:] | ~on[1:], [True]])) if len(on) else begin
        owner = np.repeat(np.arange(len(by)), n)
        inside = np.arange(len(on)) - np.repeat(np.cumsum(n) - n, n)
        s = owner[begin]
        lo = start[by][s] + inside[begin]
        hi = start[by][s] + inside[stop] + length
        # A row for each text: slices are in order of their texts.
        row = row[by][s]
        first = runs(row)
        span = pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["lo", "hi"])
        yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), span)], names=["row_key", "spans"])

    tasks = partitions_for(total, 4 << 20)
    sorted_ = bytes_.repartition(tasks, "key").mapInArrow(sort, "row_key long, spans array<struct<lo:long,hi:long>>")
    found = whole.unionByName(sorted_)
    spans = scratch.save("spans", found.groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    scratch.drop("slices", "distinct", "picked")
    return spans


def dedup(docs: DataFrame, length: int = 200, gram: int = 100, keep_first: bool = True, keep: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """Removes repeated byte strings. Columns: doc_id and those named in ``keep``, kept (binary, the bytes left),
    n_bytes, n_removed, spans (maximal removed byte ranges, array of struct(lo, hi)).

    docs: doc_id, text; other columns are ignored. With ``keep_first`` the first copy by (doc_id, place) stays,
    without it all go. With ``whole_characters`` a character goes whole if any of its bytes does, so that kept is a
    text again. Null and empty texts, and those under ``length`` bytes, stay as they are. Rows that
    share doc_id and text count as one for ``keep_first`` and as copies of each other without it. Null doc_id
    comes last. Empty table: no rows. Memory: a document of up to 2 GiB, as Arrow and Spark hold it; or a batch's repeated slices; or
    about 4 MiB of distinct slices, more where one anchor has more slices of different content, all of which
    are sorted in one task.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [c for c in docs.columns if c in keep]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeats(base, length, gram, keep_first)
    # Columns of the caller's stay as they are; the text itself travels once.
    src = docs.select(*[F.col(c).alias(f"_{c}") for c in names if c != "text"], F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_key"), F.col("text").cast("string").alias("_text_"))
    joined = src.join(spans, "row_key", "left").select(*[F.col("_text_" if c == "text" else f"_{c}").alias(c) for c in names], F.coalesce("_text_", F.lit("")).cast("binary").alias("_bytes"), "spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    pair = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "_bytes", 2 << 20):
                k = part.num_columns - 2
                offsets, data = utf8(part.column(k))
                n = part.num_rows
                flat = part.column(k + 1).flatten()
                each = np.diff(part.column(k + 1).offsets.to_numpy()).astype(np.int64) if n else np.zeros(0, np.int64)
                own = np.repeat(np.arange(n), each)
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, offsets[own] + flat.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(cover, offsets[own] + flat.field(1).to_numpy(zero_copy_only=False), -1)
                gone = np.cumsum(cover[:-1]) > 0
                if whole_characters and len(data):
                    character = np.cumsum((data & 0xC0) != 0x80)
                    gone = (np.bincount(character, gone) > 0)[character]
                doc = np.repeat(np.arange(n), np.diff(offsets))
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))) if len(data) else np.zeros(0, np.int64)
                stop = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1 if len(data) else begin
                d = doc[begin] if len(data) else begin
                spans_ = pa.StructArray.from_arrays([pa.array(begin - offsets[d], pa.int64()), pa.array(stop - offsets[d], pa.int64())], ["lo", "hi"])
                count = np.bincount(d, minlength=n)
                at = np.concatenate([[0], np.cumsum(count)])
                left = np.bincount(doc[~gone], minlength=n)
                out_spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans_)
                size = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:k], binary_array(data[~gone], np.concatenate([[0], np.cumsum(left)])), pa.array(size, pa.int64()), pa.array(size - left, pa.int64()), out_spans.cast(pa.list_(pair))],
                    names=[*part.schema.names[:k], "kept", "n_bytes", "n_removed", "spans"],
                )

    return joined.mapInArrow(run, f"{kinds + ', ' if kinds else ''}kept binary, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>")

