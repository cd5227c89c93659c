"""Context-tree weighting over bytes.

A text is a sequence of words and one end. A word is its bytes (A-Z lower-cased) and a space, the end
is a line feed; a byte's context is the ``depth`` bytes before it in its text, across words. The text's
beginning counts as a space. Each byte is decomposed into eight binary decisions. Every context of every
depth keeps, for each of the 255 decision nodes, the counts of zeros and ones in the training texts; its
Krichevsky-Trofimov estimate is mixed with what its longer contexts say, by the posterior weights of
context-tree weighting. The sum of the logarithms is the code length.

Nothing of the model is limited in size but the depth.

1. Texts are written once as batches: word numbers per text, and groups of the batch's distinct (context,
   byte) pairs by their two nearest bytes and of its distinct words by hash, sorted and packed, with counts.
2. A task for each group adds up its batches, one after the other, and writes the sums; for contexts it
   weighs whole subtrees up to depth 2. Only sums over the nodes of depth 1 (at most 256 * 255) are gathered.
3. Sums and packs meet again by group: a batch's pack is answered with its probabilities or word counts in
   the same order, as soon as it is read.
4. Answers meet their batch's texts, whose contexts are computed anew, and are summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, Scratch, U64, binary_array, partitions_for, ragged, row_slices, runs, trim, utf8, words

END, SPACE = 10, 32
#: Words are dealt to 2 ** 10 groups by the highest bits of their hash; group -1 - g holds them.
WORD_BITS = 10


# ---------------------------------------------------------------- packing


def varints(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes, seven bits each and lowest first, the high bit set but in the last; and the cuts ``at`` in bytes."""
    size = np.ones(len(values), np.int64)
    bits, most = 7, int(values.max(initial=0))
    while most >> bits:
        size += values >= 1 << bits
        bits += 7
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[ends[on] + k] = ((values[on] >> (7 * k)) & 127) | ((size[on] > k + 1) << 7)
    return out, ends[at]


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - first + 1
    out = np.zeros(len(last), np.int64)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[on] |= (data[first[on] + k].astype(np.int64) & 127) << (7 * k)
    return out


def merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(key)
    key = key[order]
    start = runs(key)
    return key[start], np.add.reduceat(n[order], start) if len(start) else n


def packed_keys(key: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """For each two nearest bytes: these, the cuts between them, their keys as differences and the keys' counts (``varints``)."""
    shift = 8 * (depth - 1)
    near = key >> shift
    start = runs(near)
    ends = np.append(start, len(key))
    gap = np.diff(key, prepend=0)
    gap[start] = key[start] - (near[start] << shift)
    return near[start], ends, binary_array(*varints(gap, ends)), binary_array(*varints(n, ends))


def unpacked_keys(near: int, keys: bytes, depth: int) -> np.ndarray:
    return np.cumsum(unpacked(np.frombuffer(keys, np.uint8))) + (near << (8 * (depth - 1)))


def spelled(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that are each followed by a space."""
    ends = np.flatnonzero(blob == SPACE)
    return np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends


def word_keys(blob: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each word of ``spelled``, as a row of two numbers."""
    lo, hi = spelled(blob)
    return np.stack([Rolling(blob).ranges(lo, hi), Rolling(255 - blob).ranges(lo, hi)], 1)


def found_at(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each of ``key``, all of which are there, stands in the ordered ``keys``."""
    if keys.ndim == 1:
        return np.searchsorted(keys, key)
    at = np.searchsorted(np.ascontiguousarray(keys[:, 0]), key[:, 0])
    while (off := keys[at, 1] != key[:, 1]).any():
        at[off] += 1
    return at


# ---------------------------------------------------------------- texts to batches


def stream(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each with 8 bytes before it (its beginning), its words each with a space, and the end;
    and where each text begins. doc: the words' texts, in order."""
    each = np.bincount(doc, size + 1, docs).astype(np.int64) + 9
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.full(int(at[-1]), SPACE, np.uint8)
    out[at[1:] - 1] = END
    out[ragged(at[:-1], np.full(docs, 7))] = 0
    out[at[:-1] + 7] = SPACE
    before = np.cumsum(size + 1) - (size + 1)
    first = np.searchsorted(doc, np.arange(docs))
    place = before + (at[:-1] + 8 - np.append(before, before[-1] + size[-1] + 1 if len(size) else 0)[first])[doc]
    out[ragged(place, size)] = data[ragged(start, size)]
    return out, at


def contexts(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key and the text of each byte of ``stream``. A key is the context, nearest byte highest, then the byte
    itself: (depth + 1) * 8 bits."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    eight = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))  # the 8 bytes from each place on, the last one highest
    place = ragged(at[:-1] + 8, np.diff(at) - 8)
    key = eight[place - 8]
    key >>= U64(64 - 8 * depth)
    key <<= U64(8)
    key |= text[place]
    return key.view(np.int64), np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at) - 8)


def cuts(size: np.ndarray, each: int) -> list[int]:
    """Cuts a run of rows into pieces of about ``each`` bytes; a larger row stands alone."""
    at, out = np.concatenate([[0], np.cumsum(size)]), [0]
    while out[-1] < len(size):
        out.append(max(out[-1] + 1, int(np.searchsorted(at, at[out[-1]] + each, "right")) - 1))
    return out


PIECE = 4 << 20  # bytes whose contexts are held at once
SCHEMA = pa.schema([("batch", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary()), ("near", pa.int64()), ("n_keys", pa.int64()), ("keys", pa.binary()), ("key_n", pa.binary()), ("kind", pa.int32())])
#: Kinds of a batch's rows.
TEXTS, WORDS, CONTEXTS = 0, 1, 2


def rows_of(batch: int, kind: int, count: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    columns |= {"batch": pa.array(np.full(count, batch)), "kind": pa.array(np.full(count, kind, np.int32))}
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(count, f.type)) for f in SCHEMA], schema=SCHEMA)


def batches_of(docs: DataFrame, bytes_each: int, depth: int) -> DataFrame:
    """docs: doc_id, held_out, text. One row per text (batch, doc_id, held_out, codes: word numbers as
    ``varints``), one per group of the batch's words (near < 0, keys: words, each with a space; codes: their numbers as
    differences), one per two nearest bytes of its contexts (near, keys: ``packed_keys``); for both n_keys, and key_n: training counts."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in arrow:
            for part in row_slices(whole, "text", bytes_each):
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                # Distinct words and contexts piece by piece, then over all pieces: most of the memory is the texts themselves.
                found, places, sizes, codes, owner, low, pairs, base, rows = [], [], [], [], [], [], [], 0, 0
                for piece in row_slices(part, "text", PIECE):
                    offsets, data = utf8(piece.column(2))
                    data = LOWER[data]
                    s, e, d = words(offsets, data)
                    h, first, code = np.unique(Rolling(data).ranges(s, e), return_index=True, return_inverse=True)
                    found.append(h)
                    places.append(s[first] + base)
                    sizes.append((e - s)[first])
                    codes.append(code.astype(np.int32) + np.int32(sum(map(len, found[:-1]))))
                    owner.append((d + rows).astype(np.int32))
                    key, own = contexts(*stream(data, s, e - s, d, piece.num_rows), depth)
                    key <<= 1
                    key |= held[rows : rows + piece.num_rows][own]
                    key.sort()
                    distinct = key >> 1
                    start = runs(distinct)
                    pairs.append((distinct[start], np.add.reduceat(1 - (key & 1), start) if len(start) else key))
                    del key, own, distinct
                    low.append(data)
                    base += len(data)
                    rows += piece.num_rows
                near, ends, keys, key_n = packed_keys(*merged(*(np.concatenate(x) for x in zip(*pairs, strict=True))), depth)
                yield rows_of(number, CONTEXTS, len(near), {"near": pa.array(near), "n_keys": pa.array(np.diff(ends)), "keys": keys, "key_n": key_n})
                del pairs, keys, key_n
                found, places, sizes, codes, owner, data = (np.concatenate(x) for x in (found, places, sizes, codes, owner, low))
                del low
                h, first, code = np.unique(found, return_index=True, return_inverse=True)
                codes = code.astype(np.int32)[codes]
                # Frequent words get small numbers; the end is word 0.
                often = np.argsort(-np.bincount(codes, minlength=len(first)), kind="stable")
                number_of = np.empty(len(first), np.int32)
                number_of[often] = np.arange(1, len(first) + 1, dtype=np.int32)
                codes = number_of[codes]
                packed, at = varints(codes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]))
                yield rows_of(number, TEXTS, rows, {"doc_id": part.column(0), "held_out": part.column(1), "codes": binary_array(packed, at)})
                n = np.bincount(codes[~held[owner]], minlength=len(first) + 1)
                n[0] = (~held).sum()
                # The end is spelled as a line feed, which no word holds.
                group = np.concatenate([[0], (h[often] >> U64(64 - WORD_BITS)).astype(np.int64)])
                order = np.argsort(group, kind="stable")
                group = group[order]
                size = np.concatenate([[1], sizes[first][often]])[order] + 1
                from_ = np.concatenate([[len(data)], places[first][often]])[order]
                blob = np.concatenate([data, np.array([END], np.uint8)])[np.minimum(ragged(from_, size), len(data))]
                stop = np.cumsum(size)
                blob[stop - 1] = SPACE
                start = runs(group)
                cut = np.append(start, len(group))
                gap = np.diff(order, prepend=0)
                gap[start] = order[start]
                yield rows_of(number, WORDS, len(start), {"near": pa.array(-1 - group[start]), "n_keys": pa.array(np.diff(cut)), "keys": binary_array(blob, np.append(0, stop)[cut]), "key_n": binary_array(*varints(n[order], cut)), "codes": binary_array(*varints(gap, cut))})
                number += 1
                del blob, packed, data, found, codes, owner
                trim()

    return docs.mapInArrow(run, "batch long, doc_id long, held_out boolean, codes binary, near long, n_keys long, keys binary, key_n binary, kind int")


# ---------------------------------------------------------------- weights

_SMALL = 1 << 16
_tables: list[np.ndarray] = []


def _log_gammas() -> list[np.ndarray]:
    """log Gamma(k + 1/2) and log Gamma(k + 1) of the numbers below 2 ** 16, made at first use."""
    if not _tables:
        k = np.arange(_SMALL, dtype=np.float64)
        _tables.extend([_lgamma(k + 0.5), _lgamma(k + 1.0)])
    return _tables


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    half, whole = _log_gammas()
    n = n0 + n1
    i = np.minimum(n, _SMALL - 1).astype(np.int64)
    out = half[np.minimum(n0, _SMALL - 1).astype(np.int64)] + half[np.minimum(n1, _SMALL - 1).astype(np.int64)] - whole[i]
    big = np.flatnonzero(n >= _SMALL)
    if len(big):
        out[big] = _lgamma(n0[big] + 0.5) + _lgamma(n1[big] + 0.5) - _lgamma(n[big] + 1.0)
    return out - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5 by Stirling's series after a shift by 8."""
    shift = np.zeros_like(x, dtype=np.float64)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8.0
    r = 1 / y
    r2 = r * r
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r2 * (1 / 360 - r2 * (1 / 1260 - r2 / 1680))) - shift


class Nodes:
    """The decision nodes of one depth and one bit place: runs of keys that agree in the context and the bits before."""

    def __init__(self, key: np.ndarray, n: np.ndarray, place: int):
        self.start = runs(key >> (8 - place))
        bit = (key >> (7 - place)) & 1
        total = np.add.reduceat(n, self.start)
        self.n1 = np.add.reduceat(n * bit, self.start)
        self.n0 = total - self.n1
        self.own = _log_kt(self.n0, self.n1)
        self.log_pw, self.beta = self.own, np.ones(len(total))
        self.of = np.repeat(np.arange(len(total)), np.diff(np.append(self.start, len(key))))  # each key's node
        one = (self.n1 + 0.5) / (total + 1)
        self.p = np.where(bit == 1, one[self.of], 1 - one[self.of])  # each key's bit, by this depth alone

    def mix(self, below: np.ndarray) -> None:
        self.log_pw = np.logaddexp(self.own, below) + np.log(0.5)
        self.beta = np.exp(self.own + np.log(0.5) - self.log_pw)


def subtrees(key: np.ndarray, n: np.ndarray, depth: int, to: int) -> tuple[np.ndarray, np.ndarray, list[Nodes]]:
    """Weighs the depths from ``depth`` up to ``to``. Returns each key's probabilities of its eight bits (8 rows), the distinct keys of
    depth ``to`` and their nodes at each bit place.

    key: distinct, in order, with whole subtrees below depth ``to``; n: counts.
    """
    n = n.astype(np.float64)
    level = [Nodes(key, n, j) for j in range(8)]
    p = np.stack([x.p for x in level])
    at = np.arange(len(key))
    for _ in range(depth - to):
        up, index = np.unique(((key >> 16) << 8) | (key & 255), return_inverse=True)
        n = np.bincount(index, n, len(up))
        at = index[at]
        for j in range(8):
            upper = Nodes(up, n, j)
            upper.mix(np.bincount(upper.of[index[level[j].start]], level[j].log_pw, len(upper.start)))
            beta = upper.beta[upper.of][at]
            p[j] = beta * upper.p[at] + (1 - beta) * p[j]
            level[j] = upper
        key = up
    return p, key, level


class Top:
    """Depths 1 and 0, from sums over the nodes of depth 2. node: nearest byte << 8 | decision prefix (1 to 255)."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        order = np.argsort(node)
        self.node, n0, n1, below = node[order], n0[order].astype(float), n1[order].astype(float), below[order]
        one, self.beta1, log_pw = self._weigh(n0, n1, below)
        self.root, up = np.unique(self.node & 255, return_inverse=True)
        zero, self.beta0, _ = self._weigh(*(np.bincount(up, x, len(self.root)) for x in (n0, n1, log_pw)))
        self.one1, self.one0 = one, zero

    @staticmethod
    def _weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = _log_kt(n0, n1)
        log_pw = np.logaddexp(own, below) + np.log(0.5)
        return (n1 + 0.5) / (n0 + n1 + 1), np.exp(own + np.log(0.5) - log_pw), log_pw

    def finish(self, p: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
        """log10 of each key's probability."""
        nearest, x = (key >> (8 * depth)) << 8, key & 255
        out = np.zeros(len(key))
        for j in range(8):
            prefix, bit = (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1
            q = p[j]
            for nodes, one, beta, node in ((self.node, self.one1, self.beta1, nearest | prefix), (self.root, self.one0, self.beta0, prefix)):
                i = np.searchsorted(nodes, node)
                q = beta[i] * np.where(bit == 1, one[i], 1 - one[i]) + (1 - beta[i]) * q
            out += np.log10(q)
        return out


# ---------------------------------------------------------------- groups

TOGETHER = 1 << 18  # keys of several groups that are weighed at once
SUMS = "near long, keys binary, key_n binary, node long, n0 double, n1 double, below double"
SUMS_SCHEMA = pa.schema([("near", pa.int64()), ("keys", pa.binary()), ("key_n", pa.binary()), ("node", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("below", pa.float64())])


def sum_rows(count: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(count, f.type)) for f in SUMS_SCHEMA], schema=SUMS_SCHEMA)


def by_group(arrow: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    """The rows of each group, which stand together; the first column is the group. One batch of rows is held at a time:
    a group comes in several lists, of which all but the first begin with None."""
    last: object = None
    for t in arrow:
        rows = list(zip(*(t.column(i).to_pylist() for i in range(columns)), strict=True))
        lo = 0
        for hi in range(1, len(rows) + 1):
            if hi == len(rows) or rows[hi][0] != rows[lo][0]:
                yield ([None] if rows[lo][0] == last else []) + rows[lo:hi]
                last, lo = rows[lo][0], hi


def add_groups(arrow: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """near, keys, counts and (of words) spelling of each group, added up over its rows (near, keys, key_n)."""
    near, parts, held = None, [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        if near >= 0:
            return *merged(key, n), np.zeros(0, np.uint8)
        order = np.lexsort((key[:, 1], key[:, 0]))
        start = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]).any(1)))
        blob = np.concatenate([p[2] for p in parts])
        lo, hi = spelled(blob)
        first = order[start]
        return key[first], np.add.reduceat(n[order], start), blob[ragged(lo[first], (hi - lo)[first] + 1)]

    for rows in by_group(arrow, 3):
        if rows[0] is not None and near is not None:
            yield near, *joined()
        if rows[0] is not None:
            near, parts, held = rows[0][0], [], 0
        for _, keys, n in rows[rows[0] is None :]:
            blob = np.frombuffer(keys, np.uint8)
            key = unpacked_keys(near, keys, depth) if near >= 0 else word_keys(blob)
            parts.append((key, unpacked(np.frombuffer(n, np.uint8)), blob))
            held += len(key)
            if held > max(1 << 20, 2 * len(parts[0][0])):
                parts = [joined()]
                held = len(parts[0][0])
    if near is not None:
        yield near, *joined()


def summed(dealt: DataFrame, depth: int) -> DataFrame:
    """dealt: near, keys, key_n, the rows of a group in one task and together. Rows of three kinds: a group's sums, in
    pieces (near, keys, key_n); sums over nodes of depth 1 (node, n0, n1, below); and of training words (n0: tokens, n1: distinct words)."""
    limit = 1 << 20

    def weighed(groups: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, n = (np.concatenate(x) for x in zip(*groups, strict=True))
        _, key2, level = subtrees(key, n, depth, 2)
        node = np.concatenate([((key2[x.start] >> 16) << 8) | (1 << j) | ((key2[x.start] & 255) >> (8 - j)) for j, x in enumerate(level)])
        u, at = np.unique(node, return_inverse=True)
        sums = [np.bincount(at, np.concatenate([getattr(x, c) for x in level]), len(u)) for c in ("n0", "n1", "log_pw")]
        return sum_rows(len(u), {"node": pa.array(u), **{c: pa.array(v) for c, v in zip(("n0", "n1", "below"), sums, strict=True)}})

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, held = [], 0
        for near, key, n, blob in add_groups(arrow, depth):
            for lo in range(0, len(key), limit):
                hi = min(lo + limit, len(key))
                if near >= 0:
                    gap = np.diff(key[lo:hi], prepend=near << (8 * (depth - 1)))
                    keys = varints(gap, np.zeros(1, np.int64))[0].tobytes()
                else:
                    ends = np.append(0, spelled(blob)[1] + 1)
                    keys = blob[ends[lo] : ends[hi]].tobytes()
                yield sum_rows(1, {"near": pa.array([near]), "keys": pa.array([keys]), "key_n": pa.array([varints(n[lo:hi], np.zeros(1, np.int64))[0].tobytes()])})
            if near < 0:
                yield sum_rows(1, {"n0": pa.array([float(n.sum())]), "n1": pa.array([float((n > 0).sum())])})
                continue
            wait.append((key, n))
            held += len(key)
            if held > TOGETHER:
                yield weighed(wait)
                wait, held = [], 0
        if wait:
            yield weighed(wait)
        trim()

    return dealt.mapInArrow(run, SUMS)


def answered(dealt: DataFrame, depth: int, top: Top) -> DataFrame:
    """dealt: near, batch (null for the group's sums, which come first), keys, key_n. Answers each batch's row: logs, for
    contexts log10 of the probabilities (32-bit floats), for words the training counts (``varints``)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, values, keys = [], None, None
        for rows in by_group(arrow, 4):
            if rows[0] is not None:
                parts, values = [], None
            out = []
            for near, batch, pack, n in rows[rows[0] is None :]:
                key = unpacked_keys(near, pack, depth) if near >= 0 else word_keys(np.frombuffer(pack, np.uint8))
                if batch is None:
                    parts.append((key, unpacked(np.frombuffer(n, np.uint8))))
                    continue
                if values is None:
                    keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(keys) if near >= 0 else np.lexsort((keys[:, 1], keys[:, 0]))
                    keys, values = keys[order], values[order]
                    parts = []
                    if near >= 0:
                        p, _, _ = subtrees(keys, values, depth, 2)
                        values = top.finish(p, keys, depth).astype(np.float32)
                        del p
                value = values[found_at(keys, key)]
                out.append((batch, near, value.tobytes() if near >= 0 else varints(value, np.zeros(1, np.int64))[0].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["batch", "near", "logs"])
        trim()

    return dealt.mapInArrow(run, "batch long, near long, logs binary")


# ---------------------------------------------------------------- the operator

RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def score(docs: DataFrame, depth: int = 6, batch_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each text.

    docs: doc_id, held_out (texts to learn nothing from), text; other columns are ignored. Words are
    separated by bytes 20 and 09 to 0D; the end counts as a token. base_score: log10 of the add-one unigram
    probability; score: log10 probability by context-tree weighting, from 32-bit logarithms of each byte's. Null text:
    empty, the end alone. Null held_out counts as held out. Null doc_id and repeated rows: one row out for each row in.
    Empty table: no rows; with nothing to learn from, every decision has probability one half. A very long text is a
    batch of its own. Memory: a batch with its contexts, or the distinct (context, byte) pairs of one pair of nearest bytes.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6: a context and its byte are one 64-bit number")
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("held_out"), F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    batched = scratch.save("batched", batches_of(src, batch_bytes, depth), by="kind")
    groups = batched.filter(F.col("kind") != TEXTS)
    tasks = partitions_for(groups.agg(F.sum("n_keys")).first()[0], 1_000_000)
    sums = scratch.save("sums", summed(groups.select("near", "keys", "key_n").repartition(tasks, "near").sortWithinPartitions("near"), depth))
    scratch.release()
    total, distinct = (int(x or 0) for x in sums.filter("near is null and node is null").agg(F.sum("n0"), F.sum("n1")).first())
    nodes = sums.filter("node is not null").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()  # at most 256 * 255 rows
    top = Top(*[np.asarray(nodes.column(c)) for c in ("node", "n0", "n1", "below")])
    asked = groups.select("near", "batch", "keys", "key_n").unionByName(sums.filter("near is not null").select("near", F.lit(None).cast("long").alias("batch"), "keys", "key_n"))
    answers = scratch.save("answers", answered(asked.repartition(tasks, "near").sortWithinPartitions("near", F.col("batch").asc_nulls_first()), depth, top))
    del groups, asked
    scratch.drop("sums", f"batched/kind={CONTEXTS}")
    base = float(total + distinct + 1)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by("near")
        near = np.asarray(left.column("near").fill_null(0))
        isword = np.asarray(left.column("near").is_valid())
        spelling = left.filter(pa.array(isword)).take(pa.array(np.argsort(near[isword])))
        rows = left.filter(pa.array(~isword))
        logs = right.column("logs").to_pylist()
        k = int((np.asarray(right.column("near")) < 0).sum())
        value = np.frombuffer(b"".join(logs[k:]), np.float32).astype(np.float64)
        counts = unpacked(np.frombuffer(b"".join(logs[:k]), np.uint8))
        gaps = [np.cumsum(unpacked(np.frombuffer(x, np.uint8))) for x in spelling.column("codes").to_pylist()]
        code_of = np.concatenate(gaps)
        blob = np.frombuffer(b"".join(spelling.column("keys").to_pylist()), np.uint8)
        lo, hi = spelled(blob)
        c, start, size = (np.zeros(len(code_of), np.int64) for _ in range(3))
        c[code_of], start[code_of], size[code_of] = counts, lo, hi - lo
        base_p = np.log10((c + 1) / base)
        offsets, raw = utf8(rows.column("codes"))
        code = unpacked(raw)
        each = np.diff(np.concatenate([[0], np.cumsum(raw < 128)])[offsets])
        doc = np.repeat(np.arange(len(each)), each)
        n_bytes = np.bincount(doc, size[code] + 1, len(each)).astype(np.int64) + 1
        found = []
        cut = cuts(n_bytes, PIECE)
        ends = np.concatenate([[0], np.cumsum(each)])
        for a, b in zip(cut, cut[1:], strict=False):
            w = code[ends[a] : ends[b]]
            key, own = contexts(*stream(blob, start[w], size[w], doc[ends[a] : ends[b]] - a, b - a), depth)
            # Distinct keys of the piece, and how often each text has each.
            order = np.argsort(key)
            key = key[order]
            first = runs(key)
            found.append((key[first], np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key)))), own[order]))
            del key, order, own
        keys = np.unique(np.concatenate([x[0] for x in found]))  # in the order of the answers
        s = np.zeros(len(each))
        for (a, b), (key, at, own) in zip(zip(cut, cut[1:], strict=False), found, strict=True):
            s[a:b] = np.bincount(own, value[np.searchsorted(keys, key)][at], b - a)
        known, score_ = (np.bincount(doc, x, len(each)) for x in ((c > 0)[code], base_p[code]))
        n = rows.num_rows
        trim()
        columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(each + 1), pa.array(known.astype(np.int64) + int(c[0] > 0)), pa.array(np.full(n, total)), pa.array(score_ + base_p[0]), pa.array(s), pa.array(-s * np.log2(10) / n_bytes)]
        return pa.Table.from_arrays(columns, schema=RESULT)

    left = batched.filter(F.col("kind").isin(TEXTS, WORDS)).select("batch", "doc_id", "held_out", "codes", "near", "keys")
    n = batched.filter(F.col("kind") == TEXTS).agg(F.count_distinct("batch")).first()[0]
    # More tasks than batches, up to a point, so that few tasks get several.
    tasks = max(1, min(3 * n, max(n // 4, 2000)))
    return left.repartition(tasks, "batch").groupBy("batch").cogroup(answers.repartition(tasks, "batch").groupBy("batch")).applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
