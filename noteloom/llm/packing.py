"""Vector bin packing of tokenised texts into fixed-length training sequences.

Texts are cut into pieces and the pieces are placed into sequences ("bins") under three limits at
once: tokens, segments (pieces in a sequence) and loss-bearing tokens. A new sequence starts with
the largest waiting piece; then, as long as something fits, the waiting piece whose demand vector
has the largest dot product with what the sequence has left is added (the dot-product heuristic
for vector bin packing). When nothing fits whole, a waiting piece is cut to fill the gap, so that
padding arises only where the segment or loss limit binds.

Each scan partition is packed on its own from a pool of waiting pieces of bounded size: no shuffle,
no driver state, and memory does not depend on the input. Sequence ids hold the partition's number
above bit 40, so a retried task gives the same ids.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ragged, row_slices, trim, utf8

SCHEMA = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("loss_tokens", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _byte_letters() -> list[str]:
    """The visible characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class WordTokenizer:
    """Token ids by way of distinct words.

    The vocabulary's pre-tokenizer never joins characters over white space, so a text's ids are the
    ids of its space-separated words in turn. Arrow finds a batch's distinct words, and only these go to
    the tokenizer. Words of ASCII and Latin-1 letters, digits and marks are lower-cased and cut as its
    normaliser and pre-tokenizer would (letters, single digits, other marks), and go to the same model behind
    a plain split at spaces; each piece ends with an end-of-word id, by which words are told apart.
    All other words go through the whole tokenizer, a special token between them.
    """

    SEPARATOR = "<|endoftext|>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.cut = self.model.token_to_id(self.SEPARATOR)
        if self.cut is None:
            raise ValueError(f"the vocabulary has no {self.SEPARATOR}")
        self.pieces = Tokenizer(self.model.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        letters = [x.encode() for x in _byte_letters()]
        self.width = np.array([len(x) for x in letters])
        self.letters = np.array([[*x, 0][:2] for x in letters], np.uint8)
        b = np.arange(256)
        self.plain = (b > 0x20) & (b < 0x7F) & (b != 0x3C) & (b != 0x27) | (b == 0xC3)
        self.kind = np.where((b >= 0x30) & (b < 0x3A), 1, np.where((b >= 0x61) & (b < 0x7B) | (b >= 0x80), 0, 2)).astype(np.int8)

    def simple(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words that can take the short way, their numbers of ids, their ids in turn)."""
        n = len(offsets) - 1
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        ok = np.where(after, (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7), self.plain[data])
        word = np.repeat(np.arange(n), np.diff(offsets))
        fast = np.bincount(word[~ok], minlength=n) == 0
        fast &= np.diff(offsets) > 0
        use = fast[word]
        data, word, after = data[use], word[use], after[use]
        data = np.where(after & (data < 0x9F), data + 32, LOWER[data]).astype(np.uint8)
        kind = self.kind[data]
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1) | (word[1:] != word[:-1])
        width = self.width[data] + first
        at = np.cumsum(width) - width
        blob = np.full(int(width.sum()), 32, np.uint8)
        at += first
        blob[at] = self.letters[data, 0]
        two = self.width[data] == 2
        blob[at[two] + 1] = self.letters[data[two], 1]
        heads = np.flatnonzero(first)
        bounds = np.append((at[heads] - 1)[::1000], len(blob)).tolist() if len(heads) else [0]
        raw = blob.tobytes()
        texts = [raw[i + 1 : j].decode() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        got = [np.array(e.ids, "<u4") for i in range(0, len(texts), 16) for e in self.pieces.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)]
        ids = np.concatenate(got) if got else np.zeros(0, "<u4")
        owner = word[heads]
        ends = np.flatnonzero(self.last[ids])
        size = np.diff(np.concatenate([[-1], ends]))
        return fast, np.bincount(owner, size, n).astype(np.int64)[fast], ids

    def whole(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids, of all words in turn."""
        own = pc.match_substring(distinct, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(own), "", distinct)
        bounds = np.append(np.arange(0, len(plain), 200), len(plain)).astype(np.int64)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), plain), pa.scalar(self.SEPARATOR, plain.type)).to_pylist()
        parts = []
        for i in range(0, len(joined), 16):
            for e in self.model.encode_batch_fast(joined[i : i + 16], add_special_tokens=False):
                parts += [np.array(e.ids, "<u4"), np.array([self.cut], "<u4")]
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        cut = np.flatnonzero(ids == self.cut)
        counts = np.diff(np.concatenate([[-1], cut])) - 1
        ids = ids[ids != self.cut]
        for k in np.flatnonzero(own).tolist():  # words that might hold a special token
            e = np.array(self.model.encode(distinct[k].as_py(), add_special_tokens=False).ids, "<u4")
            at = int(counts[:k].sum())
            ids = np.concatenate([ids[:at], e, ids[at:]])
            counts[k] = len(e)
        return counts, ids

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First places of the words' ids in the returned ids, their numbers, and the ids."""
        fast, few, short = self.simple(*utf8(distinct))
        counts = np.zeros(len(distinct), np.int64)
        counts[fast] = few
        slow, long = self.whole(distinct.filter(pa.array(~fast)))
        counts[~fast] = slow
        first = np.zeros(len(distinct), np.int64)
        first[fast] = np.cumsum(few) - few
        first[~fast] = len(short) + np.cumsum(slow) - slow
        return first, counts, np.concatenate([short, long])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids (unsigned 32-bit) of all texts; null is empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        for gap in ("\n", "\t", "\r"):
            texts = pc.replace_substring(texts, gap, " ")
        parts = pc.split_pattern(texts, " ")
        flat = parts.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first, sizes, pool = self.words(flat.dictionary)
        counts = sizes[codes]
        ids = pool[ragged(first[codes], counts)]
        at = np.concatenate(([0], np.cumsum(counts)))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        return at[bounds - bounds[0]], ids


class Packer:
    """Places pieces; ``ready`` holds finished rows."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, pool: int):
        self.next_id, self.tokens, self.segments, self.loss, self.pool = first_id, tokens, segments, loss, pool
        self.by_size: dict[int, list] = defaultdict(list)
        self.waiting = 0
        self.counts = np.zeros(tokens + 1, np.int64)
        self.top_loss = np.zeros(tokens + 1)  # of the piece that take() gives next
        self.ready: list[tuple] = []

    def add(self, doc, ids: np.ndarray, end: int, loss_free: int = 0) -> None:
        """Cuts off whole sequences and keeps the rest waiting. The first ``loss_free`` ids bear no loss."""
        all_ids = np.append(ids, np.uint32(end)).astype("<u4")
        total, at = len(all_ids), 0
        cut = min(self.tokens, self.loss)
        while total - at >= cut and (at >= loss_free or cut == self.tokens):
            self.place([(doc, at, all_ids[at : at + cut], total, max(0, at + cut - max(at, loss_free)))])
            at += cut
        if at < total:
            self.wait((doc, at, all_ids[at:], total, max(0, total - max(at, loss_free))))
        while self.waiting > self.pool:
            self.fill()

    def wait(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_size[n].append(piece)
        self.top_loss[n] = piece[4]
        self.counts[n] += 1
        self.waiting += 1

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.waiting -= 1
        piece = self.by_size[n].pop()
        if self.by_size[n]:
            self.top_loss[n] = self.by_size[n][-1][4]
        return piece

    def place(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total, loss in pieces:
            self.ready.append((doc, start, len(ids), ids.tobytes(), loss, total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def fill(self) -> None:
        """Builds one sequence out of the waiting pieces."""
        sizes = np.flatnonzero(self.counts)
        chosen = [self.take(int(sizes[-1]))]
        room = np.array([self.tokens - len(chosen[0][2]), self.segments - 1, self.loss - chosen[0][4]], float)
        scale = np.array([self.tokens, self.segments, self.loss], float)
        while room.min() > 0:
            sizes = np.flatnonzero(self.counts)
            if not len(sizes):
                break
            losses = self.top_loss[sizes]
            fits = (sizes <= room[0]) & (losses <= room[2])  # one more segment fits, as room is left
            if fits.any():
                weight = room / scale / scale
                score = sizes * weight[0] + weight[1] + losses * weight[2]
                best = int(np.argmax(np.where(fits, score, -1)))
                piece = self.take(int(sizes[best]))
            else:  # cut the smallest that is too large; what is left waits again
                doc, start, ids, total, loss = self.take(int(sizes[0]))
                free = len(ids) - loss
                n = int(min(room[0], free + room[2], len(ids)))
                self.wait((doc, start + n, ids[n:], total, len(ids) - max(free, n))) if n < len(ids) else None
                piece = (doc, start, ids[:n], total, max(0, n - free))
            chosen.append(piece)
            room -= [len(piece[2]), 1, piece[4]]
        self.place(chosen)

    def finish(self) -> None:
        """Packs what waits. The last, short sequence is cut at powers of two, which need no padding."""
        while self.waiting:
            n = int((np.arange(len(self.counts)) * self.counts).sum())
            if n >= self.tokens or self.waiting > self.segments:
                self.fill()
                continue
            rest = [self.take(int(s)) for s in np.flatnonzero(self.counts)[::-1] for _ in range(self.counts[s])]
            while n:
                want, room = 1 << (n.bit_length() - 1), 1 << (n.bit_length() - 1)
                chosen, loss_room = [], self.loss
                while room and len(chosen) < self.segments:
                    doc, start, ids, total, loss = rest.pop(0)
                    free = len(ids) - loss
                    k = min(room, len(ids), free + loss_room)
                    if k:
                        chosen.append((doc, start, ids[:k], total, max(0, k - free)))
                        loss_room -= max(0, k - free)
                        room -= k
                    if k < len(ids):
                        rest.insert(0, (doc, start + k, ids[k:], total, len(ids) - max(free, k)))
                        if room:
                            break  # the limit on loss is reached
                self.place(chosen)
                n -= want - room


_tokenizers: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer: str, tokens: int = 2048, segments: int = 2048, loss: int = 2048, end_id: int = 1, pool: int = 2048) -> DataFrame:
    """Packs ``docs`` (doc_id, text, optional prompt_chars) and returns one row per piece.

    Columns: doc_id, start (ids of the text before the piece), length, ids (binary, little-endian
    unsigned 32-bit), loss_tokens, doc_tokens, sequence_id, offset. ``end_id`` ends every text.
    Column loss_free, if there, gives how many leading ids of a text bear no loss.

    Null or empty text: one piece that holds the end id alone. Null doc_id: packed, id stays null.
    Repeated rows are packed each for itself. Empty table: no rows. Other columns are ignored.
    A text of any length is cut; nothing is dropped. The rows of a partition must come in the same
    order when a task is retried, as from files; ties cannot arise.
    """
    if min(tokens, segments, loss) < 1:
        raise ValueError("limits must be positive")
    free = F.coalesce(F.col("loss_free"), F.lit(0)).cast("long") if "loss_free" in docs.columns else F.lit(0).cast("long")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), free.alias("loss_free"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:  # kept for the worker's next tasks
            _tokenizers[tokenizer] = WordTokenizer(tokenizer)
        coder = _tokenizers[tokenizer]
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss, pool)

        def out() -> pa.RecordBatch:
            rows, packer.ready = packer.ready, []
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for part in row_slices(batch, "text", 12 << 20):
                offsets, ids = coder.encode(part.column(1))
                for i, (doc, lf) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    packer.add(doc, ids[offsets[i] : offsets[i + 1]], end_id, lf)
                    if len(packer.ready) >= 2000:
                        yield out()
                del offsets, ids
                trim()
        packer.finish()
        if packer.ready:
            yield out()

    return src.mapInArrow(run, SCHEMA)
