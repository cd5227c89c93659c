"""Quality classifier from positive and unlabelled texts.

A linear model over text statistics and hashed byte pairs minimises the non-negative unbiased
PU risk (Kiryo et al. 2017) with squared loss: trusted positives, unlabelled texts and a class
prior; when the estimated risk of the negatives falls below zero, the step undoes that part. With squared
loss the risk depends on the texts through first and second moments of their features alone, so the unlabelled risk
is that of all training texts, from one aggregated pass, whatever their number. The prior is estimated from labelled
training rows, which also calibrate the score (Platt scaling).

Only labelled rows are sampled: at most ``sample`` positives and labelled rows each reach the driver, chosen by hash, as feature
rows of fixed width; and two matrices of moments. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, row_slices, runs, utf8, words

HASHED = 192
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "|", "%#$&*@^~=+<>{}[]\\_", ";:'\"()-/", " ", "\n", "\t\r\x0b\x0c")
KIND = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    KIND[[ord(x) for x in _c]] = _i
STATS = len(CLASSES) + 1 + 9
WIDTH = STATS + HASHED


def features(col: pa.Array) -> np.ndarray:
    """One row of WIDTH values per text; null and empty texts give zeros."""
    offsets, data = utf8(col)
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n, dtype=np.int64), size)
    some = np.maximum(size, 1)[:, None]
    kinds = len(CLASSES) + 1
    out[:, :kinds] = np.bincount(doc * kinds + KIND[data], minlength=n * kinds).reshape(n, kinds) / some
    starts, ends, owner = words(offsets, data)
    count = np.bincount(owner, minlength=n)
    each = np.maximum(count, 1)
    length = ends - starts
    low = LOWER[data]
    hashes = Rolling(low).ranges(starts, ends)
    order = np.lexsort((hashes, owner))
    key_o, key_h = owner[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (key_o[1:] != key_o[:-1]) | (key_h[1:] != key_h[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))
    distinct = np.bincount(key_o[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, key_o[first], times)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    lone = length == 1
    last = KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    cols = [np.bincount(owner, length, n) / each / 10, distinct / each, top / each, np.bincount(owner, again, n) / each, np.bincount(owner, lone, n) / each, np.bincount(owner, (last >= 3) & (last <= 8), n) / each, np.bincount(owner, (last >= 5) & (last <= 7), n) / each, np.log1p(count) / 10, (size > 0).astype(float)]
    out[:, kinds:STATS] = np.stack(cols, 1)
    pair = ((low[:-1].astype(np.uint32) * 40503 + low[1:].astype(np.uint32) * 30011) >> 5) % HASHED
    inside = doc[:-1] == doc[1:]
    counts = np.bincount((doc[:-1] * HASHED + pair)[inside], minlength=n * HASHED).reshape(n, HASHED)
    out[:, STATS:] = np.sqrt(counts / some)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -40, 40)))


def moments(x: np.ndarray) -> np.ndarray:
    """Sums of the products of all pairs of features, of the features (last row and column), and the number of rows (last place)."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1, dtype=np.float64)
    return z.T @ z


def all_moments(rows: DataFrame) -> np.ndarray:
    """``moments`` of column text of all rows: each task sums its own, then groups of tasks, then one task."""
    side = WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side))
        for batch in batches:
            for part in row_slices(batch, "text", 2 << 20):
                total += moments(features(part.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32]), pa.array([total.tobytes()], pa.binary())], names=["g", "m"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(side * side)
        for m in t.column("m"):
            total += np.frombuffer(m.as_py(), np.float64)
        return pa.table({"g": pa.array([0], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    each = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "g long, m binary")
    whole = each.groupBy("g").applyInArrow(add, "g long, m binary").withColumn("g", F.lit(0).cast("long")).groupBy("g").applyInArrow(add, "g long, m binary").first()
    return np.frombuffer(whole["m"], np.float64).reshape(side, side) if whole else np.zeros((side, side))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-2) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), R the mean of (1 - y * f)^2 / 4, with Adam; both arguments are ``moments``."""
    n = unlabelled[-1, -1]
    centre = unlabelled[-1, :-1] / n
    scale = np.sqrt(np.maximum(np.diag(unlabelled)[:-1] / n - centre**2, 0)) + 1e-3
    to = np.zeros_like(unlabelled)  # features to centred and scaled ones
    to[:-1, :-1], to[-1, :-1], to[-1, -1] = np.diag(1 / scale), -centre / scale, 1
    p, u = to.T @ positive @ to / positive[-1, -1], to.T @ unlabelled @ to / n
    w = np.zeros(len(p))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        against = lambda k: (1 + 2 * k[-1] @ w + w @ k @ w) / 4  # noqa: E731  the mean loss of calling the rows negative
        plus, minus = (p @ w - p[-1]) / 2, (u[-1] + u @ w) / 2 - prior * (p[-1] + p @ w) / 2
        grad = prior * plus + minus if against(u) >= prior * against(p) else -minus
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1], float(w[-1]), centre, scale, prior=prior)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 60) -> Model:
    """Platt scaling by Newton's method; the slope stays positive."""
    z = model.raw(x)
    a, b = 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    if n1 and n0:
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(steps):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((q - target) * z).sum() + 1e-3 * a, (q - target).sum()])
            r = np.maximum(q * (1 - q), 1e-9)
            h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def fold(doc_id: str = "doc_id", of: int = 5):
    """crc32 of the id as text, modulo ``of``; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of


def featured(rows: DataFrame) -> np.ndarray:
    """Feature rows (y first) of (y, text), brought to the driver; the caller bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                x = features(part.column(1))
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.float32)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.concatenate([y, x], 1)], pa.binary())], names=["x"])

    got = rows.select(F.col("y").cast("int").alias("y"), F.col("text").cast("string").alias("text")).mapInArrow(run, "x binary").toArrow().column(0)
    return np.frombuffer(b"".join(got.to_pylist()), np.float32).reshape(-1, WIDTH + 1).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, folds: int = 5, held: int = 0) -> Model:
    """Fits on rows outside fold ``held``: unlabelled texts are all of them. ``sample`` bounds the positives and the labelled rows that calibrate.

    Labels with null doc_id or quality are ignored; without positives, or without texts, the score is 0.5 for all texts.
    Repeated labels count as often as they stand there, up to the bound; of texts that share a labelled id one counts there. Null
    texts count as empty ones, repeated rows as often as they stand there. Other columns are ignored.
    """
    mine = fold(of=folds) != held
    pick = lambda df, salt: df.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(sample)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(mine)
    share = known.agg(F.avg("y"), F.sum("y")).first()
    blank = Model(np.zeros(WIDTH), 0.0, np.zeros(WIDTH), np.ones(WIDTH))
    if not share[1]:
        return blank
    prior = min(0.99, max(0.01, share[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = pick(known.filter("y = 1"), 1).select("doc_id", F.lit(2).alias("y")).unionByName(pick(known, 2)).groupBy("doc_id", "y").agg(F.count("*").cast("int").alias("times"))
    # At most 2 * sample ids; of rows that share an id, whose number has no bound, one text counts.
    some = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y", "times").agg(F.min("text").alias("text"))
    rows = featured(some.select(F.explode(F.array_repeat("y", F.col("times"))).alias("y"), "text"))
    rows = rows[np.lexsort(rows.T[::-1])]  # a fixed order, so that sums are the same in each run
    y, x = rows[:, 0], rows[:, 1:]
    unlabelled = all_moments(texts.filter(mine))
    if not (y == 2).any() or not unlabelled[-1, -1]:
        return blank
    model = fit_nnpu(moments(x[y == 2]), unlabelled, prior)
    return calibrate(model, x[y <= 1], y[y <= 1])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1, higher is better) to doc_id, text and the columns named in ``keep``.

    Null text counts as empty; empty texts get the score of an empty text. Null ids, repeated rows: one row out
    for each row in. A text of any length is used whole.
    """
    keep = ["doc_id"] if keep is None else keep
    names = [c for c in docs.columns if c in keep]
    src = docs.select(*names, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "_text", 2 << 20):  # the last column
                s = model.score(features(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64())], names=[*part.schema.names[:-1], "score"])

    return src.mapInArrow(run, f"{kinds + ', ' if kinds else ''}score double")
